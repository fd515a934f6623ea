"""Walks in which every choice depends on the choices before it, without a task that holds all rows.

``greedy`` decides rows in rounds: a row is taken as soon as it is among the first of all its groups even if every undecided row
before it were taken too.  ``fold_segments`` is for walks that allow no such bound: rows are cut to segments of a bounded number in
order, and each segment is folded by its own task, with the state handed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.sources.tables import hadoop, materialise, remove, scratch, united

#: Order of a walk: major_ and minor_ are numbers, row_ tells equal rows apart.
ORDER = ("major_", "minor_", "repo_id", "row_")
#: Groups that are broadcast at most; beyond, joins are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of a segment.
SEGMENT_ROWS = 2_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, broadcast if its bound of rows allows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def first_of_groups(live: DataFrame, group: str, most: int) -> DataFrame:
    """Numbers of the rows that are among the first ``room_<group>`` of their group.  No task sends more than ``most`` rows of a group."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*ORDER))
    return live.select("row_", group, f"room_{group}", *[c for c in ORDER if c != "row_"]).withColumn("nth_", nth).filter(F.col("nth_") <= most).filter(F.col("nth_") <= F.col(f"room_{group}")).select("row_")


def reach(sure: DataFrame, n: int) -> Column | None:
    """A condition that the first n rows of ``sure`` meet, and not many others; null if there are fewer.  Any such bound is sound: a walk ends there at the latest."""
    counts = sorted((r[0], r[1]) for r in sure.groupBy("major_").agg(F.count("*")).collect())  # a few kinds of rows
    before = 0
    for major, c in counts:
        if before + c >= n:
            break
        before += c
    else:
        return None
    need, own = n - before, F.col("major_") == F.lit(major)
    near = sure.filter(own).agg(F.percentile_approx("minor_", min(1.0, (need + 1 + c / 1000) / c), 10_000)).first()[0]
    # The quantile is approximate, so it is checked by a count.
    if sure.filter(own & (F.col("minor_") <= F.lit(near))).count() < need:
        return F.col("major_") <= F.lit(major)
    return (F.col("major_") < F.lit(major)) | (own & (F.col("minor_") <= F.lit(near)))


def greedy(rows: DataFrame, groups: Mapping[str, int], n: int) -> DataFrame:
    """The rows that a walk in ORDER takes until it has ``n``, if it takes each row all of whose groups have room left.

    ``groups``: columns, and the most rows of any of their groups; ``room_<column>`` is what the row's group has left, the same in
    all its rows.  Decisions by rounds:

    * a row that is among the first ``room`` rows of each of its groups, counting taken and undecided ones alike, is taken: whatever
      becomes of the undecided ones, there is room;
    * where as many rows of a group are taken as it had room, its other rows are out;
    * beyond the n-th row that is taken, rows don't matter.

    The first undecided row is always decided, so rounds end; how many there are depends on how long chains of rows are of
    which each waits for the one before.  The rounds write narrow tables; no task has more rows of a group than its room, and none has all.
    """
    rows = rows.filter(reduce(lambda a, b: a & b, [F.col(f"room_{g}") > 0 for g in groups]))
    live, sure, old = rows, None, []
    while True:
        safe = reduce(lambda a, b: a.join(b, "row_"), [first_of_groups(live, g, most) for g, most in groups.items()])
        sure = materialise(live.join(safe, "row_", "left_semi"), "sure")
        within = reach(sure, n)
        undecided = live.join(sure.select("row_"), "row_", "left_anti")
        if within is not None:
            sure, undecided = sure.filter(within), undecided.filter(within)
        for g in groups:
            full = sure.groupBy(F.col(g).alias("full_")).agg((F.count("*") >= F.first(f"room_{g}")).alias("is_")).filter("is_").select("full_")
            undecided = undecided.join(small(full, n), F.col(g).eqNullSafe(F.col("full_")), "left_anti")
        undecided = materialise(undecided, "undecided")
        if undecided.isEmpty():
            break
        live = united(sure, undecided)
        remove(*old)
        old = [sure, undecided]
    taken = materialise(sure.orderBy(*ORDER).limit(n), "taken")
    remove(*old, sure, undecided)
    return taken


def fold_segments(
    df: DataFrame, order: Sequence[str], fold: Callable[[Iterator[pd.DataFrame], object], Iterator[pd.DataFrame]], schema: str, state: object, onward: Callable[[DataFrame, object], object], segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Fold all rows in ``order``, which has to tell rows apart, one segment of about ``segment_rows`` rows after another, each in its own task.

    ``fold(frames, state)`` yields the segment's results, and ``onward(results, state)`` says from them, as a DataFrame, what state the
    next segment begins with; a state has to be small.  Results are appended to a table in the shared folder.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // segment_rows))
    cut = materialise(df.repartitionByRange(parts, *order).withColumn("segment_", F.spark_partition_id()) if parts > 1 else df.withColumn("segment_", F.lit(0)), "segments")
    path = scratch(spark, "folded")
    segments = sorted(r[0] for r in cut.select("segment_").distinct().collect()) or [0]  # ranges may be more or fewer than asked for
    for k in segments:
        # By an exchange, so that a segment's files may be read by many tasks.
        own = cut.filter(F.col("segment_") == k).drop("segment_").repartition(1).sortWithinPartitions(*order)

        def run(frames: Iterator[pd.DataFrame], state: object = state) -> Iterator[pd.DataFrame]:
            return fold(frames, state)

        own.mapInPandas(run, schema).write.parquet(f"{path}/segment={k}")
        if k != segments[-1]:
            state = onward(spark.read.parquet(f"{path}/segment={k}"), state)
    remove(cut)
    fs, folder = hadoop(spark, path)
    fs.deleteOnExit(folder)
    return spark.read.parquet(path).drop("segment")
