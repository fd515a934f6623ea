"""Line dedup by site-relative frequency, in DataFrame functions alone.

A host's boilerplate is a line that a large share of the host's pages contain.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh

#: A line is boilerplate if more than this share of its host's pages contain it ...
RATIO = 0.05
#: ... and at least so many pages.
MIN_PAGES = 5
#: Bytes of the hosts' boilerplate lists up to which they are broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 64 << 20


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line, so that counting moves keys and no text."""
    t = F.trim(line)
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit("line"), t).alias("b"))


def boilerplate(df: DataFrame, text: str, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row a host with boilerplate: ``host`` and ``keys``, the keys of its lines over the ratio.

    Pages are counted before lines meet: each page gives a key once, and partial sums precede the shuffle,
    so neither a hot host nor a hot line meets in one task.  A host's list has at most (distinct lines of a
    mean page) / ratio entries.
    """
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != ""), line_key))
    seen = df.select(F.col(host).alias("h"), F.explode(lines).alias("k")).groupBy("h", "k").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    pages = df.groupBy(F.col(host).alias("host_")).agg(F.count("*").alias("n_pages"))
    over = seen.join(pages, seen["h"].eqNullSafe(pages["host_"])).filter(F.col("n") > F.lit(ratio) * F.col("n_pages"))
    return over.groupBy("h").agg(F.array_sort(F.collect_list("k")).alias("keys"))


def drop_lines(
    df: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, kept: str = "clean_text", n_lines: str = "n_lines", n_dropped: str = "n_dropped"
) -> DataFrame:
    """Every row of ``df`` with the text without its host's boilerplate lines, and the numbers of lines before and dropped.

    Lines are compared after trimming spaces; blank lines are neither counted nor dropped.  Every row is a
    page, so repeated rows count each.  Rows with a null host form one host.  A null text stays null with 0
    lines; an empty one has one (blank) line.  A text that loses all lines becomes ''.  Output columns replace columns of
    the same names; an empty table gives no rows.
    """
    found = boilerplate(df, text, host, ratio, min_pages)
    mark, at, lines = fresh(df, "keys_"), fresh(df, "host_at_"), fresh(df, "lines_")
    found = found.select(F.col("h").alias(at), F.col("keys").alias(mark))
    # Two jobs need the lists, so they are kept where they were made; an executor that is lost takes nothing that can't be made again.
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    size = found.agg(F.sum(F.size(mark) * 16 + 64)).first()[0] or 0
    joined = df.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, df[host].eqNullSafe(F.col(at)), "left")
    split = F.when(F.col(text).isNotNull(), F.split(F.col(text), "\n", -1))
    good = F.when(F.col(mark).isNull(), F.col(lines)).otherwise(F.filter(F.col(lines), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(mark), line_key(x))))
    others = [c for c in df.columns if c not in (n_lines, n_dropped, kept)]
    held = fresh(df, "good_")
    return (
        joined.withColumn(lines, split)
        .withColumn(held, good)
        .select(
            *[F.col(c) for c in others],
            F.array_join(held, "\n").alias(kept),
            F.coalesce(F.array_size(lines), F.lit(0)).cast("long").alias(n_lines),
            F.coalesce(F.array_size(lines) - F.array_size(held), F.lit(0)).cast("long").alias(n_dropped),
        )
    )
