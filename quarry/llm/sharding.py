"""Sharding along a Hilbert curve.

Several metadata columns are quantised to cells, cells are numbered along a Hilbert curve,
rows are sorted by that number and the sorted run is cut into shards.  Neighbouring cells stay
neighbours in every dimension, so the minimum and maximum of each column prune shards.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import fresh
from quarry.sources.tables import materialise

#: Bits of monotonically_increasing_id that number the rows inside one partition.
ROW_BITS = 33


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of ``cells`` (n x d, each below 2**bits).

    Gray-code form of the curve: undo the excess rotations from the highest bit to the lowest,
    Gray-encode across dimensions, then interleave the bits.
    """
    x = [cells[:, i].astype(np.uint64).copy() for i in range(cells.shape[1])]
    d, one = len(x), np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        low = q - one
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        flip ^= np.where((x[d - 1] & q) != 0, q - one, np.uint64(0))
    index = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << one) | (((x[i] ^ flip) >> np.uint64(bit)) & one)
    return index.astype(np.int64)


def add_key(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with a double that follows the order of a column: numbers as they are, strings by the place of their value.

    Distinct values are sorted and written with ascending numbers, so values that begin alike differ, however many there are.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(to, F.col(column).cast("double"))
    value = fresh(df, "value_")
    distinct = df.select(F.col(column).alias(value)).filter(F.col(value).isNotNull()).distinct()
    placed = distinct.repartitionByRange(value).sortWithinPartitions(value).select(value, F.monotonically_increasing_id().cast("double").alias(to))
    return df.join(materialise(placed, "places"), F.col(column) == F.col(value), "left").drop(value)


def cuts(df: DataFrame, keys: Sequence[str], bits: int, accuracy: int = 10_000) -> list[list[float]]:
    """For each key column the inner borders of its 2**bits quantile cells, from one mergeable sketch pass over all rows."""
    n = 2**bits
    share = [i / n for i in range(1, n)]
    row = df.agg(*[F.percentile_approx(F.col(k), share, accuracy).alias(f"q{i}") for i, k in enumerate(keys)]).first()
    return [sorted(set(row[i] or [])) for i in range(len(keys))]


def hilbert_shards(
    df: DataFrame,
    dims: Sequence[str],
    shards: int = 16,
    bits: int = 6,
    ties: Sequence[str] = (),
    shard: str = "shard",
    slot: str = "slot",
) -> DataFrame:
    """Put every row into one of ``shards`` runs of the Hilbert order of ``dims``; adds ``shard`` and ``slot``.

    Law ``rows``: shard sizes differ by at most one row; slots of a shard run from 0 without gaps.
    Null metadata goes to cell 0; ties on the curve are ordered by ``ties`` and then by all other
    orderable columns, so equal rows are interchangeable.  An empty table gives no rows.  A column
    called like ``shard`` or ``slot`` is replaced.  ``df`` should be narrow: it is sorted once and
    written once to the shared folder.
    """
    df = df.drop(shard, slot)
    kept = list(df.columns)
    keys, keyed = [], df
    for d in dims:
        keys.append(fresh(keyed, f"key_{d}"))
        keyed = add_key(keyed, d, keys[-1])
    borders = cuts(keyed, keys, bits)
    edges = [np.array(b, float) for b in borders]

    @F.arrow_udf("long")
    def curve(*columns: pa.Array) -> pa.Array:
        cells = np.zeros((len(columns[0]), len(columns)), np.uint64)
        for i, c in enumerate(columns):
            v = c.to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(v)
            # Few cells are spread over the whole range, so that every dimension has its say in the curve's first bits.
            cells[known, i] = np.searchsorted(edges[i], v[known], side="right") * 2**bits // (len(edges[i]) + 1)
        return pa.array(hilbert_index(cells, bits), pa.int64())

    h, mark = fresh(keyed, "hilbert"), fresh(keyed, "mark")
    rest = [c for c in kept if c not in ties and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    order = [h, *ties, *rest]
    ranged = keyed.withColumn(h, curve(*[F.col(k) for k in keys])).drop(*keys).repartitionByRange(*order).sortWithinPartitions(*order)
    # The table is written before rows are counted: range borders are sampled anew by each job.
    ordered = materialise(ranged.withColumn(mark, F.monotonically_increasing_id()), "hilbert")
    part = F.shiftright(F.col(mark), ROW_BITS)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*")).collect())  # a row for each task
    total, before, start = sum(n for _, n in counts), {}, 0
    for p, n in counts:
        before[p], start = start, start + n
    offsets = F.create_map(*[F.lit(x) for p in before.items() for x in p]) if len(before) <= 512 else None
    local = F.col(mark).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    if not before:
        rank = F.lit(0).cast("long")
    elif offsets is not None:
        rank = offsets[part] + local
    else:
        at = df.sparkSession.createDataFrame(list(before.items()), "p_at long, p_before long")
        ordered = ordered.join(F.broadcast(at), part == F.col("p_at"))  # as many rows as sort tasks
        rank = F.col("p_before") + local
    small, larger = divmod(total, shards)
    border = larger * (small + 1)  # the first `larger` shards have one row more
    which = F.when(rank < border, F.floor(rank / (small + 1))).otherwise(larger + F.floor((rank - border) / max(small, 1))).cast("int")
    first = F.when(rank < border, F.floor(rank / (small + 1)) * (small + 1)).otherwise(border + F.floor((rank - border) / max(small, 1)) * small)
    return ordered.select(*kept, which.alias(shard), (rank - first).cast("long").alias(slot))


def shard_summary(df: DataFrame, dims: Sequence[str], shard: str = "shard") -> DataFrame:
    """Rows, minimum and maximum of each dimension by shard: the statistics with which shards are pruned."""
    return df.groupBy(shard).agg(F.count("*").alias("n_rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
