"""Importance resampling towards a target distribution.

Features are runs of words, hashed to buckets.  A bucket's gain is the log of its share in target texts over that in all texts;
a document's weight is the mean gain of its features.  Noise that depends on the document alone is added, and the highest
scores are drawn: a sample without replacement in proportion to the weights (the Gumbel trick).

Identical texts are collapsed first, by grouping on the full text: features and weight are computed once for each, counts are
multiplied by multiplicity, and weights are joined back to the documents by the text's SHA-256 before the noise is added.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import STATE, as_bytes, bound_batches, fresh, merged, release, state_of
from quarry.sources.tables import materialise

#: Buckets of features, and words of a feature at most.
BUCKETS, RUN = 10_000, 1
#: Documents of fewer words are never drawn; of the others, this many in a hundred are.
MIN_WORDS, PERCENT = 20, 10
SEED = 2024
#: Words that a worker remembers with their buckets.
MEMO_WORDS = 1 << 18
#: Bits of monotonically_increasing_id that number the rows inside one partition.
ROW_BITS = 33

#: All bytes of a word stay, A-Z in lower case; every other ASCII character is a gap.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_FOLD).split()


class Buckets(dict):
    """Buckets of features, remembered."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        b = zlib.crc32(feature) % self.n
        if len(self) < MEMO_WORDS:
            self[feature] = b
        return b


def feature_buckets(data: bytes | None, memo: Buckets, run: int = RUN) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to ``run`` consecutive words (repeats included)."""
    words = words_of(data)
    got = [memo[w] for w in words]
    for k in range(2, run + 1):
        got += [memo[b" ".join(words[i : i + k])] for i in range(len(words) - k + 1)]
    return len(words), np.array(got, np.int32)


def collapsed(df: DataFrame, text: str, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """One row for each different text: ``digest``, ``copies``, ``n_words``, ``n_features`` and ``features`` (buckets as 32-bit integers).

    Counting copies inside each task comes before the shuffle, so a text arrives once from each task, however many copies there are.
    A null text is an empty one.
    """
    bound_batches(df.sparkSession)
    alike = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).groupBy("t").agg(F.count("*").alias("copies"))
    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("features", pa.binary())])

    @F.arrow_udf("struct<n_words: long, n_features: long, features: binary>")
    def compute(texts: pa.Array) -> pa.Array:
        memo = Buckets(buckets)
        rows = []
        for data in as_bytes(texts):
            n, got = feature_buckets(data, memo, run)
            rows.append({"n_words": n, "n_features": len(got), "features": got.tobytes()})
        release()
        return pa.array(rows, kind)

    return alike.select(F.unhex(F.sha2("t", 256)).alias("digest"), "copies", compute.asNondeterministic()("t").alias("f")).select("digest", "copies", "f.*")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket, each text counted as often as it is there.  A task has one array of counts; arrays are added up a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.int32)
                if len(own) > buckets // 8:
                    total += np.bincount(own, minlength=buckets) * copies
                else:
                    np.add.at(total, own, copies)
        release()
        if total.any():
            yield state_of(total.astype(np.float64))  # exact up to 2^53

    bound_batches(features.sparkSession)
    total = merged(features.select("features", "copies").mapInArrow(count, STATE), np.add)
    return np.zeros(buckets, np.int64) if total is None else total.astype(np.int64)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of both smoothed shares, floored, by bucket."""
    n, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + n) / ((int(s) + 1) * (t_all + n)))) for s, t in zip(raw, target, strict=True)], np.int64)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the seed and the id alone; a null id counts as the word null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighted(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Per row of ``df``: id, n_words, n_features and weight."""
    own = materialise(collapsed(df, text, buckets, run), "features")
    gain = df.sparkSession.sparkContext.broadcast(gains(bucket_counts(own, buckets), bucket_counts(collapsed(target, target_text, buckets, run), buckets)))  # a long a bucket

    @F.arrow_udf("long")
    def weigh(features: pa.Array) -> pa.Array:
        rows = (np.frombuffer(f, np.int32) for f in features.to_pylist())
        return pa.array([int(gain.value[r].sum()) // len(r) if len(r) else 0 for r in rows], pa.int64())

    # Weights are narrow: the join moves an id and a digest for each document, and adaptive execution splits a text of many copies.
    weights = materialise(own.select("digest", "n_words", "n_features", weigh("features").alias("weight")), "weights")
    keyed = df.select(F.col(id_col).alias(id_col), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest_"))
    return keyed.join(weights, keyed["digest_"] == weights["digest"]).select(id_col, "n_words", "n_features", "weight")


def ranked(df: DataFrame, order: list[Column], to: str) -> DataFrame:
    """``df`` with a number from 1 in ``order``, which has to tell rows apart.  Range-sorted, written, then counted by partition."""
    mark = fresh(df, "mark_")
    ordered = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col(mark), ROW_BITS)
    counts, start, before = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect(), 0, []  # a row for each task
    for p, n in counts:
        before.append((p, start))
        start += n
    at, p_at, p_before = df.sparkSession.createDataFrame(before, "p long, b long"), fresh(ordered, "p_at_"), fresh(ordered, "p_before_")
    joined = ordered.join(F.broadcast(at.toDF(p_at, p_before)), part == F.col(p_at))  # as many rows as sort tasks
    return joined.select(*df.columns, (F.col(p_before) + F.col(mark).bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1).alias(to))


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, run: int = RUN
) -> DataFrame:
    """Per row of ``df``: id, n_features, weight, score and rank (1, 2, 3, ... of the drawn ones by falling score, then id; else null).

    A null or empty text has no words, weight 0, and is never drawn (unless ``min_words`` is 0).  Repeated rows are documents of
    their own with equal scores, in any order among themselves; null ids come first among equal scores.  An empty table gives
    no rows, an empty target smoothed counts of 0.  Other columns are ignored, whatever they are called.
    """
    row = "row_" if id_col != "row_" else "row__"
    scored = weighted(df, target, id_col, text, target_text, buckets, run).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    scored = materialise(scored.withColumn(row, F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= min_words
    # Scores are thousandths of logarithms: a few ten thousand different ones, however many rows there are.
    held = sorted(((r[0], r[1]) for r in scored.filter(able).groupBy("score").agg(F.count("*")).collect()), reverse=True)
    draw, seen, least = percent * sum(n for _, n in held) // 100, 0, None
    for score, n in held:
        if seen >= draw:
            break
        seen, least = seen + n, score
    plain = [F.col(c) for c in (id_col, "n_features", "weight", "score")]
    if least is None:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    near = able & (F.col("score") >= least)
    first = ranked(scored.filter(near), [F.desc("score"), F.asc(id_col), F.asc(row)], "rank")
    return scored.filter(~near).select(*plain, F.lit(None).cast("long").alias("rank")).unionByName(first.select(*plain, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")))
