"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to buckets.  Two multinomials over the buckets are counted: one of trusted
documents, one of the raw corpus.  A text's score is the mean over its n-grams of the log of their ratio
(importance weights of hashed n-grams, as published for data selection, divided by length).  A fixed
threshold, set from scores of trusted documents, decides about every document alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bound_batches, fresh, release
from quarry.sources.tables import materialise, remove

#: Buckets of n-grams.
BUCKETS = 1 << 15
#: Scores of trusted documents from which on the lowest are set apart before they are ordered.
TRUSTED = 20_000
#: Share of trusted documents that may score below the threshold, and how far below that the threshold lies.
TRUSTED_LOSS, MARGIN = 0.001, 0.05
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Fewer words fail, and so do more than this share of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def local_ids(words: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return ids, np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * n_distinct + ids[1:]
    if n_distinct >= 1 << 20:  # three numbers don't fit 63 bits: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * n_distinct + ids[2:], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def text_counts(data: bytes | None) -> tuple[tuple[int, ...], dict[bytes, int], np.ndarray]:
    """The counts of COUNTS, and the words' numbers."""
    data = data or b""
    words = data.split()
    ids, at = local_ids(words)
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    inside = b"".join(words)
    chars = len(inside) if inside.isascii() else len(inside.decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    return (len(words), chars, symbols, dup, repeated_words(at, len(ids))), ids, at


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(40)


def buckets_of(ids: dict[bytes, int], at: np.ndarray, n: int) -> np.ndarray:
    """Buckets of a text's words and then of its pairs of neighbouring words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))[at] if len(at) else np.zeros(0, np.uint64)
    pair = (h[:-1] * _MIX + h[1:]) * _MIX
    return (np.concatenate([h, pair]) * _MIX >> _SHIFT).astype(np.int64) % n


@dataclass(frozen=True)
class Model:
    """Log ratios by bucket and the least score that is kept."""

    ratio: np.ndarray
    threshold: float

    def score(self, ids: dict[bytes, int], at: np.ndarray) -> float:
        if not len(at):
            return 0.0
        return float(self.ratio[buckets_of(ids, at, len(self.ratio))].mean())


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids (trusted_id) of all good, non-toxic documents, each once; ``labels`` has its id as ``id_``."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    return good.select(F.col("id_").alias("trusted_id")).filter("trusted_id is not null").distinct()


def nth_score(scores: DataFrame, share: float, many: int = TRUSTED) -> float | None:
    """The score that stands at ``share`` of all scores in order, exactly; null if there are none.

    Of many scores an approximate quantile first sets the lowest apart, which a count confirms, so that no task orders all.
    """
    n = scores.count()
    if not n:
        return None
    at = int(share * n)
    if n > many:
        near = scores.agg(F.percentile_approx("score", min(1.0, 2 * share + 0.001), 10_000)).first()[0]
        low = scores.filter(F.col("score") <= F.lit(near))
        scores = low if low.count() > at else scores
    return scores.orderBy("score").offset(at).limit(1).first()[0]


def ngram_counts(df: DataFrame, text: str, n: int = BUCKETS) -> np.ndarray:
    """N-grams of all texts by bucket.  A task sends its non-zero buckets once, whatever it reads; the driver gets at most ``n`` sums."""

    def count(batches):
        sums = np.zeros(n, np.int64)
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                ids, at = local_ids((data or b"").split())
                where = buckets_of(ids, at, n)
                if len(at) > n // 8:
                    sums += np.bincount(where, minlength=n)
                else:
                    np.add.at(sums, where, 1)
        release()
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    bound_batches(df.sparkSession)
    out = np.zeros(n)
    for bucket, total in df.select(F.col(text)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most n rows
        out[bucket] = total
    return out


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = BUCKETS, loss: float = TRUSTED_LOSS, margin: float = MARGIN, many: int = TRUSTED) -> Model:
    """Count both multinomials, over every document and over every trusted one, and set the threshold by all trusted scores.

    The driver gets ``n`` sums of each and one score, however large the corpus is.  Without trusted documents all scores
    are 0 and all are kept.
    """
    good_ids = trusted_ids(labels.select(F.col(id_col).alias("id_"), "quality", "toxic"))
    # Labels grow with documents, so the join shuffles; trusted texts are written, as both passes over them need them.
    known = materialise(df.select(F.col(id_col).alias("trusted_of"), F.col(text).alias("text_")).join(good_ids.hint("shuffle_hash"), F.col("trusted_of") == F.col("trusted_id"), "left_semi"), "trusted")
    good = ngram_counts(known, "text_", n)
    if not good.sum():
        remove(known)
        return Model(np.zeros(n), 0.0)
    raw = ngram_counts(df, text, n)
    share = [(v + SMOOTHING) / (v.sum() + SMOOTHING * n) for v in (good, raw)]
    ratio = np.log(share[0] / share[1])
    # Failed rows are left out here and not by a filter, which would have texts scored twice.
    rated = apply(known, Model(ratio, 0.0), "text_", "q").groupBy("trusted_of").agg(F.min(F.when(~F.col("q.base_failed"), F.col("q.score"))).alias("score"))  # one of rows with an id
    scores = materialise(rated.select("score").filter("score is not null"), "scores")
    least = nth_score(scores, loss, many)
    remove(known, scores)
    return Model(ratio, float("-inf") if least is None else float(least) - margin)


def apply(df: DataFrame, model: Model, text: str = "text", quality: str = "quality_") -> DataFrame:
    """``df`` with a struct: the counts, base_failed, the score and ``kept``."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # one double a bucket
    kind = pa.struct([*[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    @F.arrow_udf("struct<" + ", ".join(f"{c}: long" for c in COUNTS) + ", base_failed: boolean, score: double, kept: boolean>")
    def rate(texts: pa.Array) -> pa.Array:
        rows = []
        for data in as_bytes(texts):
            counts, ids, at = text_counts(data)
            failed = base_failed(counts[0], counts[4])
            score = shared.value.score(ids, at)
            rows.append({**dict(zip(COUNTS, counts, strict=True)), "base_failed": failed, "score": score, "kept": not failed and score >= shared.value.threshold})
        release()
        return pa.array(rows, kind)

    return df.withColumn(quality, rate.asNondeterministic()(F.col(text)))  # never evaluated twice, nor moved below a join


def rate_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """Per row: id, counts, base_failed, score and kept.

    A null or empty text has no words, fails and scores 0.  Repeated rows are counted and returned each; an empty table
    gives no rows; other columns are ignored.  A repeated or null label id counts once or not at all.
    """
    narrow = df.select(F.col(id_col), F.col(text))
    return apply(narrow, fit(narrow, labels, id_col, text, **options), text, "q").select(F.col(id_col), "q.*")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """``df`` without the rows that the rules reject."""
    mark = fresh(df, "quality_")
    return apply(df, fit(df.select(F.col(id_col), F.col(text)), labels, id_col, text, **options), text, mark).filter(F.col(f"{mark}.kept")).select(*df.columns)
