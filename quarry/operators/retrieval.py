"""Fielded lexical retrieval, per-field vector retrieval, and what happens to results.

The index is three tables (postings, document frequencies, field statistics) that can be kept as Parquet; many
queries are answered by one job.  Only query terms and statistics of a field are small; neither documents nor postings
are ever broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.functions import values as V
from quarry.sources.tables import materialise, united

#: Bits of monotonically_increasing_id that number the rows inside one partition.
ROW_BITS = 33


@dataclass(frozen=True)
class Index:
    """``postings`` (id, field, token, tf, len), ``terms`` (token, df), ``stats`` (field, avg_len), ``documents`` (id), and their number."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    documents: DataFrame


#: Asked tokens up to which they are broadcast.
BROADCAST_TOKENS = 1 << 20


def asked_only(tokens: DataFrame, only: DataFrame | None) -> DataFrame:
    """Rows of ``tokens`` with a token of ``only``, if that is given."""
    if only is None:
        return tokens
    wanted = only.select("token").distinct()
    return tokens.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TOKENS else wanted, "token", "left_semi")


def build_index(df: DataFrame, id_col: str, fields: Sequence[str], only: DataFrame | None = None) -> Index:
    """Postings of each field; a term's documents are counted once across all fields; a field's mean length is over non-empty ones.

    With ``only`` (token) postings and frequencies of these tokens alone are made: for a few questions tokens are left out in the
    scan, before anything is shuffled.  Lengths and statistics are those of whole fields.
    """
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), X.tokens(F.col(f)).alias("toks")) for f in fields])).alias("x")).select("id", "x.field", "x.toks")
    sized = long.select("id", "field", "toks", F.size("toks").alias("len")).filter("len > 0")
    tokens = asked_only(sized.select("id", "field", "len", F.explode("toks").alias("token")), only)
    postings = tokens.groupBy("id", "field", "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    terms = postings.select("token", "id").distinct().groupBy("token").agg(F.count("*").alias("df"))
    stats = sized.groupBy("field").agg(F.avg("len").alias("avg_len"))
    return Index(postings, terms, stats, df.select(F.col(id_col).alias("id")))


def query_terms(queries: DataFrame, id_col: str = "query_id", text: str = "question") -> DataFrame:
    """(query_id, token, times): a repeated word counts twice."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(X.query_tokens(F.col(text))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def weight_of(field: Column, weights: Mapping[str, float]) -> Column:
    """A field's weight; fields that nobody weighted count 1."""
    known = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(known, field), F.lit(1.0))


def matched(index: Index, terms: DataFrame, b: Mapping[str, float] | None = None) -> DataFrame:
    """(query_id, id, token, field, tf, idf, times) of asked postings, tf being the count normalised by the field's length."""
    n = index.documents.agg(F.count("*").alias("n"))
    asked = terms.join(index.terms, "token").crossJoin(F.broadcast(n)).select("query_id", "token", "times", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # n is one row
    share = weight_of(F.col("field"), b) if b else F.lit(V.BM25F_B)
    norm = 1 - share + share * F.col("len") / F.col("avg_len")
    hits = index.postings.join(asked, "token").join(F.broadcast(index.stats), "field")  # a row for each field
    return hits.select("query_id", "id", "token", "field", (F.col("tf") / norm).alias("tf"), "idf", "times")


def bm25f(index: Index, terms: DataFrame, weights: Mapping[str, float] = V.FIELD_WEIGHTS, b: Mapping[str, float] | None = None, k1: float = V.BM25F_K1) -> DataFrame:
    """(query_id, id, score) of documents with a query term.

    Term frequencies are weighted and normalised by field and added up, and then saturated once: a sum of
    scores by field would reward a word for being everywhere.
    """
    w = weight_of(F.col("field"), weights)
    summed = matched(index, terms, b).filter(w != 0).groupBy("query_id", "id", "token").agg(F.sum(w * F.col("tf")).alias("tf"), F.first("idf").alias("idf"), F.first("times").alias("times"))
    return summed.groupBy("query_id", "id").agg(F.sum(F.col("times") * F.col("idf") * F.col("tf") / (F.lit(k1) + F.col("tf"))).alias("score"))


def bm25f_grid(index: Index, terms: DataFrame, grid: Mapping[str, Mapping[str, float]], b: Mapping[str, float] | None = None, k1: float = V.BM25F_K1) -> DataFrame:
    """(config, query_id, id, score): the rows of ``bm25f`` under every set of weights of ``grid``, from one pass over the postings.

    A column for each set is summed beside the others, by token and then by document, so the shuffles don't grow in rows with the grid;
    sets come apart only where a document's scores are complete.  A document without a hit in a weighted field has no row in that set.
    """
    if not grid:
        raise ValueError("a grid needs a set of weights")
    at = [f"s{i}_" for i in range(len(grid))]
    terms_of = []
    for name, weights in zip(at, grid.values(), strict=True):
        w = weight_of(F.col("field"), weights)
        terms_of.append(F.sum(F.when(w != 0, w * F.col("tf"))).alias(name))
    summed = matched(index, terms, b).groupBy("query_id", "id", "token").agg(*terms_of, F.first("idf").alias("idf"), F.first("times").alias("times"))
    scores = summed.groupBy("query_id", "id").agg(*[F.sum(F.col("times") * F.col("idf") * F.col(c) / (F.lit(k1) + F.col(c))).alias(c) for c in at])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("config"), F.col(c).alias("score")) for name, c in zip(grid, at, strict=True)]))
    return scores.select("query_id", "id", each.alias("x")).select("x.config", "query_id", "id", "x.score").filter("score is not null")


def flat_bm25(index: Index, terms: DataFrame, fields: Sequence[str]) -> DataFrame:
    return bm25f(index, terms, dict.fromkeys(fields, 1.0))


def eval_bm25(df: DataFrame, id_col: str, fields: Sequence[str], queries: DataFrame, boosts: Mapping[str, float] = V.EVAL_BOOSTS, k1: float = V.EVAL_K1, b: float = V.EVAL_B) -> DataFrame:
    """The evaluation's own index: boosts multiply counts, lengths are sums of boosted counts, their mean includes empty documents.

    (query_id, id, score) with scores above 0, to four places.
    """
    used = [f for f in fields if boosts.get(f)]
    counted = F.array(*[F.struct(F.lit(float(boosts[f])).alias("boost"), X.rich_tokens(F.col(f)).alias("toks")) for f in used])
    length = F.aggregate("x", F.lit(0.0), lambda acc, f: acc + f["boost"] * F.size(f["toks"]))
    sized = df.select(F.col(id_col).alias("id"), counted.alias("x")).withColumn("len", length)
    mean = sized.agg(F.count("*").alias("n"), (F.sum("len") / F.count("*")).alias("avg_len"))  # one row
    terms = queries.select("query_id", F.explode(X.rich_tokens(F.col("question"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    tokens = asked_only(sized.select("id", "len", F.explode("x").alias("f")).select("id", "len", "f.boost", F.explode("f.toks").alias("token")), terms)
    counts = tokens.groupBy("id", "token").agg(F.sum("boost").alias("tf"), F.first("len").alias("len"))
    dfs = counts.groupBy("token").agg(F.count("*").alias("df"))
    hits = counts.join(terms.join(dfs, "token").crossJoin(F.broadcast(mean)), "token")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 4).alias("score")).filter("score > 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def blocks(queries: DataFrame, most: int) -> list[DataFrame]:
    """``queries`` as frames of at most ``most`` rows.

    More than ``most`` are numbered and written first; a block is a range of these numbers, which begin anew (at 0) in each partition.
    """
    if queries.limit(most + 1).count() <= most:
        return [queries]
    held = materialise(queries.withColumn("row_", F.monotonically_increasing_id()), "queries")
    starts, seen = [], 0
    for p, n in sorted((r[0], r[1]) for r in held.groupBy(F.shiftright("row_", ROW_BITS)).agg(F.count("*")).collect()):  # a row for each task
        starts += [(p << ROW_BITS) + i for i in range(-seen % most, n, most)]
        seen += n
    ends = [*starts[1:], (1 << 63) - 1]
    return [held.filter((F.col("row_") >= lo) & (F.col("row_") < hi)).drop("row_") for lo, hi in zip(starts, ends, strict=True)]


def block_scores(vectors: DataFrame, queries: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "id", most_queries: int = 10_000) -> list[DataFrame]:
    """The rows of ``vector_scores``, as a frame for each block of queries."""
    parts = weights or {"embedding": 1.0}
    score = reduce(lambda a, c: a + c, [F.lit(float(w)) * F.coalesce(dot(F.col(f), F.col("vector")), F.lit(0.0)) for f, w in parts.items() if w], F.lit(0.0))
    return [vectors.crossJoin(F.broadcast(q)).select("query_id", F.col(id_col).alias("id"), score.alias("score")) for q in blocks(queries.select("query_id", "vector"), most_queries)]


def field_vectors(df: DataFrame, id_col: str, fields: Sequence[str], embed: Callable[[Column], Column], dims: int) -> DataFrame:
    """(id, a vector for each field): what ``embed`` makes of its text; an empty field has zeros, which add nothing to a score."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    return df.select(F.col(id_col).alias("id"), *[F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", zeros).otherwise(embed(F.col(f))).alias(f) for f in fields])


def vector_scores(vectors: DataFrame, queries: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "id", most_queries: int = 10_000) -> DataFrame:
    """(query_id, id, score): products of each query's vector with every document's, a weighted sum over field columns.

    ``vectors`` has a vector column for each field of ``weights`` (a zero or null vector adds nothing), or ``embedding``.
    ``queries`` (query_id, vector) are broadcast in blocks of at most ``most_queries``, however many there are.
    """
    return united(*block_scores(vectors, queries, weights, id_col, most_queries))


#: Products that a task has at a time.
PRODUCTS = 1 << 22


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of doubles; one that is null, of another length or holds a null is zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    out = np.zeros((len(column), dims))
    own = column.filter(sized).flatten()
    whole = own.to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.zeros((pc.sum(sized).as_py() or 0, 0))
    if own.null_count:
        whole = np.where(own.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims).any(axis=1)[:, None], 0.0, whole)
    out[sized.to_numpy(zero_copy_only=False)] = whole
    return out


class Best:
    """The best k of each query so far: places, scores and rows' ids by query."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.query, self.score, self.least = np.zeros(0, np.int64), np.zeros(0), np.full(n, -np.inf)
        self.ids: pa.Array | None = None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of some rows (queries by rows): those that may be among the best join, and all are cut to k again."""
        key = np.nan_to_num(scores, nan=np.inf, posinf=np.inf, neginf=-np.inf)  # as in Spark's order, NaN is the largest
        low = self.least
        if scores.shape[1] > self.k:
            low = np.maximum(low, np.partition(key, -self.k, axis=1)[:, -self.k])
        query, row = np.nonzero(key >= low[:, None])
        self.ids = ids.take(pa.array(row)) if self.ids is None else pa.concat_arrays([self.ids, ids.take(pa.array(row))])
        self.query, self.score = np.concatenate([self.query, query]), np.concatenate([self.score, scores[query, row]])
        tie = pc.rank(self.ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        key = np.where(np.isnan(self.score), np.inf, self.score)
        order = np.lexsort((tie, -key, self.query))
        first = np.searchsorted(self.query[order], self.query[order], side="left")
        kept = order[np.arange(len(order)) - first < self.k]
        self.query, self.score, self.ids = self.query[kept], self.score[kept], self.ids.take(pa.array(kept))
        full = np.bincount(self.query, minlength=len(self.least)) == self.k
        last = np.append(self.query[1:] != self.query[:-1], True)[: len(self.query)]
        ends = np.full(len(self.least), -np.inf)
        ends[self.query[last]] = np.where(np.isnan(self.score), np.inf, self.score)[last]
        self.least = np.where(full, ends, -np.inf)


def best_of_block(vectors: DataFrame, queries: DataFrame, k: int, weights: Mapping[str, float], id_col: str, places: int) -> DataFrame:
    """(query_id, id, score): the best k of each query in each task's rows.

    A task multiplies blocks of its vectors with the matrix of all queries of the block, which is broadcast, and sends no
    more than k rows a query, however many it reads.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).collect()  # a block has a bounded number
    dims = max((len(q.vector) for q in asked if q.vector is not None), default=0)
    table = np.array([q.vector if q.vector is not None and len(q.vector) == dims and None not in q.vector else [0.0] * dims for q in asked], float).reshape(len(asked), dims)
    shared = vectors.sparkSession.sparkContext.broadcast(table)
    fields = [(f, float(w)) for f, w in weights.items() if w]
    id_type = vectors.schema[id_col].dataType

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_, best = shared.value, Best(len(shared.value), k)
        rows = max(1, PRODUCTS // max(1, len(asked_)))
        for batch in batches:
            for at in range(0, batch.num_rows if len(asked_) else 0, rows):
                part = batch.slice(at, rows)
                scores = np.zeros((len(asked_), part.num_rows))
                for i, (_, w) in enumerate(fields, 1):
                    scores += w * (asked_ @ matrix(part.column(i), dims).T)
                best.add(np.round(scores, places), part.column(0))
        if best.ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best.query), best.ids, pa.array(best.score)], names=["place", "id", "score"])

    got = vectors.select(F.col(id_col).alias("id"), *[F.col(f).cast("array<double>") for f, _ in fields]).mapInArrow(multiply, T.StructType([T.StructField("place", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.DoubleType())]))
    names = vectors.sparkSession.createDataFrame([(i, q.query_id) for i, q in enumerate(asked)], T.StructType([T.StructField("place", T.LongType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
    return got.join(F.broadcast(names), "place").select("query_id", "id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, places: int = 9, weights: Mapping[str, float] | None = None, id_col: str = "id", most_queries: int = 10_000) -> DataFrame:
    """(query_id, id, score): the best k of ``vector_scores`` for each query, scores rounded before they are ranked, ties to the smaller id.

    Every task keeps the best k of its own rows, and these are merged; blocks of queries are reduced before they are united.
    The queries of a block have one length; a vector that is null, of another length or holds a null has a product of 0.
    """
    parts = weights or {"embedding": 1.0}
    best = [top_k(best_of_block(vectors, q, k, parts, id_col, places), k).drop("rank") for q in blocks(queries.select("query_id", "vector"), most_queries)]
    return united(*best)


def top_k(scores: DataFrame, k: int, scope: DataFrame | None = None, exclude: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """The best k a query, by score and then id, with their rank.

    With ``scope`` (id, and ``site`` if queries ask for one), only its documents are returned, and those without a score count 0 and
    fill up the k in order of id, for queries without any hit too if ``queries`` (query_id, and ``site``; null: all) are given.
    ``exclude`` (query_id, id) is taken out before ranking.
    """
    if scope is not None:
        asked = (queries if queries is not None else scores).select("query_id", *(["site"] if queries is not None and "site" in queries.columns else [])).distinct()
        by_site = "site" in asked.columns
        held = scores.select("query_id", "id", "score")
        if by_site:
            placed = held.join(asked, "query_id").join(scope.select("id", F.col("site").alias("at_")), "id")
            held = placed.filter(F.col("site").isNull() | (F.col("site") == F.col("at_"))).select("query_id", "id", "score")
        else:
            held = held.join(scope.select("id"), "id", "left_semi")
        if exclude is not None:
            held = held.join(exclude, ["query_id", "id"], "left_anti")
        have = held.groupBy("query_id").agg(F.count("*").alias("have"))
        few = asked.join(have, "query_id", "left").filter(F.coalesce("have", F.lit(0)) < k).drop("have")
        # Of the ids in order, fewer than k are held by such a query, and no more are excluded than any query excludes.
        most = 2 * k + int(exclude.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0 if exclude is not None else 0)
        low = scope.select("id").orderBy("id").limit(most)
        if by_site:
            first = scope.select("id", "site").withColumn("n_", F.row_number().over(Window.partitionBy("site").orderBy("id"))).filter(F.col("n_") <= most).drop("n_")
            low = united(first.filter("site is not null"), low.withColumn("site", F.lit(None).cast("string")))
            pad = few.join(low.withColumnRenamed("site", "at_"), F.col("site").eqNullSafe(F.col("at_"))).select("query_id", "id")
        else:
            pad = few.crossJoin(F.broadcast(low))  # some 2 k rows
        if exclude is not None:
            pad = pad.join(exclude, ["query_id", "id"], "left_anti")
        pad = pad.join(held, ["query_id", "id"], "left_anti")
        scores = united(held, pad.select("query_id", "id", F.lit(0.0).alias("score")))
    elif exclude is not None:
        scores = scores.join(exclude, ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def compare(lexical: DataFrame, vector: DataFrame, k: int, cut: bool = False, scope: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Lexical top k, then the vector top k of what is left; no fusion.  ``cut`` keeps k in all; ``scope`` and ``queries`` fill the lexical k."""
    first = top_k(lexical, k, scope, queries=queries).withColumn("channel", F.lit("bm25"))
    second = top_k(vector, k, exclude=first.select("query_id", "id")).withColumn("channel", F.lit("vector"))
    both = united(first, second)
    if cut:
        place = Window.partitionBy("query_id").orderBy("channel", "rank")
        both = both.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).drop("place")
    return both


def similarity_score(v: Column) -> Column:
    """A cosine to 0 ... 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor((v + 1) * 50))).cast("int")


def retrieval_score(vector_score: Column, bm25_score: Column) -> Column:
    """The score of a candidate that no judge saw."""
    return F.when(vector_score.isNotNull(), similarity_score(vector_score)).otherwise(F.least(F.lit(100), F.floor(bm25_score * 5))).cast("int")


def parse_verdict(verdict: Column, least: int = 60) -> Column:
    """A judge's word or number to a score; null for what is to be left out."""
    word = F.lower(F.trim(verdict))
    number = F.greatest(F.lit(0), F.least(F.lit(100), word.try_cast("int")))
    return F.when(word == "strong", 90).when(word == "relevant", least).when(word.isin("exclude", "irrelevant", "none", "no"), None).otherwise(F.when(number >= least, number))


def join_verdicts(candidates: DataFrame, verdicts: DataFrame, order: str = "arrival") -> DataFrame:
    """``candidates`` (query_id, batch) with the ``verdict`` that a judge gave to their place in the batch, counted from 0 in ``order``.

    ``verdicts`` (query_id, batch, index: text, said: their order, verdict): the first of a place counts; places that no candidate has, and
    those that are no number, are dropped, and so are candidates without a verdict.
    """
    place = F.row_number().over(Window.partitionBy("query_id", "batch").orderBy(order)) - 1
    told = verdicts.withColumn("place_", F.col("index").try_cast("int")).filter("place_ is not null")
    first = told.groupBy("query_id", "batch", "place_").agg(F.min_by("verdict", "said").alias("verdict"))
    return candidates.withColumn("place_", place).join(first, ["query_id", "batch", "place_"]).drop("place_")


def bounded(value: Column, default: int, ceiling: int) -> Column:
    """A width: the default where none is asked for, else between 1 and the ceiling."""
    return F.when(value.isNull(), default).otherwise(F.least(F.greatest(value, F.lit(1)), F.lit(ceiling)))


def relevance_band(score: Column) -> Column:
    return F.when(score >= 90, "strong").otherwise("relevant")


def band_order(results: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Strong results before others, in order of arrival within a band."""
    w = Window.partitionBy(*by).orderBy((F.col("score") < 90).cast("int"), "arrival")
    return results.withColumn("band", relevance_band(F.col("score"))).withColumn("position", F.row_number().over(w))


def first_of_each(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The first row of each key; keys are hashed apart, so a common one is the only skew, and only narrow rows should come here."""
    w = Window.partitionBy(*by, *keys).orderBy(*order)
    return df.withColumn("nth_", F.row_number().over(w)).filter("nth_ = 1").drop("nth_")


def drop_same_names(results: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The first result of each site and name, names compared in lower case with white space squeezed."""
    return first_of_each(results, [F.col("site"), F.lower(X.squeeze(F.col("name")))], [F.col("arrival")], by)


def round_robin(candidates: DataFrame, batches: int | None = None, order: str = "rank", by: Sequence[str] = ("query_id",), batch_size: int = 10) -> DataFrame:
    """Deal candidates in order to ``batches`` batches (at most one a candidate), or to as many as batches of ``batch_size`` need."""
    w, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    n = F.count("*").over(whole)
    parts = F.least(F.lit(batches), n) if batches else F.ceil(n / batch_size)
    return candidates.withColumn("batch", F.pmod(F.row_number().over(w) - 1, parts).cast("int"))


def stub_judge(candidates: DataFrame, terms: DataFrame, fields: Sequence[str] = ("name", "description")) -> DataFrame:
    """An offline stand-in for a judging model: strong with two query words in the given fields, relevant with one, else exclude."""
    own = F.array_distinct(X.tokens(F.concat_ws(" ", *[F.col(f) for f in fields])))
    asked = terms.groupBy("query_id").agg(F.collect_set("token").alias("asked_"))  # of a query's length
    joined = candidates.join(asked, "query_id", "left")
    hits = F.size(F.array_intersect(own, F.coalesce("asked_", F.array().cast("array<string>"))))
    return joined.withColumn("verdict", F.when(hits >= 2, "strong").when(hits == 1, "relevant").otherwise("exclude")).drop("asked_")


def scope_filter(df: DataFrame, site: str | None, kinds: Mapping[str, str] | None = None) -> Column:
    """Whether an item (site, types) belongs to a collection, or to the aggregate scope ``models``."""
    if site is None:
        return F.lit(True)
    if site != "models":
        return F.col("site") == F.lit(site)
    model = F.arrays_overlap(F.coalesce(F.col("types"), F.array().cast("array<string>")), F.array(F.lit("hf:Model"), F.lit("SoftwareApplication")))
    if not kinds:
        return model
    declared = F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("site"))
    return F.when(declared.isNotNull(), declared == "models").otherwise(model)


def sites(documents: DataFrame) -> DataFrame:
    """The collections that documents belong to, once each, in order."""
    return documents.select("site").distinct().orderBy("site")


def hash_embedding(texts: Column, dims: int = 384) -> Column:
    """A deterministic stand-in for an embedding model: signed token counts at md5 places, of length 1; zeros for no tokens."""
    digest = lambda t: F.md5(t.cast("binary"))
    place = lambda t: F.pmod(F.conv(F.substring(digest(t), 1, 8), 16, 10).cast("long"), F.lit(dims))
    sign = lambda t: F.when(F.conv(F.substring(digest(t), 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    marks = F.transform(X.tokens(texts), lambda t: F.struct(place(t).alias("p"), sign(t).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(marks, lambda m: m["p"] == i), F.lit(0.0), lambda acc, m: acc + m["s"]))
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.transform(raw, lambda v: F.when(length > 0, v / length).otherwise(0.0))
