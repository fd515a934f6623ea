"""Answering questions: retrieve, judge, order, and tell it as events.  One plan answers all requests of a frame.

Models are function arguments: ``rewrite`` makes a question of a conversation, ``judge`` adds verdicts to candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import retrieval
from quarry.sources.tables import materialise, united

Judge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Widths:
    """Candidates a channel, candidates that are judged, kept a batch, batches, results; null is no limit."""

    retrieve: int = 10
    judge: int | None = None
    keep: int | None = 3
    batches: int = 3
    results: int | None = None
    least: int = 60


def last_questions(requests: DataFrame, most: int = 5) -> DataFrame:
    """The offline rewrite: a question after others is read with the last five of them."""
    before = F.slice(F.reverse(F.coalesce("previous", F.array().cast("array<string>"))), 1, most)
    return requests.withColumn("question", F.when(F.size(before) > 0, F.concat_ws(" ", F.array_join(F.reverse(before), " "), "question")).otherwise(F.col("question")))


MODES = ("list", "summarize", "generate")
CHANNELS = ("vector", "bm25", "compare")


def parse_requests(bodies: DataFrame, body: str = "body", defaults: Widths = Widths()) -> DataFrame:
    """Typed requests of JSON bodies (query_id, body), with an ``error`` where a value is refused.

    Members of ``prefer`` come before those of the body.  A query may be a text or an object (text, site); the sites ``all`` and '' are none;
    earlier questions are a list, a list as text, or one text.  Widths that are given must be whole and 1 at least; nothing is
    replaced in silence.
    """
    v = F.try_parse_json(body)
    at = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    asked = lambda name: F.coalesce(at(f"prefer.{name}"), at(name))
    nested = F.schema_of_variant(F.try_variant_get(v, "$.query", "variant")).startswith("OBJECT")
    question = F.trim(F.coalesce(F.when(nested, at("query.text")).otherwise(at("query")), F.lit("")))
    site = F.when(nested, at("query.site")).otherwise(at("site"))
    lists = F.coalesce(*[at(p, "array<string>") for p in ("previous_queries", "context.prev", "prev")])
    word = F.coalesce(*[at(p) for p in ("previous_queries", "context.prev", "prev")])
    previous = F.coalesce(lists, F.from_json(F.when(word.startswith("["), word), "array<string>"), F.when(F.coalesce(word, F.lit("")) != "", F.array(word)), F.array().cast("array<string>"))
    channel, mode = F.coalesce(asked("retrieval"), F.lit("compare")), F.coalesce(asked("mode"), at("generate_mode"), F.lit("summarize"))
    widths = {k: F.nullif(asked(k), F.lit("")) for k in ("retrieval_count", "ranking_count")}
    refused = [(v.isNull(), F.lit("the body is no JSON")), (~channel.isin(*CHANNELS), F.lit("retrieval must be vector, bm25, or compare")), (~mode.isin(*MODES), F.concat(F.lit("unknown mode "), mode))]
    for k, w in widths.items():
        whole = w.try_cast("int")
        refused += [(w.isNotNull() & whole.isNull(), F.lit(f"{k} must be an integer")), (whole < 1, F.lit(f"{k} must be at least 1"))]
    number = lambda name, default: F.coalesce(asked(name).try_cast("int"), F.lit(default).cast("int"))
    error = F.coalesce(*[F.when(c, why) for c, why in refused])
    return bodies.select(
        "query_id", question.alias("question"), F.when(~site.isin("", "all"), site).alias("site"), mode.alias("mode"), previous.alias("previous"), channel.alias("retrieval"), number("max_results", defaults.results).alias("max_results"), number("min_score", defaults.least).alias("min_score"),
        *[w.try_cast("int").alias(k) for k, w in widths.items()], F.coalesce(asked("include_excluded").try_cast("boolean"), F.lit(False)).alias("include_excluded"), error.alias("error"),
    )


def valid(requests: DataFrame) -> Column:
    return F.trim(F.coalesce("question", F.lit(""))) != ""


def candidates(requests: DataFrame, documents: DataFrame, index: retrieval.Index, widths: Widths, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, bm25_score, vector_score, channel, arrival): lexical candidates, then vector candidates that are new.

    A request's site is matched before ranking; documents without a query word count 0 and fill up the candidates.
    """
    sites = requests.select("query_id", F.nullif(F.col("site"), F.lit("all")).alias("site"))
    placed = documents.select("id", "site")
    lexical = retrieval.bm25f(index, retrieval.query_terms(requests))
    if vectors is None:
        out = retrieval.top_k(lexical, widths.retrieve, placed, queries=sites).withColumn("channel", F.lit("bm25"))
    else:
        j = retrieval.vector_scores(vectors, query_vectors, weights).join(sites, "query_id").join(placed.withColumnRenamed("site", "at_"), "id")
        near = j.filter(F.col("site").isNull() | (F.col("site") == F.col("at_"))).select("query_id", "id", "score")
        out = retrieval.compare(lexical, near, widths.retrieve, scope=placed, queries=sites)
    order = Window.partitionBy("query_id").orderBy("channel", "rank")
    out = out.withColumn("arrival", F.row_number().over(order))
    if widths.judge is not None:
        out = out.filter(F.col("arrival") <= widths.judge)
    by = lambda c: F.when(F.col("channel") == c, F.col("score"))
    return out.select("query_id", "id", by("bm25").alias("bm25_score"), by("vector").alias("vector_score"), "channel", "arrival")


def judged(cands: DataFrame, documents: DataFrame, judge: Judge | None, widths: Widths, include_excluded: bool = False) -> DataFrame:
    """Candidates with a score; without a judge from retrieval alone, else by verdict, at most ``keep`` a batch."""
    # Written, so that their number is known before documents are read: few of them are broadcast, and no text is moved.
    full = materialise(cands, "candidates").join(documents.select("id", "url", "name", "site", "description"), "id")
    if judge is None:
        return full.withColumn("score", retrieval.retrieval_score(F.col("vector_score"), F.col("bm25_score"))).withColumn("relevance", F.lit("retrieval"))
    dealt = retrieval.round_robin(full, widths.batches, order="arrival")
    told = judge(dealt).withColumn("score", retrieval.parse_verdict(F.col("verdict"), widths.least).cast("int"))
    if include_excluded:
        return told.withColumn("relevance", F.when(F.col("score").isNull(), "exclude").otherwise(retrieval.relevance_band(F.col("score")))).withColumn("score", F.coalesce("score", F.lit(0)))
    good = told.filter("score is not null").withColumn("relevance", retrieval.relevance_band(F.col("score")))
    if widths.keep is None:
        return good
    w = Window.partitionBy("query_id", "batch").orderBy("arrival")
    return good.withColumn("of_batch", F.row_number().over(w)).filter(F.col("of_batch") <= widths.keep).drop("of_batch")


def ask(requests: DataFrame, documents: DataFrame, index: retrieval.Index, judge: Judge | None = None, rewrite: Callable[[DataFrame], DataFrame] = last_questions, widths: Widths = Widths(), include_excluded: bool = False, **vectors: object) -> DataFrame:
    """Results of every valid request (query_id, question, site, previous) in their final order (``position``)."""
    asked = rewrite(requests.filter(valid(requests)))
    got = judged(candidates(asked, documents, index, widths, **vectors), documents, judge, widths, include_excluded)
    if not include_excluded:
        got = retrieval.drop_same_names(retrieval.band_order(got).drop("arrival").withColumnRenamed("position", "arrival"))
    out = retrieval.band_order(got.drop("band"))
    return out if widths.results is None else out.filter(F.col("position") <= widths.results)


def answer(results: DataFrame) -> DataFrame:
    """The plain answer of each query: its first four names and first three descriptions."""
    top = results.filter("position <= 4").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "name", "description"))).alias("r"))
    names = F.array_join(F.transform("r", lambda x: x["name"]), ", ")
    about = F.array_join(F.slice(F.filter(F.transform("r", lambda x: x["description"]), lambda d: F.coalesce(d, F.lit("")) != ""), 1, 3), " ")
    return top.select("query_id", F.concat_ws(" ", F.concat(F.lit("The most relevant records are "), names, F.lit(".")), F.nullif(about, F.lit(""))).alias("answer"))


def events(requests: DataFrame, cands: DataFrame, results: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """The stream of each request (query_id, sequence, type, payload): start, candidates, results, answer, end; or an error."""
    js = lambda *c: F.to_json(F.struct(*c))
    ok = valid(requests)
    parts = [
        requests.filter(ok).select("query_id", F.lit(0).alias("phase"), F.lit(0).alias("at"), F.lit("start").alias("type"), js("question").alias("payload")),
        requests.filter(~ok).select("query_id", F.lit(0), F.lit(0), F.lit("error"), F.lit('{"message":"empty query"}')),
        cands.select("query_id", F.lit(1), "arrival", F.lit("candidate"), js("id", "channel")),
        results.select("query_id", F.lit(2), "position", F.lit("result"), js("id", "name", "score", "relevance")),
        requests.filter(ok).select("query_id", F.lit(4), F.lit(0), F.lit("end"), F.lit("{}")),
    ]
    if answers is not None:
        parts.append(answers.select("query_id", F.lit(3), F.lit(0), F.lit("answer"), js("answer")))
    out = united(*[p.toDF("query_id", "phase", "at", "type", "payload") for p in parts])
    w = Window.partitionBy("query_id").orderBy("phase", "at")
    return out.select("query_id", F.row_number().over(w).alias("sequence"), "type", "payload")


def latest_shown(provisional: DataFrame) -> DataFrame:
    """What a reader sees of streamed results (query_id, url, site, name, sequence, final): the last of each address, a final one over others."""
    key = F.coalesce(F.nullif("url", F.lit("")), F.concat("site", F.lit(":"), "name"))
    w = Window.partitionBy("query_id", "key").orderBy(F.col("final").desc(), F.col("sequence").desc())
    return provisional.withColumn("key", key).withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")
