"""Retrieval metrics, agreement of judges, and usage of models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.sources.tables import united

LABELS = ("strong", "relevant", "exclude")


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def rank_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, depth: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Per query: gold, P@k, reciprocal rank, nDCG@k and trap rate under binary gain.

    ``ranked`` (query_id, id, rank), ``gold`` (query_id, id, is_gold, is_trap), ``queries`` (query_id).  Precision divides by
    the depth; the ideal has as many hits as gold or depth allow.  ``by``: columns of ``ranked`` and ``queries`` that tell several
    rankings of a query apart; gold holds for all of them.
    """
    hits = ranked.filter(F.col("rank") <= depth).join(gold, ["query_id", "id"], "left")
    g, t = F.coalesce("is_gold", F.lit(False)), F.coalesce("is_trap", F.lit(False))
    found = hits.groupBy(*by, "query_id").agg(
        F.sum(g.cast("int")).alias("hits"), F.min(F.when(g, F.col("rank"))).alias("first"), F.sum(F.when(g, discount(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.sum(t.cast("int")).alias("traps")
    )
    sizes = gold.groupBy("query_id").agg(F.sum(F.col("is_gold").cast("int")).alias("gold"))
    all_ = queries.select(*by, "query_id").join(sizes, "query_id", "left").join(found, [*by, "query_id"], "left").na.fill(0, ["gold", "hits", "dcg", "traps"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("gold", F.lit(depth)), F.lit(1))), F.lit(0.0), lambda acc, r: acc + discount(r))
    return all_.select(
        *by,
        "query_id",
        F.col("gold").cast("long").alias("gold"),
        (F.col("hits") / depth).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("gold") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        (F.col("traps") / depth).alias("trap_rate"),
    )


def summarise(metrics: DataFrame, n_documents: Column, broad: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Means by category (of each ``by``), and over all queries that discriminate (gold of at most ``broad`` of the corpus).  Known items always count in theirs."""
    keep = F.col("gold") <= F.floor(n_documents * broad)
    kinds = F.array_compact(F.array(F.when(F.col("category") == "known-item", "known-item"), F.when((F.col("category") == "descriptive") & keep, "descriptive"), F.when(keep, "all (discriminating)")))
    return metrics.select("*", F.explode(kinds).alias("group")).groupBy(*by, "group").agg(F.count("*").alias("n"), F.avg("precision").alias("p_at_10"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg_at_10"))


def golden_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The builder's metrics: precision over what was returned, recall over min(k, qualifying), families, traps.

    ``ranked`` (query_id, id, rank, family, has_evidence); ``queries`` (query_id, wants_subject).
    """
    hits = ranked.filter(F.col("rank") <= k).join(gold, ["query_id", "id"], "left")
    g, t = F.coalesce("is_gold", F.lit(False)), F.coalesce("is_trap", F.lit(False))
    per = hits.join(queries.select("query_id", "wants_subject"), "query_id").groupBy("query_id").agg(
        F.count("*").alias("returned"),
        F.sum(g.cast("int")).alias("relevant"),
        F.sum(t.cast("int")).alias("traps"),
        F.countDistinct(F.coalesce("family", F.lit("∅"))).alias("families"),
        F.sum((g & (~F.col("wants_subject") | F.col("has_evidence"))).cast("int")).alias("backed"),
    )
    sizes = gold.groupBy("query_id").agg(F.sum(F.col("is_gold").cast("int")).alias("qualifying"))
    all_ = queries.select("query_id").join(per, "query_id", "left").join(sizes, "query_id", "left").na.fill(0)
    shown = F.greatest(F.lit(1), F.col("returned"))
    return all_.select(
        "query_id",
        "qualifying",
        "returned",
        F.bround(F.col("relevant") / shown, 4).alias("precision_at_k"),
        F.bround(F.col("relevant") / F.greatest(F.lit(1), F.least(F.lit(k), F.col("qualifying"))), 4).alias("recall_at_k"),
        F.bround(F.col("families") / shown, 4).alias("family_diversity"),
        F.bround(F.col("traps") / shown, 4).alias("trap_rate"),
        F.when(F.col("relevant") > 0, F.bround(F.col("backed") / F.col("relevant"), 4)).otherwise(0.0).alias("evidence_backed_fraction"),
    )


def union_coverage(first: DataFrame, second: DataFrame, gold: DataFrame, depth: int = 10) -> DataFrame:
    """Whether the union of two channels' heads reached a relevant record, and how many."""
    reached = united(first.filter(F.col("rank") <= depth).select("query_id", "id"), second.filter(F.col("rank") <= depth).select("query_id", "id")).distinct()
    hits = reached.join(gold.filter("is_gold").select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    return reached.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce((F.col("n") > 0).cast("double"), F.lit(0.0)).alias("covered"), F.coalesce("n", F.lit(0)).alias("relevant_reached"))


def sweep(rank: Callable[[Mapping[str, float]], DataFrame], configs: Mapping[str, Mapping[str, float]], gold: DataFrame, queries: DataFrame, n_documents: Column, depth: int = 10, broad: float = 0.05) -> DataFrame:
    """(config, group, means) of a ranking under several weights: ``rank`` gives (query_id, id, rank) for one set of weights.

    ``queries`` (query_id, category).  All configurations are one plan.
    """
    parts = [summarise(rank_metrics(rank(w), gold, queries, depth).join(queries.select("query_id", "category"), "query_id"), n_documents, broad).withColumn("config", F.lit(name)) for name, w in configs.items()]
    return united(*parts)


def grid_heads(scores: DataFrame, depth: int = 10) -> DataFrame:
    """(config, query_id, id, rank): the first ``depth`` of each query under each configuration, by score and then id.

    ``scores`` (config, query_id, id, score).  Each task keeps its best before the shuffle.
    """
    w = Window.partitionBy("config", "query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= depth).select("config", "query_id", "id", "rank")


def of_each(configs: Sequence[str], queries: DataFrame) -> DataFrame:
    """``queries`` once for each of the named configurations."""
    return queries.select(F.explode(F.array(*[F.lit(c) for c in configs])).alias("config"), *queries.columns)


def grid_sweep(heads: DataFrame, configs: Sequence[str], gold: DataFrame, queries: DataFrame, n_documents: Column, depth: int = 10, broad: float = 0.05) -> DataFrame:
    """(config, group, means) of the rankings of a whole grid in one pass: ``sweep`` without a plan for each configuration.

    ``heads`` (config, query_id, id, rank), ``queries`` (query_id, category).  A query without a head counts 0 in every configuration.
    """
    asked = of_each(configs, queries)
    metrics = rank_metrics(heads, gold, asked, depth, ["config"]).join(queries.select("query_id", "category"), "query_id")
    return summarise(metrics, n_documents, broad, ["config"])


def grid_coverage(lexical: DataFrame, heads: DataFrame, configs: Sequence[str], gold: DataFrame, queries: DataFrame, depth: int = 10) -> DataFrame:
    """(config, covered, relevant_reached): means over ``queries`` (query_id) of the union of one lexical head with each head of a grid.

    ``lexical`` (query_id, id, rank), ``heads`` (config, query_id, id, rank).  A query that nothing reached counts 0.
    """
    first = of_each(configs, lexical.filter(F.col("rank") <= depth).select("query_id", "id"))
    reached = united(first, heads.filter(F.col("rank") <= depth).select("config", "query_id", "id")).distinct()
    hits = reached.join(gold.filter("is_gold").select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("config", "query_id").agg(F.count("*").alias("n"))
    each = of_each(configs, queries.select("query_id")).join(hits, ["config", "query_id"], "left").na.fill(0, ["n"])
    return each.groupBy("config").agg(F.avg((F.col("n") > 0).cast("double")).alias("covered"), F.avg("n").alias("relevant_reached"))


def coverage_sweep(lexical: DataFrame, near: Callable[[Mapping[str, float]], DataFrame], configs: Mapping[str, Mapping[str, float]], gold: DataFrame, depth: int = 10) -> DataFrame:
    """(config, covered, relevant_reached): means of ``union_coverage`` of lexical heads with vector heads under several weights."""
    parts = [union_coverage(lexical, near(w), gold, depth).agg(F.avg("covered").alias("covered"), F.avg("relevant_reached").alias("relevant_reached")).withColumn("config", F.lit(name)) for name, w in configs.items()]
    return united(*parts)


def phrasing_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """How nDCG changes when a query is worded in the other way."""
    return a.select("query_id", F.col("ndcg").alias("ndcg_a")).join(b.select("query_id", F.col("ndcg").alias("ndcg_b")), "query_id").withColumn("delta", F.col("ndcg_b") - F.col("ndcg_a"))


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of label pairs."""
    return pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count("*").alias("n"))


def kappa(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Observed and expected agreement and Cohen's kappa from a confusion table; 0 where chance alone agrees."""
    group = [F.col(c) for c in by]
    n = counts.groupBy(*group).agg(F.sum("n").alias("n_pairs"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    rows = counts.groupBy(*group, F.col("label_a").alias("label")).agg(F.sum("n").alias("ra"))
    cols = counts.groupBy(*group, F.col("label_b").alias("label")).agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, [*by, "label"]).groupBy(*group).agg(F.sum(F.col("ra") * F.col("rb")).alias("cross_sum"))
    joined = n.join(chance, list(by), "left") if by else n.crossJoin(chance)  # one row each
    observed, expected = F.col("same") / F.col("n_pairs"), F.coalesce(F.col("cross_sum"), F.lit(0)) / (F.col("n_pairs") * F.col("n_pairs"))
    return joined.select(*by, "n_pairs", observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(0.0).alias("kappa"))


def label_alignment(verdicts: DataFrame) -> DataFrame:
    """Per query with exactly two usable judges: compared records, agreement and kappa over shared urls.

    ``verdicts`` (query_id, judge, url, relevance, error).
    """
    good = verdicts.filter("coalesce(error, '') = '' and url is not null")
    judges = verdicts.filter("coalesce(error, '') = ''").groupBy("query_id").agg(F.min("judge").alias("left_"), F.max("judge").alias("right_"), F.countDistinct("judge").alias("n")).filter("n = 2")
    placed = good.join(judges, "query_id").filter(F.col("relevance").isin(*LABELS))
    a = placed.filter("judge = left_").select("query_id", "url", F.col("relevance").alias("label_a"))
    b = placed.filter("judge = right_").select("query_id", "url", F.col("relevance").alias("label_b"))
    counts = a.join(b, ["query_id", "url"]).groupBy("query_id", "label_a", "label_b").agg(F.count("*").alias("n"))
    return kappa(counts, ("query_id",)).select("query_id", F.col("n_pairs").alias("compared_records"), F.bround("observed", 3).alias("label_agreement"), F.bround("kappa", 3).alias("cohens_kappa"))


def judge_agreement(verdicts: DataFrame, full_matrix: bool = False) -> DataFrame:
    """Per query: urls that all usable judges accepted, urls that any did, and their ratio (null without any)."""
    ok = F.col("relevance").isin("strong", "relevant") if full_matrix else F.lit(True)
    usable = verdicts.filter("coalesce(error, '') = ''")
    judges = usable.groupBy("query_id").agg(F.countDistinct("judge").alias("judges"))
    votes = usable.filter(F.col("url").isNotNull() & ok).groupBy("query_id", "url").agg(F.countDistinct("judge").alias("votes"))
    all_ = verdicts.select("query_id").distinct().join(judges, "query_id", "left").join(votes, "query_id", "left")
    out = all_.groupBy("query_id").agg(F.sum((F.col("votes") == F.col("judges")).cast("int")).alias("agreed"), F.count("url").alias("in_union"))
    return out.select("query_id", F.coalesce("agreed", F.lit(0)).alias("agreed"), "in_union", F.when(F.col("in_union") > 0, F.bround(F.coalesce("agreed", F.lit(0)) / F.col("in_union"), 3)).alias("agreement"))


def golden_rollup(agreement: DataFrame, alignment: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: label agreement weighted by records, plain means of kappa, agreement (without failed queries) and agreed records."""
    scored = agreement.join(failed.select("query_id"), "query_id", "left_anti").filter("agreement is not null")
    a = alignment.agg(F.sum("compared_records").alias("compared_records"), F.bround(F.sum(F.col("label_agreement") * F.col("compared_records")) / F.sum("compared_records"), 3).alias("mean_label_agreement"), F.bround(F.avg("cohens_kappa"), 3).alias("mean_cohens_kappa"))
    b = scored.agg(F.bround(F.avg("agreement"), 3).alias("mean_agreement"))
    c = agreement.agg(F.count("*").alias("queries"), F.bround(F.sum("agreed") / F.greatest(F.lit(1), F.count("*")), 1).alias("mean_agreed_per_query"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def unusable_reason(judge: Column, cost: Column, calls: Column) -> Column:
    """Why a judgement can't be trusted; '' if it can."""
    return F.when(calls == 0, F.concat(F.lit("judge "), judge, F.lit(" was never called; ranking unavailable"))).when(cost == 0, F.concat(F.lit("judge "), judge, F.lit(" made "), calls.cast("string"), F.lit(" calls at zero cost; likely rejected"))).otherwise("")


def judgement_key(*parts: Column) -> Column:
    """A content address: the first 32 hex digits over zero-ended parts."""
    return F.substring(F.sha2(F.concat(*[F.concat(p.cast("string").cast("binary"), F.lit(b"\x00")) for p in parts]), 256), 1, 32)


def whole(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0))


def usage_ledger(calls: DataFrame) -> DataFrame:
    """Usage by model and, with a null model, in all.

    ``calls`` (model, phase, prompt_tokens, completion_tokens, input_tokens, output_tokens, total_tokens, cached_tokens, reasoning_tokens,
    cost, fallback_cost) as strings or numbers; older names fill in for newer ones; calls without any cost are counted.
    """
    have = set(calls.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    prompt, completion = whole(F.coalesce(col("prompt_tokens"), col("input_tokens"))), whole(F.coalesce(col("completion_tokens"), col("output_tokens")))
    total = whole(col("total_tokens"))
    cost = F.coalesce(col("cost").try_cast("double"), col("fallback_cost").try_cast("double"))
    rows = calls.select(
        "model", "phase", prompt.alias("p"), completion.alias("c"), F.when(total != 0, total).otherwise(prompt + completion).alias("t"), whole(col("cached_tokens")).alias("k"), whole(col("reasoning_tokens")).alias("r"), cost.alias("cost")
    )
    sums = rows.rollup("model").agg(
        F.count("*").alias("calls"),
        F.sum("p").alias("prompt_tokens"),
        F.sum("c").alias("completion_tokens"),
        F.sum("t").alias("total_tokens"),
        F.sum("r").alias("reasoning_tokens"),
        F.sum("k").alias("cached_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 12).alias("cost"),
        F.sum(F.col("cost").isNull().cast("int")).alias("unpriced_calls"),
    )
    phases = rows.groupBy("model", "phase").agg(F.count("*").alias("n")).groupBy(F.col("model").alias("of_")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "n")))).alias("phases"))
    return sums.join(phases, F.col("model").eqNullSafe(F.col("of_")), "left").drop("of_")
