"""Registered queries: each applies an operator to whole tables of the driver, with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import naming, predicates
from quarry.functions import text as X
from quarry.operators import evaluation, evidence, families, reports, retrieval, selection
from quarry.sources import tables
from quarry.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-01 00:00:00"
#: The questions of the search queries.
QUESTIONS = (("q1", "the thing for that with erenst and ation"), ("q2", "licensed under the apache license version"), ("q3", "de la eau que les"), ("q4", "der die und keit ver"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id string, question string")


def searchable(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their source as name and their text as body."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("body"), "lang")


# --- tokens and the index ------------------------------------------------------------------------------

TOKEN_SQL = """
  long AS (SELECT doc_id, 'name' AS field, regexp_extract_all(lower(source), '[a-z0-9]+') AS toks FROM documents
           UNION ALL SELECT doc_id, 'body', regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents),
  sized AS (SELECT *, len(toks) AS len FROM long WHERE len(toks) > 0),
  post AS (SELECT doc_id, field, token, count(*) AS tf, any_value(len) AS len
           FROM (SELECT doc_id, field, len, unnest(toks) AS token FROM sized) GROUP BY 1, 2, 3),
  dfs AS (SELECT token, count(DISTINCT doc_id) AS df FROM post GROUP BY 1),
  stats AS (SELECT field, avg(len) AS avg_len FROM sized GROUP BY 1)"""


def values_sql(stop: bool = True) -> str:
    """The questions' tokens as SQL rows, with their multiplicity."""
    import re

    from quarry.functions.values import STOPWORDS

    rows = []
    for q, text in QUESTIONS:
        toks = re.findall("[a-z0-9]+", text)
        toks = ([t for t in toks if t not in STOPWORDS] or toks) if stop else toks
        rows += [f"('{q}', '{t}', {toks.count(t)})" for t in dict.fromkeys(toks)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(query_id, token, times)"


@query(f"WITH {TOKEN_SQL} SELECT token, df FROM dfs")
def doc_freq(spark, sf):
    return retrieval.build_index(searchable(spark, sf), "id", ["name", "body"]).terms


@query(f"WITH {TOKEN_SQL} SELECT field, round(avg_len, 6) AS avg_len FROM stats")
def field_avg_len(spark, sf):
    return retrieval.build_index(searchable(spark, sf), "id", ["name", "body"]).stats.select("field", F.round("avg_len", 6).alias("avg_len"))


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS n_tokens,
       len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+.#-]*'))::INT AS n_rich FROM documents""")
def token_counts_by_rule(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"), F.size(X.rich_tokens(F.col("text"))).alias("n_rich"))


def bm25_sql(name_w: float, body_w: float) -> str:
    return f"""
WITH {TOKEN_SQL}, q AS ({values_sql()}), n AS (SELECT count(*) AS n FROM documents),
  hit AS (SELECT query_id, p.doc_id, p.token, times, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf,
            sum(CASE field WHEN 'name' THEN {name_w} ELSE {body_w} END * tf / (0.25 + 0.75 * len / avg_len)) AS tf
          FROM post p JOIN q USING (token) JOIN dfs USING (token) JOIN stats USING (field), n GROUP BY ALL),
  s AS (SELECT query_id, doc_id AS id, sum(times * idf * tf / (1.5 + tf)) AS score FROM hit GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10"""


def best(scores: DataFrame, k: int = 10) -> DataFrame:
    """Top k with scores rounded, so that sums added in another order don't change ranks."""
    return retrieval.top_k(scores.withColumn("score", F.round("score", 9)), k).withColumn("score", F.round("score", 6))


@query(bm25_sql(32.0, 0.5))
def bm25f_topk(spark, sf):
    terms = retrieval.query_terms(asked(spark))
    return best(retrieval.bm25f(retrieval.build_index(searchable(spark, sf), "id", ["name", "body"], terms), terms))


@query(bm25_sql(1.0, 1.0))
def bm25_flat_topk(spark, sf):
    terms = retrieval.query_terms(asked(spark))
    return best(retrieval.flat_bm25(retrieval.build_index(searchable(spark, sf), "id", ["name", "body"], terms), terms, ["name", "body"]))


@query(f"""
WITH counts AS (SELECT doc_id AS id, token, sum(boost) AS tf FROM (
    SELECT doc_id, 3.0::DOUBLE AS boost, unnest(regexp_extract_all(lower(source), '[a-z0-9][a-z0-9+.#-]*')) AS token FROM documents
    UNION ALL SELECT doc_id, 1.0::DOUBLE, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+.#-]*')) FROM documents) GROUP BY 1, 2),
  lens AS (SELECT id, sum(tf) AS len FROM counts GROUP BY 1),
  m AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM lens) / (SELECT count(*) FROM documents) AS avg_len),
  dfs AS (SELECT token, count(*) AS df FROM counts GROUP BY 1), q AS ({values_sql(False)}),
  s AS (SELECT query_id, c.id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 4) AS score
        FROM counts c JOIN q USING (token) JOIN dfs USING (token) JOIN lens ON lens.id = c.id, m GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)
SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 10""")
def eval_bm25_topk(spark, sf):
    docs = searchable(spark, sf).withColumnRenamed("body", "description")
    return retrieval.top_k(retrieval.eval_bm25(docs, "id", ["name", "description"], asked(spark)), 10)


DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
VECTOR_SQL = f"""s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({DOT}, 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
  v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def vectors(spark, sf, k):
    """The best k of each query."""
    e = table(spark, sf, "embeddings")
    asked_ = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the stated query set
    return retrieval.nearest(e, asked_, k, id_col="vec_id")


@query(f"WITH {VECTOR_SQL} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM v WHERE rank <= 10")
def vector_topk(spark, sf):
    return retrieval.top_k(vectors(spark, sf, 10), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {VECTOR_SQL}, f AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score, id DESC) AS far FROM s),
  x AS (SELECT s.query_id, s.id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS rank
        FROM s LEFT JOIN v ON v.query_id = s.query_id AND v.id = s.id AND v.rank <= 10 WHERE v.id IS NULL)
  SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank, 'bm25' AS channel FROM v WHERE rank <= 10
  UNION ALL SELECT query_id, id, round(score, 6), rank::INT, 'vector' FROM x WHERE rank <= 10""")
def vector_topk_excluding(spark, sf):
    s = tables.materialise(vectors(spark, sf, 20), "nearest")  # ten, and ten more where those are taken out; read twice
    return retrieval.compare(s, s, 10).withColumn("score", F.round("score", 6)).select("query_id", "id", "score", "rank", "channel")


@query("""SELECT vec_id, greatest(0, least(100, floor((round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) + 1) * 50)))::INT AS self_score,
       least(100, floor(label * 2.5 * 5))::INT AS lexical_score FROM embeddings""")
def no_judge_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", retrieval.similarity_score(F.round(retrieval.dot(F.col("embedding"), F.col("embedding")), 5)).alias("self_score"), retrieval.retrieval_score(F.lit(None).cast("double"), F.col("label") * 2.5).alias("lexical_score"))


# --- results -------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_orderkey, o_custkey AS query_id, o_orderkey AS arrival, (floor(o_totalprice)::BIGINT % 101)::INT AS score FROM orders)
SELECT query_id, arrival, score, CASE WHEN score >= 90 THEN 'strong' ELSE 'relevant' END AS band,
  row_number() OVER (PARTITION BY query_id ORDER BY (score < 90)::INT, arrival)::INT AS position FROM r""")
def result_bands(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("arrival"), (F.floor("o_totalprice").cast("long") % 101).cast("int").alias("score"))
    return retrieval.band_order(o)


@query("""SELECT site, name, arrival FROM (SELECT p_brand AS site, p_name AS name, p_partkey AS arrival,
  row_number() OVER (PARTITION BY p_brand, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) ORDER BY p_partkey) AS k FROM part) WHERE k = 1""")
def result_dedup(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("site"), F.col("p_name").alias("name"), F.col("p_partkey").alias("arrival"))
    return retrieval.drop_same_names(p, by=())


@query("""SELECT o_custkey AS query_id, o_orderkey AS rank,
  ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % least(3, count(*) OVER (PARTITION BY o_custkey)))::INT AS batch,
  ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % ceil(count(*) OVER (PARTITION BY o_custkey) / 10.0)::BIGINT)::INT AS full_batch FROM orders""")
def judge_batches(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rank"))
    return retrieval.round_robin(retrieval.round_robin(o).withColumnRenamed("batch", "full_batch"), 3)


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 90 WHEN event_type = 'view' THEN 60 WHEN value::INT >= 60 THEN least(100, value::INT) END::INT AS score,
  CASE WHEN user_id % 5 = 0 THEN 10 ELSE least(greatest(user_id, 1), 50) END::BIGINT AS width FROM (SELECT event_id, event_type, user_id, floor(value) AS value FROM events)""")
def verdicts_and_widths(spark, sf):
    e = table(spark, sf, "events")
    word = F.when(F.col("event_type") == "click", "Strong ").when(F.col("event_type") == "view", "relevant").otherwise(F.floor("value").cast("string"))
    return e.select("event_id", retrieval.parse_verdict(word).cast("int").alias("score"), retrieval.bounded(F.when(F.col("user_id") % 5 != 0, F.col("user_id")), 10, 50).cast("long").alias("width"))


# --- copies --------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS content_sha, count(*) AS n_members, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, sf):
    return families.duplicate_groups(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha FROM documents GROUP BY 2")
def dedup_first(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content_sha")).agg(F.min("doc_id").alias("doc_id"))


@query("""
WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
  s AS (SELECT doc_id, lang, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS sh FROM t WHERE len(w) >= 5),
  c AS (SELECT min(doc_id) AS rep, lang, sh FROM s GROUP BY lang, sh),
  e AS (SELECT rep, lang, len(sh) AS n, unnest(sh) AS h FROM c),
  p AS (SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS nx, any_value(y.n) AS ny, count(*) AS k FROM e x JOIN e y ON x.h = y.h AND x.lang = y.lang AND x.rep < y.rep GROUP BY 1, 2)
SELECT a, b, round(k / (nx + ny - k), 6) AS jaccard FROM p WHERE k / (nx + ny - k) >= 0.9
UNION ALL SELECT c.rep, s.doc_id, 1.0 FROM s JOIN c ON s.sh = c.sh AND s.lang = c.lang WHERE s.doc_id <> c.rep""")
def near_dups_090(spark, sf):
    return families.near_duplicates(table(spark, sf, "documents"), "doc_id", "text", ["lang"]).withColumn("jaccard", F.round("jaccard", 6))


LINEAGE_SQL = """WITH RECURSIVE up AS (SELECT p_partkey AS node, p_partkey AS root, 0 AS d FROM part
  UNION ALL SELECT node, root // 2, d + 1 FROM up WHERE root // 2 >= 1 AND d < {hops})
SELECT node, min(root) AS root FROM up GROUP BY 1"""


def halves(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(p.alias("node"), F.when(p >= 2, F.floor(p / 2).cast("long")).alias("parent"))


@query(LINEAGE_SQL.format(hops=99))
def lineage_root(spark, sf):
    return families.lineage_roots(halves(spark, sf))


@query(LINEAGE_SQL.format(hops=7))
def lineage_root_seven_hops(spark, sf):
    return families.lineage_roots(halves(spark, sf), hops=7)


@query("""WITH g AS (SELECT p_brand, p_type, min((-(p_size), p_name, p_partkey)) AS k, count(*) AS n_members FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, k[3] AS canonical, n_members FROM g""")
def canonical_pick(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", F.col("p_size").alias("downloads"), F.col("p_name").alias("created"), F.col("p_partkey").alias("key"))
    k = F.struct((-F.col("downloads")).alias("d"), F.col("created").alias("c"), F.col("key").alias("r"))
    return p.groupBy("p_brand", "p_type").agg(F.min(k).alias("k"), F.count("*").alias("n_members")).select("p_brand", "p_type", F.col("k.r").alias("canonical"), "n_members")


# --- quotes, markup, conversations ---------------------------------------------------------------------

PLAIN = "trim(regexp_replace(lower(regexp_replace({}, '[*`~#_]', '', 'g')), '\\s+', ' ', 'g'))"


@query(f"SELECT b.item_id, d.doc_id FROM benchmark b, documents d WHERE contains({PLAIN.format('d.text')}, {PLAIN.format('b.text')})")
def quote_located(spark, sf):
    return evidence.quotes_in_documents(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


def unmarked(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    from quarry.functions.values import ENTITIES

    for name, sign in ENTITIES:
        out = f"replace({out}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {unmarked('html')} AS text FROM pages")
def html_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


@query(f"SELECT page_id, {unmarked('regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')} AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_markup(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))


@query("""SELECT conv_id, count(*) AS turns, max(turn) + 1 AS next_seq, CASE WHEN length(q) > 72 THEN left(q, 71) || '…' ELSE q END AS title, sum(strlen(text))::BIGINT AS bytes
FROM conversations LEFT JOIN (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')) AS q FROM conversations WHERE role = 'user' GROUP BY 1) USING (conv_id) GROUP BY conv_id, q""")
def thread_listing(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), (F.max("turn") + 1).alias("next_seq"), X.thread_title(F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))).alias("title"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("""SELECT conv_id, array_to_string(list(text ORDER BY turn), chr(10)) AS previous FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user') WHERE k <= 5 GROUP BY 1""")
def last5_user_turns(spark, sf):
    users = table(spark, sf, "conversations").filter("role = 'user'")
    return limits.event_sequence(users.withColumn("back", -F.col("turn")), "conv_id", ["back"]).filter("sequence <= 5").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("previous"))


@query("SELECT count(DISTINCT conv_id) AS threads, count(*) AS turns, sum(strlen(text))::BIGINT AS bytes FROM conversations")
def storage_usage(spark, sf):
    return table(spark, sf, "conversations").agg(F.countDistinct("conv_id").alias("threads"), F.count("*").alias("turns"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


# --- agreement and usage -------------------------------------------------------------------------------


@query("SELECT quality AS label_a, toxic AS label_b, count(*) AS n FROM labels GROUP BY 1, 2")
def label_confusion(spark, sf):
    return evaluation.confusion(table(spark, sf, "labels"), "quality", "toxic")


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS same FROM c),
  x AS (SELECT sum(ra * rb) AS cs FROM (SELECT a AS l, sum(n) AS ra FROM c GROUP BY 1) JOIN (SELECT b AS l, sum(n) AS rb FROM c GROUP BY 1) USING (l))
SELECT n::BIGINT AS n_pairs, round(same / n, 6) AS observed, round(cs / (n * n), 6) AS expected, round((same / n - cs / (n * n)) / (1 - cs / (n * n)), 6) AS kappa FROM t, x""")
def label_kappa(spark, sf):
    k = evaluation.kappa(evaluation.confusion(table(spark, sf, "labels"), "quality", "toxic"))
    return k.select("n_pairs", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("""SELECT event_type AS model, count(*) AS calls, sum(floor(value)::BIGINT)::BIGINT AS prompt_tokens, sum(user_id)::BIGINT AS completion_tokens,
  sum(CASE WHEN event_id % 3 = 0 THEN floor(value)::BIGINT + user_id + 1 ELSE floor(value)::BIGINT + user_id END)::BIGINT AS total_tokens,
  round(sum(CASE WHEN event_id % 4 <> 0 THEN floor(value) END), 6) AS cost, sum((event_id % 4 = 0)::INT)::BIGINT AS unpriced_calls
FROM events GROUP BY ROLLUP (event_type)""")
def usage_ledger(spark, sf):
    e = table(spark, sf, "events")
    p, c = F.floor("value").cast("long"), F.col("user_id")
    calls = e.select(F.col("event_type").alias("model"), (F.col("user_id") % 3).cast("string").alias("phase"), p.cast("string").alias("input_tokens"), c.cast("string").alias("output_tokens"), F.when(F.col("event_id") % 3 == 0, p + c + 1).alias("total_tokens"), F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("double")).alias("cost"))
    return evaluation.usage_ledger(calls).select("model", "calls", "prompt_tokens", "completion_tokens", "total_tokens", F.round("cost", 6).alias("cost"), "unpriced_calls")


# --- percentiles, scores, selection --------------------------------------------------------------------

PCT = "CASE WHEN count(*) OVER w0 = 1 THEN 1.0 ELSE (rank() OVER (w0 ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0) / (count(*) OVER w0 - 1) END"


@query(f"SELECT p_partkey, round({PCT.format(v='p_size', by='p_brand')}, 9) AS percentile FROM part WINDOW w0 AS (PARTITION BY p_brand)")
def avg_tie_percentile(spark, sf):
    return selection.tie_percentiles(table(spark, sf, "part"), "p_size", ["p_brand"]).select("p_partkey", F.round("percentile", 9).alias("percentile"))


CANDIDATE_SQL = """c AS (SELECT c_custkey AS repo_id, c_mktsegment AS stratum, n_name AS author, (c_custkey % 7 = 0) AS non_english, (c_custkey % 5 = 0) AS small_model,
  (c_custkey % 11 = 0) AS rare_publisher, coalesce(k, 0) AS downloads, coalesce(m, 0) AS likes, c_acctbal AS trending_score
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS k, count(*) FILTER (o_orderstatus = 'F') AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def candidates(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("downloads"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("likes"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    return c.select(
        k.alias("repo_id"), F.col("c_mktsegment").alias("stratum"), F.col("n_name").alias("author"), (k % 7 == 0).alias("non_english"), (k % 5 == 0).alias("small_model"), (k % 11 == 0).alias("rare_publisher"),
        F.coalesce("downloads", F.lit(0)).alias("downloads"), F.coalesce("likes", F.lit(0)).alias("likes"), F.col("c_acctbal").alias("trending_score"),
    )


def scored(spark, sf):
    c = candidates(spark, sf)
    bonus = (F.col("non_english").cast("int") + F.col("small_model").cast("int") + F.col("rare_publisher").cast("int")) / 4
    ready = c.withColumns({"recency_score": F.lit(0.5), "documentation_quality": F.lit(0.4), "diversity_bonus": bonus, "variant_kind": F.when(F.col("repo_id") % 13 == 0, "mirror")})
    return selection.score(ready)


SCORE_SQL = f"""{CANDIDATE_SQL}, s AS (SELECT *, round(0.35 * {PCT.format(v='downloads', by='stratum')} + 0.2 * {PCT.format(v='likes', by='stratum')} + 0.15 * {PCT.format(v='trending_score', by='stratum')}
  + 0.1 * 0.5 + 0.1 * 0.4 + 0.1 * (non_english::INT + small_model::INT + rare_publisher::INT) / 4.0 - CASE WHEN repo_id % 13 = 0 THEN 0.5 ELSE 0 END, 6) AS score FROM c WINDOW w0 AS (PARTITION BY stratum))"""


@query(f"WITH {SCORE_SQL} SELECT repo_id, stratum, floor(score * 10000 + 0.305)::BIGINT AS basis_points FROM s")
def stratum_score(spark, sf):
    return scored(spark, sf).select("repo_id", "stratum", F.floor(F.col("score") * 10000 + 0.305).alias("basis_points"))


@query(f"""WITH {SCORE_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY stratum, author ORDER BY score DESC, repo_id) AS of_cap FROM s),
  b AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, repo_id) AS position FROM a WHERE of_cap <= 3)
SELECT repo_id, stratum, author, of_cap::INT AS of_cap, position::INT AS position FROM b WHERE position <= 40""")
def capped_top(spark, sf):
    return selection.capped_top(scored(spark, sf), ["stratum"], ["author"], 3, 40).select("repo_id", "stratum", "author", "of_cap", "position")


STRATA = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""WITH RECURSIVE {SCORE_SQL}, e AS (
    SELECT lpad(repo_id::VARCHAR, 8, '0') AS repo_id, stratum, author, author || '-' || (repo_id % 9) AS family, score, non_english::INT + small_model::INT + rare_publisher::INT AS rarity, repo_id % 13 = 0 AS mirror FROM s
  ), k AS (SELECT stratum, row_number() OVER (ORDER BY stratum) AS k FROM (SELECT DISTINCT stratum FROM e)),
  visits AS (SELECT *, row_number() OVER (ORDER BY stage, first, score DESC, repo_id) AS turn FROM (
    SELECT 2 * k AS stage, 0 AS first, * FROM e JOIN k USING (stratum) WHERE NOT mirror UNION ALL SELECT 2 * k + 1, -rarity, * FROM e JOIN k USING (stratum) WHERE NOT mirror UNION ALL SELECT 99, 0, * FROM e JOIN k USING (stratum) WHERE NOT mirror)),
  walk AS (
    SELECT 0::BIGINT AS pos, 0::BIGINT AS stage, 0::BIGINT AS n, []::VARCHAR[] AS ids, []::VARCHAR[] AS authors, []::VARCHAR[] AS families, []::VARCHAR[] AS strata, NULL::VARCHAR AS got, NULL::VARCHAR AS reason
    UNION ALL
    SELECT turn, stage, n + ok::INT, CASE WHEN ok THEN list_append(ids, repo_id) ELSE ids END, CASE WHEN ok THEN list_append(authors, author) ELSE authors END, CASE WHEN ok THEN list_append(families, family) ELSE families END,
      CASE WHEN ok THEN list_append(strata, stratum) ELSE strata END, CASE WHEN ok THEN repo_id END, CASE WHEN stage = 99 OR stage % 2 = 1 AND rarity > 0 THEN 'included_diversity' ELSE 'included_ranked' END
    FROM (SELECT *, NOT list_contains(ids, repo_id) AND len(list_filter(authors, lambda x: x = author)) < 10 AND len(list_filter(families, lambda x: x = family)) < 4
        AND CASE WHEN stage = 99 THEN len(ids) < 100 WHEN stage % 2 = 1 THEN len(list_filter(strata, lambda x: x = stratum)) < 20 ELSE n < 17 END AS ok
      FROM (SELECT v.*, CASE WHEN w.stage = v.stage THEN w.n ELSE 0 END AS n, w.ids, w.authors, w.families, w.strata FROM walk w JOIN visits v ON v.turn = w.pos + 1)))
SELECT e.repo_id, e.stratum, CASE WHEN mirror THEN 'suppressed' WHEN got IS NULL THEN 'excluded' ELSE 'included' END AS decision, CASE WHEN mirror THEN 'suppressed_variant' ELSE coalesce(reason, 'excluded_over_quota') END AS reason
FROM e LEFT JOIN (SELECT got, reason FROM walk WHERE got IS NOT NULL) ON e.repo_id = got""")
def greedy_selection(spark, sf):
    """Selection under two caps that hold over eleven walks; the SQL takes row after row."""
    c = scored(spark, sf).withColumns({"repo_id": F.lpad(F.col("repo_id").cast("string"), 8, "0"), "private": F.lit(False), "disabled": F.lit(False), "gated": F.lit("auto")})
    c = c.withColumn("family_key", F.concat("author", F.lit("-"), (F.col("repo_id").cast("long") % 9).cast("string")))
    return selection.select(c, selection.scaled_quotas(dict.fromkeys(STRATA, 100), 100), 100).select("repo_id", "stratum", "decision", "reason")


@query("""WITH RECURSIVE o AS (SELECT p_name AS repo_id, list_sort(list(DISTINCT p_brand)) AS options FROM part WHERE regexp_matches(p_brand, '^Brand#[1-5][1-5]$') GROUP BY p_name), alone AS (SELECT repo_id, options[1] AS stratum FROM o WHERE len(options) = 1),
  shared AS (SELECT *, row_number() OVER (ORDER BY repo_id) AS turn FROM o WHERE len(options) > 1),
  start AS (SELECT coalesce(list(stratum), []) AS strata FROM alone),
  walk AS (
    SELECT 0::BIGINT AS pos, NULL::VARCHAR AS repo_id, NULL::VARCHAR AS stratum, list_transform(range(0, 25), lambda i: len(list_filter(strata, lambda x: x = 'Brand#' || (i // 5 + 1) || (i % 5 + 1)))) AS filled FROM start
    UNION ALL
    SELECT turn, repo_id, stratum, list_transform(range(0, 25), lambda i: filled[i + 1] + ('Brand#' || (i // 5 + 1) || (i % 5 + 1) = stratum)::INT)
    FROM (SELECT s.turn, s.repo_id, filled, list_sort(list_transform(s.options, lambda x: {'fill': filled[(substr(x, 7, 1)::INT - 1) * 5 + substr(x, 8, 1)::INT]::DOUBLE / substr(x, 7, 2)::INT, 's': x}))[1].s AS stratum FROM walk w JOIN shared s ON s.turn = w.pos + 1))
SELECT repo_id, stratum FROM alone UNION ALL SELECT repo_id, stratum FROM walk WHERE repo_id IS NOT NULL""")
def stratum_assignment(spark, sf):
    """Each repository goes to the stratum of its own that is furthest from its quota; the SQL takes row after row."""
    p = table(spark, sf, "part").groupBy("p_name").agg(F.collect_set(F.concat("p_brand", F.lit(":q"))).alias("found_by")).withColumnRenamed("p_name", "repo_id")
    return selection.assign_strata(p, {f"Brand#{i}{j}": 10 * i + j for i in range(1, 6) for j in range(1, 6)})


@query("""WITH f AS (SELECT l_partkey AS repo_id, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS label FROM lineitem),
  d AS (SELECT repo_id, label, min(seq) AS s FROM f GROUP BY 1, 2)
SELECT repo_id, array_to_string(list(label ORDER BY s), ',') AS found_by FROM d GROUP BY 1""")
def discovery_pool(spark, sf):
    found = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("repo_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("label"))
    return selection.pool(found).select("repo_id", F.array_join("found_by", ",").alias("found_by"))


@query("SELECT user_id AS repo_id, arg_max(event_type, event_id) AS decision, arg_max(value, event_id) AS score FROM events GROUP BY 1")
def latest_decision(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("decision"), F.col("value").alias("score"))
    return selection.latest(log)


# --- reports -------------------------------------------------------------------------------------------


@query("""SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN n_chars >= 10000 THEN 'long' WHEN n_chars >= 1000 THEN 'middle' ELSE 'short' END, count(*) FROM documents GROUP BY 2""")
def composition(spark, sf):
    size = F.when(F.col("n_chars") >= 10000, "long").when(F.col("n_chars") >= 1000, "middle").otherwise("short")
    return reports.composition(table(spark, sf, "documents"), {"lang": F.col("lang"), "source": F.col("source"), "size": size})


@query("""SELECT CASE WHEN v < 150000000 THEN '<150M' WHEN v < 1000000000 THEN '150M-1B' WHEN v < 4000000000 THEN '1B-4B' WHEN v < 15000000000 THEN '4B-15B' WHEN v < 80000000000 THEN '15B-80B' ELSE '>80B' END AS band, count(*) AS n
FROM (SELECT l_orderkey * l_partkey * 1000 AS v FROM lineitem) GROUP BY 1""")
def band_counts(spark, sf):
    v = F.col("l_orderkey") * F.col("l_partkey") * 1000
    return table(spark, sf, "lineitem").groupBy(X.parameter_band(v).alias("band")).agg(F.count("*").alias("n"))


@query(f"""SELECT CASE WHEN d <= 30.4 * 3 THEN '<=3 months' WHEN d <= 30.4 * 6 THEN '<=6 months' WHEN d <= 30.4 * 12 THEN '<=12 months' ELSE '>12 months' END AS age, count(*) AS n
FROM (SELECT (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400e6 AS d FROM orders) GROUP BY 1""")
def age_buckets(spark, sf):
    return table(spark, sf, "orders").groupBy(X.age_bucket(F.col("o_orderdate").cast("timestamp"), F.lit(AS_OF).cast("timestamp")).alias("age")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, round_even(pow(0.5, greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400e6)) / 365), 4) AS recency FROM orders")
def recency_scores(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.recency(F.col("o_orderdate").cast("timestamp"), F.lit(AS_OF).cast("timestamp")).alias("recency"))


@query("""WITH c AS (SELECT n_name AS v, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT arg_min(v, (-n, v)) AS top_value, round(max(n) / sum(n), 4) AS top_fraction, count(*) AS n_values FROM c""")
def concentration(spark, sf):
    return reports.concentration(table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), "n_name")


@query("SELECT sum((n > 1)::INT)::BIGINT AS families_with_multiple_records, round(1 - count(*) / sum(n), 4) AS family_collapse_rate FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def family_collapse(spark, sf):
    return reports.family_collapse(table(spark, sf, "part"), "p_name")


@query("SELECT round(avg((l_discount > 0)::INT), 4) AS discounted, round(avg((l_tax > 0.05)::INT), 4) AS taxed, round(avg((l_returnflag = 'R')::INT), 4) AS returned FROM lineitem")
def coverage_fractions(spark, sf):
    return reports.coverage(table(spark, sf, "lineitem"), {"discounted": F.col("l_discount") > 0, "taxed": F.col("l_tax") > 0.05, "returned": F.col("l_returnflag") == "R"})


@query("SELECT l_returnflag, (list_sort(list(l_extendedprice)))[(count(*) // 2 + 1)] AS upper_median FROM lineitem GROUP BY 1")
def upper_median(spark, sf):
    return reports.upper_median(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("""WITH v AS (SELECT unnest(['de','en','fr','it','es','ja']) AS l), h AS (SELECT l FROM v WHERE l IN (SELECT lang FROM documents))
SELECT (SELECT count(*) FROM h) AS covered, 6 AS available, round((SELECT count(*) FROM h) / 6, 3) AS fraction, array_to_string((SELECT list(l ORDER BY l) FROM v WHERE l NOT IN (SELECT l FROM h)), ',') AS uncovered""")
def vocabulary_coverage(spark, sf):
    out = reports.vocabulary_coverage(table(spark, sf, "documents"), "lang", ["de", "en", "fr", "it", "es", "ja"])
    return out.withColumn("uncovered", F.array_join("uncovered", ","))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("""SELECT coalesce(o_custkey, c_custkey) AS id, coalesce(o.k::VARCHAR, c.c_mktsegment) AS merged FROM (SELECT o_custkey, count(*) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o
FULL JOIN customer c ON o.o_custkey = c.c_custkey""")
def internals_merge(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("k"))
    c = table(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "full").select(F.coalesce("o_custkey", "c_custkey").alias("id"), F.coalesce(F.col("k").cast("string"), F.col("c_mktsegment")).alias("merged"))


# --- predicates and metrics ----------------------------------------------------------------------------

SPECS = (
    {"id": "p1", "requires": {"task_any": ["small"], "max_parameters": 20}, "avoid": {"library_any": ["brand#11"]}},
    {"id": "p2", "requires": {"keyword_any": ["ste", "copper"], "min_parameters": 5}},
    {"id": "p3", "requires": {"library_any": ["Brand#22", "Brand#33"], "discovery_scope": "primary"}, "avoid": {"max_parameters": 10}},
)


def part_items(spark, sf):
    p = table(spark, sf, "part")
    kinds = F.split(F.lower("p_type"), " ")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.element_at(kinds, 1).alias("task"), F.col("p_brand").alias("library"), F.col("p_size").alias("parameters"), F.when(F.col("p_size") > 25, "primary").otherwise("variant").alias("discovery_scope"))


@query("""WITH i AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type || '   ') AS txt, split_part(lower(p_type), ' ', 1) AS task, p_brand AS lib, p_size AS n FROM part),
  m AS (SELECT 'p1' AS query_id, id, task = 'small' AND n <= 20 AND NOT lower(lib) = 'brand#11' AS is_gold, lower(lib) = 'brand#11' AS is_trap FROM i
  UNION ALL SELECT 'p2', id, (contains(txt, 'ste') OR contains(txt, 'copper')) AND n >= 5, false FROM i
  UNION ALL SELECT 'p3', id, lower(lib) IN ('brand#22', 'brand#33') AND n > 25 AND NOT n <= 10, n <= 10 FROM i)
SELECT query_id, id, is_gold, is_trap FROM m WHERE is_gold OR is_trap""")
def predicate_matches(spark, sf):
    return predicates.judged_pairs(part_items(spark, sf), SPECS, "id")


METRIC_SQL = f"""
WITH {TOKEN_SQL}, q AS ({values_sql()}), n AS (SELECT count(*) AS n FROM documents),
  hit AS (SELECT query_id, p.doc_id, p.token, times, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, sum(CASE field WHEN 'name' THEN 32.0 ELSE 0.5 END * tf / (0.25 + 0.75 * len / avg_len)) AS tf
          FROM post p JOIN q USING (token) JOIN dfs USING (token) JOIN stats USING (field), n GROUP BY ALL),
  s AS (SELECT query_id, doc_id AS id, round(sum(times * idf * tf / (1.5 + tf)), 9) AS score FROM hit GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
  w AS (SELECT * FROM (VALUES ('q1', 'en'), ('q2', 'en'), ('q3', 'fr'), ('q4', 'de')) w(query_id, lang)),
  g AS (SELECT query_id, doc_id AS id FROM w JOIN documents USING (lang) WHERE n_chars > 1000),
  gs AS (SELECT query_id, count(*) AS gold FROM g GROUP BY 1),
  h AS (SELECT query_id, count(g.id) AS hits, min(rank) FILTER (g.id IS NOT NULL) AS first, sum(CASE WHEN g.id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
        FROM r LEFT JOIN g USING (query_id, id) WHERE rank <= 10 GROUP BY 1)"""


def metrics(spark, sf):
    docs = searchable(spark, sf)
    terms = retrieval.query_terms(asked(spark))
    ranked = retrieval.top_k(retrieval.bm25f(retrieval.build_index(docs, "id", ["name", "body"], terms), terms).withColumn("score", F.round("score", 9)), 10)
    wanted = spark.createDataFrame([("q1", "en"), ("q2", "en"), ("q3", "fr"), ("q4", "de")], "query_id string, lang string")
    gold = table(spark, sf, "documents").filter("n_chars > 1000").join(wanted, "lang").select("query_id", F.col("doc_id").alias("id"), F.lit(True).alias("is_gold"), F.lit(False).alias("is_trap"))
    return evaluation.rank_metrics(ranked, gold, asked(spark))


@query(METRIC_SQL + """
SELECT query_id, gold, round(hits / 10.0, 6) AS precision, round(coalesce(1.0 / first, 0), 6) AS rr,
  round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(gold, 10) + 1) t(i)), 6) AS ndcg FROM h JOIN gs USING (query_id)""")
def ndcg_at_10(spark, sf):
    return metrics(spark, sf).select("query_id", "gold", *[F.round(c, 6).alias(c) for c in ("precision", "rr", "ndcg")])


#: Weights of a document's name and body that are compared, and what kind of question each is.
GRID = {"flat": (1.0, 1.0), "name2": (2.0, 1.0), "name8": (8.0, 1.0), "name32": (32.0, 0.5), "body2": (1.0, 2.0), "body8": (0.5, 8.0), "name only": (1.0, 0.0), "body only": (0.0, 1.0)}
KINDS = (("q1", "descriptive", "en"), ("q2", "known-item", "en"), ("q3", "descriptive", "fr"), ("q4", "descriptive", "de"))
GRID_SQL = f"""
WITH {TOKEN_SQL}, q AS ({values_sql()}), n AS (SELECT count(*) AS n FROM documents),
  w AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {a}, {b})" for c, (a, b) in GRID.items())}) w(config, name_w, body_w)),
  hit AS (SELECT config, query_id, p.doc_id, p.token, times, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, sum(CASE field WHEN 'name' THEN name_w ELSE body_w END * tf / (0.25 + 0.75 * len / avg_len)) AS tf
          FROM post p JOIN q USING (token) JOIN dfs USING (token) JOIN stats USING (field), n, w WHERE CASE field WHEN 'name' THEN name_w ELSE body_w END <> 0 GROUP BY ALL),
  s AS (SELECT config, query_id, doc_id AS id, round(sum(times * idf * tf / (1.5 + tf)), 9) AS score FROM hit GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, id) AS rank FROM s),
  k AS (SELECT * FROM (VALUES {", ".join(map(str, KINDS))}) k(query_id, category, lang)),
  g AS (SELECT query_id, doc_id AS id FROM k JOIN documents USING (lang) WHERE n_chars > 1000),
  gs AS (SELECT query_id, count(*) AS gold FROM g GROUP BY 1)"""


def grid_inputs(spark, sf):
    """Heads under every set of weights, gold records and questions with their category."""
    terms = retrieval.query_terms(asked(spark))
    index = retrieval.build_index(searchable(spark, sf), "id", ["name", "body"], terms)
    scores = retrieval.bm25f_grid(index, terms, {c: {"name": a, "body": b} for c, (a, b) in GRID.items()}).withColumn("score", F.round("score", 9))
    kinds = spark.createDataFrame(KINDS, "query_id string, category string, lang string")
    gold = table(spark, sf, "documents").filter("n_chars > 1000").join(F.broadcast(kinds), "lang").select("query_id", F.col("doc_id").alias("id"), F.lit(True).alias("is_gold"), F.lit(False).alias("is_trap"))
    return evaluation.grid_heads(scores), gold, kinds


@query(GRID_SQL + """,
  h AS (SELECT config, query_id, count(g.id) AS hits, min(rank) FILTER (g.id IS NOT NULL) AS first, sum(CASE WHEN g.id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r LEFT JOIN g USING (query_id, id) WHERE rank <= 10 GROUP BY 1, 2),
  m AS (SELECT w.config, k.category, coalesce(gold, 0) AS gold, coalesce(hits, 0) / 10.0 AS p, coalesce(1.0 / first, 0) AS rr, CASE WHEN gold > 0 THEN coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(gold, 10)::BIGINT + 1) t(i)) ELSE 0 END AS ndcg
        FROM w CROSS JOIN k LEFT JOIN gs ON gs.query_id = k.query_id LEFT JOIN h ON h.query_id = k.query_id AND h.config = w.config),
  u AS (SELECT config, category AS "group", p, rr, ndcg FROM m, n WHERE category = 'known-item' OR gold <= floor(n * 0.5) UNION ALL SELECT config, 'all (discriminating)', p, rr, ndcg FROM m, n WHERE gold <= floor(n * 0.5))
SELECT config, "group", count(*) AS n, round(avg(p), 6) AS p_at_10, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_10 FROM u GROUP BY 1, 2""")
def weight_grid(spark, sf):
    """Means of eight sets of field weights over the index of all documents, from one pass over its postings."""
    heads, gold, kinds = grid_inputs(spark, sf)
    n = table(spark, sf, "documents").count()
    return evaluation.grid_sweep(heads, list(GRID), gold, kinds, F.lit(n), broad=0.5).select("config", "group", "n", *[F.round(c, 6).alias(c) for c in ("p_at_10", "mrr", "ndcg_at_10")])


@query(GRID_SQL + """,
  l AS (SELECT query_id, id FROM r WHERE config = 'flat' AND rank <= 10), o AS (SELECT w.config, l.query_id, l.id FROM w, l UNION SELECT config, query_id, id FROM r WHERE rank <= 10),
  h AS (SELECT config, query_id, count(*) AS reached FROM o JOIN g USING (query_id, id) GROUP BY 1, 2)
SELECT w.config, round(avg((coalesce(reached, 0) > 0)::INT), 6) AS covered, round(avg(coalesce(reached, 0)), 6) AS relevant_reached FROM w CROSS JOIN k LEFT JOIN h ON h.config = w.config AND h.query_id = k.query_id GROUP BY 1""")
def weight_grid_coverage(spark, sf):
    """What the head under equal weights and that of each other set reach together."""
    heads, gold, kinds = grid_inputs(spark, sf)
    heads = tables.materialise(heads, "heads", 10 * len(GRID) * len(KINDS))
    got = evaluation.grid_coverage(heads.filter("config = 'flat'"), heads, list(GRID), gold, kinds)
    return got.select("config", *[F.round(c, 6).alias(c) for c in ("covered", "relevant_reached")])


# --- names ---------------------------------------------------------------------------------------------

REPO_SQL = "SELECT p_partkey, lower(p_brand) || '/' || replace(p_name, ' ', '-') || CASE p_partkey % 4 WHEN 0 THEN '-' || p_size || 'B-GGUF' WHEN 1 THEN '-' || p_size || '.5m' WHEN 2 THEN '-Q4_K_M' ELSE '-mirror' END AS repo FROM part"


def repos(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_size").cast("string")
    tail = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("-"), n, F.lit("B-GGUF"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("-"), n, F.lit(".5m"))).when(F.col("p_partkey") % 4 == 2, "-Q4_K_M").otherwise("-mirror")
    return p.select("p_partkey", F.concat(F.lower("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), tail).alias("repo"))


@query(f"""WITH r AS ({REPO_SQL}), n AS (SELECT *, split_part(repo, '/', 2) AS name FROM r)
SELECT p_partkey, split_part(repo, '/', 1) AS owner, CASE p_partkey % 4 WHEN 0 THEN 'quantization' WHEN 2 THEN 'quantization' WHEN 3 THEN 'mirror' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN regexp_replace(name, '-GGUF$', '') WHEN 2 THEN regexp_replace(name, '-Q4_K_M$', '') ELSE name END AS stem,
  CASE p_partkey % 4 WHEN 0 THEN regexp_extract(name, '-([0-9]+)B-GGUF$', 1)::BIGINT * 1000000000 WHEN 1 THEN (regexp_extract(name, '-([0-9.]+)m$', 1)::DOUBLE * 1000000)::BIGINT END AS size,
  trim(regexp_replace(name, '[-_]+', ' ', 'g')) AS shown FROM n""")
def name_signals(spark, sf):
    r = F.col("repo")
    return repos(spark, sf).select("p_partkey", naming.owner(r).alias("owner"), naming.variant_kind(r).alias("kind"), naming.stem(r).alias("stem"), naming.size_in_name(r).alias("size"), naming.humanize(r).alias("shown"))


@query(f"""WITH r AS ({REPO_SQL}), n AS (SELECT *, split_part(repo, '/', 2) AS name FROM r), s AS (SELECT p_partkey, split_part(repo, '/', 1) AS owner, CASE p_partkey % 4 WHEN 0 THEN regexp_replace(name, '-GGUF$', '') WHEN 2 THEN regexp_replace(name, '-Q4_K_M$', '') ELSE name END AS stem FROM n)
SELECT p_partkey, trim(regexp_replace(lower(owner), '[^a-z0-9]+', '-', 'g'), '-') || '--' || trim(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '-') AS family_id FROM s""")
def family_ids(spark, sf):
    return repos(spark, sf).select("p_partkey", naming.family_id(F.col("repo")).alias("family_id"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE lang END AS code, trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def language_codes_and_slugs(spark, sf):
    name = F.when(F.col("lang") == "en", " English").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", X.canonical_language(name).alias("code"), X.slug(F.concat("source", F.lit(" "), "lang")).alias("slug"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n >= 3600 THEN 'PT' || (n // 3600) || 'H' ELSE 'PT' END || CASE WHEN n % 3600 // 60 > 0 THEN (n % 3600 // 60) || 'M' ELSE '' END || (n % 60) || 'S' AS duration
FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 60 + l_quantity)::BIGINT AS n FROM lineitem)""")
def iso_durations(spark, sf):
    clock = F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_quantity").cast("long").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.iso_duration(clock).alias("duration"))


# --- event time ----------------------------------------------------------------------------------------


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS requests FROM events""")
def sliding_rate(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return limits.request_rate(e, 3600).select("event_id", "requests")


def clocked(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


@query()
def limiter_decisions(spark, sf):
    """Accepted events alone count, so each decision depends on those before it: checked by brute force in the tests."""
    return limits.client_limits(clocked(spark, sf), limits.Limits(per_minute=1))


@query()
def global_limiter_decisions(spark, sf):
    """One budget for all clients: checked by brute force in the tests."""
    return limits.all_limits(clocked(spark, sf), limits.Limits(per_minute=2, per_hour=10, per_day=100))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS sequence FROM events")
def event_sequence(spark, sf):
    return limits.event_sequence(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("event_id", "sequence")


@query("""WITH x AS (SELECT o_orderdate AS t, 1 AS d FROM orders UNION ALL SELECT o_orderdate + INTERVAL 36 HOUR, -1 FROM orders), s AS (SELECT t, sum(d) AS d FROM x GROUP BY 1)
SELECT t::TIMESTAMP AS changed_at, sum(d) OVER (ORDER BY t)::BIGINT AS active FROM s""")
def concurrent_leases(spark, sf):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return limits.concurrency(table(spark, sf, "orders").select(at.alias("start"), (at + F.expr("INTERVAL 36 HOURS")).alias("end"))).withColumnRenamed("at", "changed_at")
