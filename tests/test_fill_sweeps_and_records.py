import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import predicates
from quarry.functions import text as X
from quarry.operators import evaluation, records, retrieval, selection
from quarry.sources import readers, tables
from quarry.streaming import limits


def test_top_k_fills_up_after_exclusion(spark):
    scores = spark.createDataFrame([("q", i, 100.0 - i) for i in range(20)], "query_id string, id long, score double")
    scope = spark.range(200)
    exclude = spark.createDataFrame([("q", i) for i in range(15)], "query_id string, id long")
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in retrieval.top_k(scores, 10, scope, exclude, queries).collect())
    assert [x[2] for x in got if x[0] == "q"] == [15, 16, 17, 18, 19, 20, 21, 22, 23, 24]
    assert [x[2:] for x in got if x[0] == "none"] == [(i, 0.0) for i in range(10)]


def test_top_k_fills_up_within_a_site(spark):
    scores = spark.createDataFrame([("q", 3, 1.0), ("q", 4, 2.0), ("all", 4, 1.0)], "query_id string, id long, score double")
    scope = spark.range(12).withColumn("site", F.when(F.col("id") % 2 == 1, "odd").otherwise("even"))
    queries = spark.createDataFrame([("q", "odd"), ("all", None), ("gone", "nowhere")], "query_id string, site string")
    got = {}
    for r in retrieval.top_k(scores, 4, scope, queries=queries).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {"q": [3, 1, 5, 7], "all": [4, 0, 1, 2]}


def test_running_sums_of_groups_with_ties_and_nulls(spark):
    rows = [("a", v, n) for v, n in ((None, 2), (1.0, 1), (2.0, 5), (7.0, 1))] + [(None, 3.0, 4), ("b", 1.0, 1)]
    got = {(r.g, r.v): (r.upto, r.all) for r in selection.running(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", "n", "upto", "all").collect()}
    assert got == {("a", None): (2, 9), ("a", 1.0): (3, 9), ("a", 2.0): (8, 9), ("a", 7.0): (9, 9), (None, 3.0): (4, 4), ("b", 1.0): (1, 1)}


def test_unions_of_frames_that_are_partitioned_alike(spark):
    from pyspark.sql.window import Window

    a = spark.range(400).select((F.col("id") % 40).alias("k"), "id").withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    both = tables.united(a.filter("n < 3"), a.filter("n between 2 and 5"))
    assert sorted(r["count"] for r in both.groupBy("k").count().collect()) == [6] * 40


def test_leased_limits_by_brute_force(spark):
    events = [(i, f"c{i % 3}", float(i * 7 % 50 + i // 4), float(i * 7 % 50 + i // 4 + i % 9)) for i in range(120)]
    rules = limits.Limits(per_minute=8, per_hour=20, running=2)
    got = {r.event_id: (r.accepted, r.reason) for r in limits.leased_limits(spark.createDataFrame(events, "event_id long, client string, ts double, end double"), rules).collect()}
    taken, ends = [], []
    for e, c, t, end in sorted(events, key=lambda x: (x[2], x[0])):
        while ends and ends[0] <= t:
            heapq.heappop(ends)
        hour = [x for x in taken if x[1] > t - 3600]
        own = [x for x in taken if x[0] == c and x[1] > t - 60]
        why = "running" if len(ends) >= 2 else "hour" if len(hour) >= 20 else "client" if len(own) >= 8 else None
        assert got[e] == (why is None, limits.REASONS.get(why))
        if why is None:
            taken.append((c, t))
            heapq.heappush(ends, end)
    assert {g[1] for g in got.values()} == {None, limits.REASONS["running"], limits.REASONS["hour"]}


@pytest.mark.parametrize(("rules", "segment_events"), [((2, 6, 30, 0), 30), ((1, 5, 0, 2), 45), ((0, 0, 0, 1), 10**6), ((3, 0, 25, 3), 60), ((2, 6, 30, 2), 10**6)])
def test_limits_by_chunks_and_segments(spark, rules, segment_events):
    rng, rules = random.Random(segment_events), limits.Limits(*rules)
    events = []
    for day in (0, 1, 2, 5, 9, 10):  # bursts with pauses that are longer than the windows, and some that are not
        t = day * 86400.0 + rng.randrange(3600)
        for _ in range(35):
            t += rng.choice([0.0, 1.0, 20.0, 59.0, 60.0, 900.0])
            events.append((len(events), rng.choice(["a", "b", None]), t, t + rng.choice([0.0, 5.0, 400.0, 90000.0])))
    events.append((len(events), "a", None, 1.0))
    df = spark.createDataFrame(events, "event_id long, client string, ts double, end double").repartition(3)
    got = {r.event_id: (r.accepted, r.reason) for r in limits.leased_limits(df, rules, segment_events).collect()}
    taken = []
    for e, c, t, end in sorted(events[:-1], key=lambda x: (x[2], x[0])):
        near = lambda s, t=t: [x for x in taken if x[1] > t - s]
        full = lambda n, most: 0 < most <= n
        why = "running" if full(sum(x[2] > t for x in taken), rules.running) else "hour" if full(len(near(3600)), rules.per_hour) else "day" if full(len(near(86400)), rules.per_day) else None
        why = why or ("client" if full(sum(x[0] == c for x in near(60)), rules.per_minute) else None)
        assert got.pop(e) == (why is None, limits.REASONS.get(why)), (rules, e)
        if why is None:
            taken.append((c, t, end))
    assert got == {events[-1][0]: (None, None)}
    assert limits.leased_limits(df.limit(0), limits.Limits(1, 1, 1, 1)).collect() == []


def test_pauses_make_chunks(spark):
    rows = spark.createDataFrame([(float(d * 86400 + k), 0.0) for d in (0, 1, 5, 6, 9) for k in range(4)], "ts double, end double")
    assert sorted({(r.chunk_, r.rows_) for r in limits.paused(rows, limits.Limits(1, 0, 1)).collect()}) == [(1, 8), (2, 8), (3, 4)]
    held = rows.withColumn("end", F.when(F.col("ts") == 3, 86400.0 * 7))
    assert {r.chunk_ for r in limits.paused(held, limits.Limits(1, 0, 1, 1)).collect()} == {1, 2}


def test_published_record_leaves_out_what_is_empty(spark):
    schema = "id string, repo_id string, name string, url string, description string, revision string, date_modified string, creator struct<`@type`: string, name: string>, languages array<string>, keywords array<string>, subject array<string>, downloads long, mixture_of_experts boolean, canonical string"
    rows = [("https://h/a", "a", "A", "https://h/a", "d", "v", "2024", ("Organization", "o"), ["en", "no"], [], None, 0, False, ""), ("https://h/b", "b", "B", "https://h/b", "d", None, "", ("Organization", "o"), None, ["k"], ["law"], 5, True, "https://h/a")]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in records.validate_json(df.withColumn("body", records.json_ld(df))).collect()}
    a, b = (json.loads(got[k].body) for k in ("https://h/a", "https://h/b"))
    assert a["@context"] == {"@vocab": "https://schema.org/", "hf": "https://huggingface.co/ns/1.0#"} and a["@type"] == ["SoftwareApplication", "hf:Model"]
    assert a["hf:downloads"] == 0 and a["hf:mixtureOfExperts"] is False and not {"keywords", "hf:subject", "hf:canonical"} & set(a)
    assert b["hf:subject"] == ["law"] and b["hf:canonical"] == "https://h/a" and "inLanguage" not in b
    assert got["https://h/a"].errors == [] and got["https://h/b"].errors == ["dateModified is required for provenance", "hf:revision is required for provenance"]


def test_metadata_only_profile(spark):
    item = spark.createDataFrame([("u", "n", "o/n", ["C"], "t", ["k"], "lib", "long text", ["law"])], "id string, name string, repo_id string, category array<string>, task string, keywords array<string>, library string, description string, subject array<string>")
    assert records.evaluation_fields(item).columns == ["id", "name", "subcategory", "subject", "capability", "keywords", "description", "evidence", "publisher", "notes"]
    r = records.evaluation_fields(item, "metadata_only").first()
    assert tuple(r) == ("u", "n o/n", "C t", "k lib", "")


def test_sweeps(spark):
    gold = spark.createDataFrame([("q", 1, True, False), ("q", 2, False, True)], "query_id string, id long, is_gold boolean, is_trap boolean")
    queries = spark.createDataFrame([("q", "known-item")], "query_id string, category string")
    rank = lambda w: spark.createDataFrame([("q", 1, 1 if w["name"] > 1 else 2), ("q", 2, 2 if w["name"] > 1 else 1)], "query_id string, id long, rank int")
    got = {(r.config, r.group): r.mrr for r in evaluation.sweep(rank, {"high": {"name": 2.0}, "low": {"name": 1.0}}, gold, queries, F.lit(100)).collect()}
    assert got["high", "known-item"] == 1.0 and got["low", "known-item"] == 0.5


def test_loaders():
    assert predicates.load_queries('{"queries": [{"id": "a", "question": "x"}]}') == [{"id": "a", "question": "x"}]
    with pytest.raises(ValueError):
        predicates.load_queries('[{"id": "a"}]')
    assert readers.settings("# c\nA=1\nB = 'two'\nnothing\nC=\"x=y\"\n", {"A": "0"}) == {"A": "0", "B": "two", "C": "x=y"}


def test_thread_titles(spark):
    df = spark.createDataFrame([("  a \n b ",), ("x" * 72,), ("y" * 73,)], "q string").coalesce(1)
    assert [r[0] for r in df.select(X.thread_title(F.col("q"))).collect()] == ["a b", "x" * 72, "y" * 71 + "…"]


def test_small_files_are_replaced_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/CURRENT.json"
    for word in ("one", "two"):
        tables.write_small(spark, path, word)
        assert tables.read_text(spark, path) == word
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["CURRENT.json"]


def test_few_files_for_bounded_tables_and_none_after_removal(spark):
    df = tables.materialise(spark.range(1000).repartition(8), "few", 1000)
    files = df.inputFiles()
    assert len(files) == 1 and df.count() == 1000
    tables.remove(df)
    assert not tables.exists(spark, files[0])


def test_a_grid_of_weights_is_as_many_rankings(spark):
    rng = random.Random(5)
    word = lambda n: " ".join(rng.choice("alpha beta gamma delta zeta".split()) for _ in range(n))
    docs = spark.createDataFrame([(i, word(rng.randint(0, 3)), word(rng.randint(0, 12))) for i in range(150)] + [(150, None, None)], "id long, name string, body string")
    terms = retrieval.query_terms(spark.createDataFrame([("a", "alpha alpha zeta"), ("b", "gamma"), ("none", "omega")], "query_id string, question string"))
    index = retrieval.build_index(docs, "id", ["name", "body"], terms)
    grid = {"flat": {"name": 1.0, "body": 1.0}, "names": {"name": 3.0, "body": 0.0}, "nothing": {"name": 0.0, "body": 0.0}}
    got = {}
    for r in retrieval.bm25f_grid(index, terms, grid).collect():
        got.setdefault(r.config, {})[r.query_id, r.id] = round(r.score, 9)
    for name, weights in grid.items():
        assert got.get(name, {}) == {(r.query_id, r.id): round(r.score, 9) for r in retrieval.bm25f(index, terms, weights).collect()}
    assert "nothing" not in got
    with pytest.raises(ValueError):
        retrieval.bm25f_grid(index, terms, {})

    asked = spark.createDataFrame([("a", "descriptive"), ("b", "known-item"), ("none", "descriptive")], "query_id string, category string")
    gold = docs.filter("id % 3 = 0").select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("query_id"), "id", F.lit(True).alias("is_gold"), F.lit(False).alias("is_trap"))
    heads = evaluation.grid_heads(retrieval.bm25f_grid(index, terms, grid).withColumn("score", F.round("score", 9)))
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r.config, r.group, r.n, r.p_at_10, r.mrr, r.ndcg_at_10)) for r in df.collect())
    rank = lambda w: retrieval.top_k(retrieval.bm25f(index, terms, w).withColumn("score", F.round("score", 9)), 10)
    assert plain(evaluation.grid_sweep(heads, list(grid), gold, asked, F.lit(151), broad=1.0)) == plain(evaluation.sweep(rank, grid, gold, asked, F.lit(151), broad=1.0))
    flat = heads.filter("config = 'flat'").drop("config")
    both = {r.config: (r.covered, r.relevant_reached) for r in evaluation.grid_coverage(flat, heads, list(grid), gold, asked).collect()}
    ids = {}
    for r in heads.collect():
        ids.setdefault((r.config, r.query_id), set()).add(r.id)
    for c in grid:
        n = [sum(i % 3 == 0 for i in ids.get((c, q), set()) | ids.get(("flat", q), set())) if q != "none" else 0 for q in ("a", "b", "none")]
        assert both[c] == (sum(x > 0 for x in n) / 3, sum(n) / 3)
