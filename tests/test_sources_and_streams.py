import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import predicates
from quarry.operators import evaluation, reports, retrieval
from quarry.sources import readers, tables
from quarry.streaming import limits, refresh

RSS = """<rss xmlns:itunes="http://i"><channel><title>Show</title><link>http://s</link><description>About</description>
<item><title>One &amp; <![CDATA[<b>two</b>]]></title><guid>g1</guid><enclosure url="http://a.mp3" type="audio/mpeg"/><itunes:duration>1:00</itunes:duration></item>
<item><guid>http://guid</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><entry><title>E</title><id>i1</id><link href="http://e"/><content>c</content><updated>2024</updated></entry></feed>"""


def test_documents(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"@graph": [{"url": "u1", "name": "n1"}, "skipped", {"@id": "x3"}, {"description": "no url"}]}))
    (tmp_path / "a.jsonl").write_text('{"id": "i1", "url": "u9", "text": "own"}\n\n{"url": "u1", "name": "later"}\n')
    (tmp_path / "r.rss").write_text(RSS)
    (tmp_path / "f.atom").write_text(ATOM)
    (tmp_path / "g.xml").write_text("<root><book id='7'><title>T</title><tag>a</tag><tag>b</tag></book></root>")
    (tmp_path / ".hidden.json").write_text("{}")
    (tmp_path / "note.txt").write_text("x")
    got = {r.id: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["i1"].text == "own" and got["u1"].name == "later" and got["x3"].name == "x3" and got["urn:quarry:b:4"].site == "b"
    assert got["g1"].url == "http://a.mp3" and json.loads(got["g1"].body)["duration"] == "PT1M0S" and got["g1"].name == "One & two"
    assert got["http://guid"].name == "Episode 2" and json.loads(got["i1"].body)["url"] == "u9"
    assert json.loads(got["7"].body)["tag"] == ["a", "b"] and got["7"].name == "T"
    last = {r.id: r for r in readers.read_documents(spark, str(tmp_path), keep="last").collect()}
    assert last["u1"].name == "n1"
    assert [n for n, _ in readers.list_sources(spark, str(tmp_path))] == ["a.jsonl", "b.json", "f.atom", "g.xml", "r.rss"]


def test_atom(spark, tmp_path):
    (tmp_path / "f.atom").write_text(ATOM)
    r = readers.read_xml_documents(spark, f"{tmp_path}/f.atom").first()
    assert (r.id, r.url, r.name) == ("i1", "http://e", "E") and json.loads(r.body)["isPartOf"]["name"] == "Feed"


def test_jsonl(spark, tmp_path):
    assert readers.read_jsonl(spark, f"{tmp_path}/none", "a int").count() == 0
    readers.write_jsonl(spark.createDataFrame([(1, "x")], "b int, a string"), f"{tmp_path}/out")
    assert readers.read_jsonl(spark, f"{tmp_path}/out", "a string, b int").first() == ("x", 1)
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == '{"a":"x","b":1}\n'


def test_manifest():
    good = {"models": {"m": {"url": "http://h/m.jsonl?x"}}, "sources": {"s": {"url": "http://h/s", "filename": "s.rss"}}}
    assert [(m["filename"], m["section"]) for m in readers.load_manifest(good)] == [("m.jsonl", "models"), ("s.rss", "sources")]
    for bad in ({"x": {}}, {"models": {"m": {"url": "u", "filename": "../m.json"}}}, {"models": {"m": {"url": "u", "filename": "m.exe"}}}, {"models": {"m": {"url": "u"}}, "sources": {"m": {"url": "v"}}}):
        with pytest.raises(ValueError):
            readers.load_manifest(bad)


def test_versions_logs_and_caches(spark, tmp_path):
    t = f"{tmp_path}/table"
    assert tables.current(spark, t) is None
    tables.publish(spark.range(3), t)
    old = tables.current(spark, t)
    tables.publish(spark.range(5), t)
    assert old.count() == 3 and tables.current(spark, t).count() == 5
    with pytest.raises(ValueError):
        tables.publish(spark.range(0), t)
    assert tables.current(spark, t).count() == 5
    for _ in range(2):
        tables.append_log(spark.createDataFrame([("a",)], "k string"), f"{tmp_path}/log")
    first, second = sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/log").collect())
    assert first < second
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("v", F.length("k"))

    wanted = spark.createDataFrame([("a",), ("bb",)], "k string")
    assert {r.k: r.v for r in tables.with_cache(wanted, f"{tmp_path}/cache", compute, ["k"]).collect()} == {"a": 1, "bb": 2}
    tables.with_cache(wanted, f"{tmp_path}/cache", compute, ["k"]).count()
    assert calls == [2, 0]
    state = spark.createDataFrame([("a", "old")], "name string, sha256 string")
    assert {r.name: r.changed for r in tables.changed(spark.createDataFrame([("a", "x"), ("b", "y")], "name string, content string"), state).collect()} == {"a": True, "b": True}


def plain_limits(events, per_minute, per_hour=0, per_day=0):
    accepted, out = [], {}
    for e, c, t in sorted(events, key=lambda x: (x[2], x[0])):
        inside = lambda s, own=None, t=t: [a for a in accepted if a[1] > t - s and (own is None or a[0] == own)]
        full = (per_hour and len(inside(3600)) >= per_hour) or (per_day and len(inside(86400)) >= per_day) or (per_minute and len(inside(60, c)) >= per_minute)
        out[e] = not full
        if not full:
            accepted.append((c, t))
    return out


def test_limits(spark):
    rng = random.Random(6)
    events = [(i, rng.choice("ab"), float(rng.randrange(0, 4000))) for i in range(300)] + [(900, "z", 0.0), (901, "z", 60.0), (902, "z", 59.0)]
    df = spark.createDataFrame(events, "event_id long, client string, ts double")
    assert {r.event_id: r.accepted for r in limits.client_limits(df, limits.Limits(2)).collect()} == plain_limits(events, 2)
    assert {r.event_id: r.accepted for r in limits.all_limits(df, limits.Limits(2, 20, 70)).collect()} == plain_limits(events, 2, 20, 70)
    one = {r.event_id: r for r in limits.client_limits(df.filter("client = 'z'"), limits.Limits(1)).collect()}
    assert one[901].accepted and not one[902].accepted and one[902].retry_after == 1


def test_request_parts(spark):
    df = spark.createDataFrame([("/ask", None, "1.1.1.1", "9.9.9.9"), ("/mcp", '{"method": "tools/call", "params": {"name": "ask"}}', "p", "8.8.8.8, 7.7.7.7"), ("/mcp", "{}", "p", "")], "path string, body string, remote string, fwd string").coalesce(1)
    got = df.select(limits.paid(F.col("path"), F.col("body")).alias("p"), limits.client_key(F.col("remote"), F.col("fwd"), ["p"]).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, "1.1.1.1"), (True, "8.8.8.8"), (False, "p")]


def test_refresh_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "name string, content string, fetched_at int").write.parquet(f"{tmp_path}/in/1")
    state = refresh.RefreshState()
    build = lambda b: refresh.changed_sources(b).filter("content != 'bad'")
    stream = lambda: spark.readStream.schema("name string, content string, fetched_at int").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").writeStream.foreachBatch(refresh.refresher(f"{tmp_path}/t", build, state)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    stream()
    assert [r.content for r in tables.current(spark, f"{tmp_path}/t").collect()] == ["y"]
    spark.createDataFrame([("a", "bad", 3)], "name string, content string, fetched_at int").write.parquet(f"{tmp_path}/in/2")
    stream()
    assert (state.swaps, state.failures) == (1, 1) and [r.content for r in tables.current(spark, f"{tmp_path}/t").collect()] == ["y"]


def test_judges(spark):
    rows = [("q", "a", f"u{i}", x, "") for i, x in enumerate(["strong", "relevant", "exclude", "strong"])] + [("q", "b", f"u{i}", x, "") for i, x in enumerate(["strong", "strong", "exclude", "relevant"])]
    rows += [("r", "a", "u1", "strong", ""), ("r", "b", None, None, "judge b was never called")]
    v = spark.createDataFrame(rows, "query_id string, judge string, url string, relevance string, error string")
    a = evaluation.label_alignment(v).collect()
    assert [(r.query_id, r.compared_records, r.label_agreement) for r in a] == [("q", 4, 0.5)] and a[0].cohens_kappa == 0.2
    got = {r.query_id: (r.agreed, r.in_union, r.agreement) for r in evaluation.judge_agreement(v, full_matrix=True).collect()}
    assert got == {"q": (3, 3, 1.0), "r": (1, 1, 1.0)}
    roll = evaluation.golden_rollup(evaluation.judge_agreement(v, True), evaluation.label_alignment(v), spark.createDataFrame([("r",)], "query_id string")).first()
    assert (roll.compared_records, roll.mean_label_agreement, roll.mean_agreement, roll.mean_agreed_per_query) == (4, 0.5, 1.0, 2.0)
    assert spark.range(1).select(evaluation.unusable_reason(F.lit("j"), F.lit(0.0), F.lit(3))).first()[0] == "judge j made 3 calls at zero cost; likely rejected"


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", i, i) for i in range(1, 11)] + [("z", 1, 1)], "query_id string, id int, rank int").withColumn("family", F.lit("f")).withColumn("has_evidence", F.col("id") == 2)
    gold = spark.createDataFrame([("q", 2, True, False), ("q", 50, True, False), ("q", 3, False, True)], "query_id string, id int, is_gold boolean, is_trap boolean")
    queries = spark.createDataFrame([("q", True), ("z", False)], "query_id string, wants_subject boolean")
    m = {r.query_id: r for r in evaluation.rank_metrics(ranked, gold, queries).collect()}
    assert (m["q"].gold, m["q"].precision, m["q"].rr, m["q"].trap_rate) == (2, 0.1, 0.5, 0.1) and round(m["q"].ndcg, 4) == 0.3869
    assert m["z"].ndcg == 0.0 and m["z"].rr == 0.0
    g = {r.query_id: r for r in evaluation.golden_metrics(ranked, gold, queries).collect()}["q"]
    assert (g.precision_at_k, g.recall_at_k, g.family_diversity, g.trap_rate, g.evidence_backed_fraction) == (0.1, 0.5, 0.1, 0.1, 1.0)


def test_zero_scores_fill_up(spark):
    scores = spark.createDataFrame([("q", 7, 2.0)], "query_id string, id int, score double")
    scope = spark.range(20).select(F.col("id").cast("int").alias("id"))
    got = retrieval.top_k(scores, 4, scope=scope, exclude=spark.createDataFrame([("q", 0)], "query_id string, id int")).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(7, 2.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_saturation_is_single(spark):
    docs = spark.createDataFrame([("a", "cat", "x", "x"), ("b", "x", "x", "cat cat cat"), ("c", "dog", "dog", "dog")], "id string, name string, description string, body string")
    index = retrieval.build_index(docs, "id", ["name", "description", "body"])
    terms = retrieval.query_terms(spark.createDataFrame([("q", "cat"), ("r", "cat cat")], "query_id string, question string"))
    s = {(r.query_id, r.id): r.score for r in retrieval.bm25f(index, terms).collect()}
    assert s["q", "a"] > s["q", "b"] and abs(s["r", "a"] - 2 * s["q", "a"]) < 1e-9 and ("q", "c") not in s


def test_field_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0]), (2, [0.0, 1.0], None)], "id int, name array<double>, body array<double>")
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, vector array<double>")
    assert {r.id: r.score for r in retrieval.vector_scores(v, q, {"name": 3.0, "body": 1.0, "none": 0.0}).collect()} == {1: 1.0, 2: 3.0}
    h = spark.range(1).select(retrieval.hash_embedding(F.lit("a b a")).alias("h"), retrieval.hash_embedding(F.lit("")).alias("z")).first()
    assert abs(sum(x * x for x in h.h) - 1) < 1e-9 and not any(h.z)


def test_more_queries_than_a_block(spark, tiny):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id int, embedding array<double>")
    q = spark.range(0, 10_007, 1, 3).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    got = {(r.query_id, r.id): r.score for r in retrieval.vector_scores(v, q).collect()}
    assert got == {(i, d): float(i) if d == 1 else 2.0 for i in range(10_007) for d in (1, 2)}
    for n, most in ((7, 3), (6, 3), (7, 1)):
        sizes = [b.count() for b in retrieval.blocks(q.limit(n).repartition(4), most)]
        assert sum(sizes) == n and max(sizes) <= most and len(sizes) == -(-n // most)
    e = spark.read.parquet(f"{tiny}/embeddings.parquet")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = [sorted(map(tuple, retrieval.nearest(e, asked, 10, id_col="vec_id", most_queries=m).collect())) for m in (3, 10_000)]
    whole = retrieval.vector_scores(e, asked, id_col="vec_id").withColumn("score", F.round("score", 9))
    assert rows[0] == rows[1] == sorted(tuple(r)[:3] for r in retrieval.top_k(whole, 10).collect()) and len(rows[0]) == 10 * asked.count()


def test_blocked_products_keep_ties_nulls_and_fields(spark):
    rng = random.Random(2)
    some = lambda: None if rng.random() < 0.1 else [float(rng.randrange(3)), None] if rng.random() < 0.1 else [1.0] if rng.random() < 0.1 else [float(rng.randrange(3)), float(rng.randrange(3))]
    for ids in ("string", "long"):
        v = spark.createDataFrame([(None if i == 5 else str(i) if ids == "string" else i, some(), some()) for i in range(200)], f"id {ids}, name array<double>, body array<float>").repartition(5)
        q = spark.createDataFrame([(f"q{i}", None if i == 3 else [float(i % 3), 1.0]) for i in range(7)], "query_id string, vector array<double>")
        weights = {"name": 3.0, "body": 1.0, "none": 0.0}
        want = retrieval.top_k(retrieval.vector_scores(v, q, weights).withColumn("score", F.round("score", 9)), 9).drop("rank")
        assert sorted(map(str, retrieval.nearest(v, q, 9, weights=weights).collect())) == sorted(map(str, want.select("query_id", "id", "score").collect()))
    assert retrieval.nearest(v, q.limit(0), 3, weights=weights).collect() == retrieval.nearest(v.limit(0), q, 3, weights=weights).collect() == []


def test_review_sample(spark):
    rows = [(f"i{k}", f"r{k}", f"f{k % 3}", ["s"] if k % 2 else [], ["en"], 10**6, []) for k in range(12)]
    items = spark.createDataFrame(rows, "id string, repo_id string, family string, subject array<string>, languages array<string>, downloads long, trained_on array<string>")
    strata = spark.createDataFrame([(f"r{k}", "ab"[k % 2]) for k in range(10)], "repo_id string, stratum string")
    got = reports.review_sample(items, strata, 7).collect()
    assert len(got) == 7 and {r.stratum for r in got} == {"a", "b", "unknown"}


def test_unknown_predicates_are_errors(spark):
    with pytest.raises(ValueError):
        predicates.compile_spec(spark.range(1), {"colour_any": ["red"]})
