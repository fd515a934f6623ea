import json

from pyspark.sql import functions as F

from quarry.operators import records, retrieval
from quarry.plans import corpus, search
from quarry.sources import hub


def test_ask(spark):
    rows = [(f"d{i}", f"u{i}", n, "s" if i < 4 else "t", d, d) for i, (n, d) in enumerate([("Whale songs", "whales sing"), ("whale  SONGS", "whales again"), ("Cats", "cats purr"), ("Whales", "big whale song"), ("Far whale", "whale elsewhere"), ("Dogs", "bark")])]
    docs = spark.createDataFrame(rows, "id string, url string, name string, site string, description string, body string")
    index = retrieval.build_index(docs, "id", ["name", "description", "body"])
    requests = spark.createDataFrame([("q", "whale songs", "s", None), ("e", "  ", None, None), ("p", "and songs?", "all", ["whale"])], "query_id string, question string, site string, previous array<string>")
    judge = lambda c: retrieval.stub_judge(c, retrieval.query_terms(search.last_questions(requests)))
    got = search.ask(requests, docs, index, judge).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.id, r.band) for r in got if r.query_id == "q"][0] == ("q", "d0", "strong")
    assert {r.query_id for r in got} == {"q", "p"} and all(r.site == "s" for r in got if r.query_id == "q")
    names = [r.name.lower().split() for r in got if r.query_id == "q"]
    assert len({tuple(n) for n in names}) == len(names)
    plain = search.ask(requests, docs, index)
    assert {r.relevance for r in plain.collect()} == {"retrieval"}
    cands = search.candidates(search.last_questions(requests.filter(search.valid(requests))), docs, index, search.Widths())
    answers = search.answer(plain)
    assert answers.filter("query_id = 'q'").first().answer.startswith("The most relevant records are Whale songs")
    told = search.events(requests, cands, plain, answers).orderBy("query_id", "sequence").collect()
    assert [(r.sequence, r.type) for r in told if r.query_id == "e"] == [(1, "error")]
    mine = [r.type for r in told if r.query_id == "q"]
    assert mine[0] == "start" and mine[-2:] == ["answer", "end"] and mine == sorted(mine, key=["start", "candidate", "result", "answer", "end"].index)
    vectors = docs.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    qv = spark.createDataFrame([("q", [1.0, 0.0]), ("p", [1.0, 0.0])], "query_id string, vector array<double>")
    both = search.candidates(requests.filter("query_id = 'q'"), docs, index, search.Widths(retrieve=2), vectors=vectors, query_vectors=qv)
    assert sorted(r.channel for r in both.collect()) == ["bm25", "bm25", "vector", "vector"] and both.select("id").distinct().count() == 4


def test_latest_shown(spark):
    df = spark.createDataFrame([("q", "u", "s", "a", 1, False), ("q", "u", "s", "b", 3, False), ("q", "u", "s", "c", 2, True), ("q", "", "s", "n", 4, False)], "query_id string, url string, site string, name string, sequence int, final boolean")
    assert sorted(r.name for r in search.latest_shown(df).collect()) == ["c", "n"]


def repo(i, name, downloads, **more):
    return {"id": name, "author": name.split("/")[0], "sha": "f" * 40, "pipeline_tag": "text-generation", "library_name": "transformers", "tags": ["en"], "downloads": downloads, "likes": i, "trendingScore": 0.0, "createdAt": "2023-01-01T00:00:00Z", "lastModified": "2023-06-01T00:00:00Z", "gated": "false", "private": False, "disabled": False, **more}


def test_build(spark):
    raws = [repo(i, f"org{i}/Model-{i}B", 100 * i) for i in range(1, 6)] + [repo(6, "org1/Model-1B-GGUF", 5), repo(7, "org9/Empty", 7)]
    raw = spark.read.schema(records.raw_schema()).json(spark.sparkContext.parallelize([json.dumps(r) for r in raws]))
    strata = {"chat": [{"pipeline_tag": "text-generation"}, {"search": "model", "sort": "likes"}], "other": [{"language": "en", "sort": "createdAt"}]}
    from quarry.operators.selection import pool

    found = pool(hub.discover(raw, strata, {"chat": 10, "other": 2})).select("repo_id", "found_by")
    assert found.count() == 7
    card = "# About\n" + "This model writes careful text about law and other matters for readers. " * 6
    texts = spark.createDataFrame([(r["id"], card if "Empty" not in r["id"] else "short") for r in raws], "repo_id string, raw string")

    def enrich(clean):
        base = clean.select("repo_id")
        claims = base.select("repo_id", F.lit("subject_area").alias("kind"), F.lit("legal").alias("label"), F.lit("high").alias("confidence"), F.lit("intended_for").alias("evidence_type"), F.lit("careful text about law").alias("evidence_quote"))
        none = F.array().cast("array<string>")
        return claims, base.select("repo_id", F.lit("Writes.").alias("short_description"), none.alias("intended_uses"), none.alias("limitations"), none.alias("deployment_notes"), F.array(F.lit("English")).alias("languages"))

    policy = corpus.Policy({"chat": 4, "other": 1}, 6, "2024-01-01 00:00:00", {"publisher_max_fraction": 1.0, "family_max_records": 4, "diversity_reserve_fraction": 0.15}, {"legal": "law"})
    out = corpus.build(raw, found, texts, policy, enrich)
    log = {r.repo_id: (r.decision, r.reason) for r in out["decisions"].collect()}
    assert len(log) == 7 and log["org1/Model-1B-GGUF"] == ("suppressed", "suppressed_variant") and log["org9/Empty"] == ("excluded", "excluded_empty_card")
    items = {r.repo_id: r for r in out["items"].collect()}
    assert set(items) == {f"org{i}/Model-{i}B" for i in range(1, 6)} and items["org1/Model-1B"].subject == ["law"] and items["org1/Model-1B"].variant == ["https://huggingface.co/org1/Model-1B-GGUF"]
    assert {(r.dimension, r.value): r.n for r in out["composition"].collect()}["parameter_band", "1B-4B"] == 3
    one = corpus.snapshot(out["items"], "s", "2024").first()
    assert one.records == 5 and one.content_sum == corpus.snapshot(out["items"].repartition(3), "s", "2024").first().content_sum


def test_hub_rules():
    assert hub.label("a", {"search": "x", "language": "en"}) == "a:language=en,search=x,sort=downloads"
    assert [hub.retry_plan(s, 1) for s in (None, 429, 503, 404)] == [1.0, 1.0, 1.0, None] and hub.retry_plan(429, 2, "7") == 7.0 and hub.retry_plan(500, 4) is None
    assert [hub.card_status(*a) for a in ((200, 5, False), (200, 10**7, False), (404, None, False), (403, None, True), (500, None, False))] == ["ok", "too_large", "missing_readme", "gated", "error"]
