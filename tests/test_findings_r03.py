"""Findings of the third round, each by a small case that failed before."""

from quarry.llm import quality
from quarry.operators import families, records, retrieval
from quarry.plans import result_queries
from quarry.sources import readers


def test_citations_by_record_and_once(spark):
    """one id may stand for two records' papers; a paper that was fetched twice is cited once."""
    items = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1"]), ("c", ["1"])], "repo_id string, arxiv_ids array<string>")
    told = lambda papers: {r.repo_id: [(c.url.rpartition("/")[2], c.name) for c in r.citations] for r in records.cite(items, papers).collect()}
    own = spark.createDataFrame([("a", "1", "A", "x"), ("b", "1", "B", "y")], "repo_id string, arxiv_id string, title string, abstract string")
    assert told(own) == {"a": [("1", "A"), ("2", None)], "b": [("1", "B")], "c": [("1", None)]}
    twice = spark.createDataFrame([("1", "A", "x"), ("1", "B", "y"), ("2", None, "z")], "arxiv_id string, title string, abstract string")
    assert told(twice) == {"a": [("1", "B"), ("2", None)], "b": [("1", "B")], "c": [("1", "B")]}


def test_all_abstracts_of_an_id(spark, tmp_path):
    """every entry is a row if all are asked for, of ids that come twice too."""
    entry = "<entry><id>http://arxiv.org/abs/2401.10000v{0}</id><title>T{0}</title><summary>s</summary></entry>"
    (tmp_path / "a.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'>" + entry.format(1) + entry.format(2) + "</feed>")
    assert sorted(r.title for r in readers.read_abstracts(spark, str(tmp_path), keep="all").collect()) == ["T1", "T2"]
    assert [r.title for r in readers.read_abstracts(spark, str(tmp_path)).collect()] == ["T2"]


def test_no_table_of_records_is_broadcast(spark, tmp_path):
    """joins over all records shuffle; as broadcasts they were built in the driver."""
    df = spark.createDataFrame([("a/x", ["b/y"], "s", "arch", 1, "t", 5, ""), ("b/y", None, "s", "arch", 1, "t", 3, "")], "repo_id string, base_models array<string>, card_sha string, architecture string, parameters long, model_type string, downloads long, created string")
    df.write.parquet(f"{tmp_path}/records")
    df = spark.read.parquet(f"{tmp_path}/records")  # of a known, small size
    variants = spark.createDataFrame([("a/x-GGUF",)], "repo_id string")
    for out in (families.lineage_roots(families.parents(df), hops=7), families.exact_duplicates(df), families.resolve(df, variants)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.repo_id: (r.family_id, r.canonical_repo_id) for r in families.resolve(df, variants).collect()} == {"a/x": ("b--y", "a/x"), "b/y": ("b--y", "a/x"), "a/x-GGUF": ("a--x", "")}


def test_many_files_are_read_together(spark, tmp_path):
    """files of one kind are one read; the order is that of names, records and lines, of names with escaped signs too."""
    for k in range(12):
        (tmp_path / f"b{k:02d}.json").write_text('[{"url":"u","name":"n%d"},{"url":"u","name":"again"},{"url":"v%d"}]' % (k, k))
        (tmp_path / f"c {k:02d}+.jsonl").write_text('{"url":"u","name":"line"}\n{"url":"w","name":"w%d"}\n{"url":"w","name":"again"}\n' % k)
        (tmp_path / f"d{k:02d}.xml").write_text("<r><x><name>x%d</name><url>w</url></x><x><name>y%d</name><url>z</url></x></r>" % (k, k))
    first, last = ({r.id: r.name for r in readers.read_documents(spark, str(tmp_path), keep=keep).collect()} for keep in ("first", "last"))
    assert (first["u"], first["w"], first["z"], len(first)) == ("n0", "w0", "y0", 15)
    assert (last["u"], last["w"], last["z"]) == ("line", "x11", "y11")
    assert readers.read_documents(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("FileScan text") < 10


def test_only_asked_tokens_are_indexed(spark, tiny, monkeypatch):
    """F8: the index of a few questions has their tokens alone."""
    made, build = [], retrieval.build_index
    monkeypatch.setattr(retrieval, "build_index", lambda *a, **k: made.append(build(*a, **k)) or made[-1])
    result_queries.asked_without_judge(spark, tiny)
    assert 0 < made[0].terms.count() <= retrieval.query_terms(result_queries.asked(spark)).select("token").distinct().count()


def test_all_trusted_documents_count(spark):
    """counts and threshold are of every trusted document, however many there are."""
    import inspect

    assert "most" not in inspect.signature(quality.fit).parameters
    scores = spark.createDataFrame([(float(v % 997) + v / 1e6,) for v in range(3000)], "score double")
    ranked = sorted(r[0] for r in scores.collect())
    for share in (0.0, 0.001, 0.01, 0.5):
        assert quality.nth_score(scores, share, many=100) == quality.nth_score(scores, share) == ranked[int(share * 3000)]
    texts = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(60))) for i in range(40)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    few, all_ = (quality.fit(docs, labels, n=64, many=m) for m in (3, 100))
    assert few.threshold == all_.threshold and (few.ratio == all_.ratio).all()
    part = quality.fit(docs, labels.filter("doc_id < 10"), n=64)
    assert not (part.ratio == all_.ratio).all()


def test_records_are_parsed_once(spark):
    """checks share one parse of a record, and one listing of its members."""
    plan = records.validate_json(spark.createDataFrame([("{}",)], "body string"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert 1 <= plan.count("parsejson") + plan.count("parse_json") <= 2 and plan.count("json_object_keys") + plan.count("jsonobjectkeys") <= 2
