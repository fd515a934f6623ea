"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, line_dedup, pii, quality, secret_scan, sentencepiece_codec, sharding, simhash, token_counts
from quarry.llm.queries import QUERIES, model_file

LONG = "Le mot est long. " * 30_000
ROWS = [(1, "a line\nsame\nsame", "s", "x"), (2, None, "s", "x"), (3, "", None, "x"), (4, LONG, "s", None), (5, "twice", "t", "x"), (5, "twice", "t", "x"), (None, "no id é", "s", "x"), (7, " \n\t ", "s", "x")]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["fp", "component_id", "n_words", "kept", "quality_", "found_", "shard", "clean_text", "n_lines", "hilbert", "keys_", "pieces", "root_", "node_", "root", "node", "row_", "gone_", "clean_text_", "kept_", "n_lines_", "found", "d", "made_"]
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "mot est"), (1, "mot est"), (2, None), (3, ""), (4, "never seen")], "item_id long, text string")


def operators(labels, items):
    return {
        "lines": lambda d: line_dedup.drop_lines(d),
        "decontaminate": lambda d: decontamination.find_contamination(d, items),
        "cut": lambda d: decontamination.remove_contamination(d, items),
        "simhash": lambda d: simhash.near_duplicates(d),
        "keep_one": lambda d: simhash.keep_one(d),
        "quality": lambda d: quality.rate_documents(d, labels),
        "keep_good": lambda d: quality.keep_good(d, labels),
        "tokens": lambda d: token_counts.count_tokens(d, model_file()),
        "pii": lambda d: pii.pseudonymise(d, "k"),
        "pieces": lambda d: sentencepiece_codec.encode_column(d, model_file()),
        "encoded": lambda d: sentencepiece_codec.encoded_documents(d, model_file()),
        "digests": lambda d: sentencepiece_codec.encoding_digests(d, model_file()),
        "secrets": lambda d: secret_scan.scan_frame(d),
        "shards": lambda d: sharding.hilbert_shards(d.select("doc_id", "source", "lang", "shard"), ["source", "lang"], ties=["doc_id"]),
    }


@pytest.mark.parametrize("name", ["lines", "decontaminate", "cut", "simhash", "keep_one", "quality", "keep_good", "tokens", "pii", "pieces", "encoded", "digests", "secrets", "shards"])
def test_odd_rows_and_empty_tables(docs, labels, items, name):
    op = operators(labels, items)[name]
    full, none = op(docs).collect(), op(docs.limit(0))
    assert none.collect() == []
    assert len(none.columns) == len(set(none.columns))
    filtering = {"cut": (len(ROWS) - 1, len(ROWS)), "keep_one": (4, 5), "keep_good": (0, 1)}
    low, high = filtering.get(name, (len(ROWS), len(ROWS)))
    assert low <= len(full) <= high


def test_defined_results(docs, labels, items):
    ops = operators(labels, items)
    lines = {r.doc_id: r for r in ops["lines"](docs).collect()}
    assert lines[2].clean_text is None and lines[2].n_lines == 0 and lines[3].clean_text == "" and lines[3].n_lines == 1
    found = {r.doc_id: r.found for r in ops["decontaminate"](docs).collect()}
    assert found[2].n_words == 0 and found[4].n_hit == 60_000 and found[4]["items"] == ["1"]
    assert 4 not in {r.doc_id for r in ops["cut"](docs).collect()}
    groups = {r.doc_id: r for r in ops["simhash"](docs).collect()}
    assert groups[2].fp == groups[3].fp == groups[7].fp == 0 and groups[7].component_id == 2
    rated = {r.doc_id: r for r in ops["quality"](docs).collect()}
    assert rated[2].n_words == 0 and rated[2].base_failed and not rated[2].kept and rated[1].n_dup_lines == 1
    assert rated[4].n_repeat_words == rated[4].n_words == 120_000
    pieces = {r.doc_id: r.pieces for r in ops["pieces"](docs).collect()}
    assert pieces[2].n_tokens == 0 and pieces[2].decoded == "" and pieces[4].decoded == LONG


def test_without_trusted_documents_or_items_nothing_is_lost(docs, labels, items, spark):
    model = quality.fit(docs.select("doc_id", "text"), labels.limit(0))
    assert model.threshold == 0 and not model.ratio.any()
    assert decontamination.remove_contamination(docs, items.limit(0)).count() == len(ROWS)


def test_host_lines(spark):
    rows = [(i, f"own {i}\n menu \n\nmenu", "h") for i in range(6)] + [(10 + i, f"menu\nother {i}", "g") for i in range(4)]
    got = {r.doc_id: r for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].clean_text == "own 0\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2)
    assert got[10].clean_text == "menu\nother 0"  # four pages are too few


@pytest.fixture(scope="module")
def folders(docs, labels, items, spark, tmp_path_factory):
    """Tables like the driver's with odd rows and clashing columns, and the same without rows."""
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, None, None), (2, None, None), (None, "http://b", "x"), (4, "", LONG), (-9 * 10**18, "u", "x"), (9 * 10**18, "u", "")], "page_id long, url string, html string")
    for name in ("shard", "digest", "payload", "step", "kind", "cuts"):
        pages = pages.withColumn(name, F.lit("clash"))
    vectors = spark.createDataFrame([(i, [1.0 * i, 2.0]) for i in range(len(ROWS))], "vec_id long, embedding array<float>")
    out = []
    for kind in ("odd", "empty"):
        top = tmp_path_factory.mktemp(kind)
        for name, df in (("documents", docs), ("labels", labels), ("benchmark", items), ("pages", pages), ("embeddings", vectors)):
            (df if kind == "odd" else df.limit(0)).coalesce(1).write.parquet(f"file://{top}/{name}.parquet")
        out.append(f"file://{top}")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_on_odd_and_empty_tables(spark, folders, name):
    odd, none = (QUERIES[name](spark, f) for f in folders)
    assert odd.count() == {"op8_warc": 7, "op11_whitening": 2 * len(ROWS)}.get(name, len(ROWS))
    assert none.collect() == [] and none.columns == odd.columns


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_and_empty_tables(spark, folders, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, spark.read.parquet(f"{folders[0]}/documents.parquet"), folders[0])
    rows = got.collect()
    least, most = {"quality_rules": (0, 1), "simhash_near_dedup": (4, 5), "benchmark_decontamination": (len(ROWS) - 1,) * 2}.get(name, (len(ROWS),) * 2)
    assert least <= len(rows) <= most
    none = stage(spark, spark.read.parquet(f"{folders[1]}/documents.parquet"), folders[1])
    assert none.collect() == []
    if k < 4:
        assert got.columns == none.columns == docs.columns
        extra = [c for c in docs.columns if c not in ("doc_id", "text", "source", "lang")]
        assert all(r[c] == "clash" for r in rows for c in extra)
