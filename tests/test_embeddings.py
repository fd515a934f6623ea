import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import embeddings, retrieval


def folder(tmp_path):
    return "file://" + str(tmp_path / "vectors")


def test_a_text_is_embedded_once(spark, tmp_path):
    path, model = folder(tmp_path), embeddings.hash_model(8)
    rows = [(1, "one two"), (2, "one two"), (3, None), (4, "  "), (5, ""), (6, "!?"), (7, "three " * 200_000)]
    first = spark.createDataFrame(rows, "id long, text string")
    assert embeddings.embed_missing(first, path, model) == 3
    assert embeddings.embed_missing(first, path, model) == 0
    more = first.union(spark.createDataFrame([(8, "four"), (9, "one two")], "id long, text string"))
    got = {r.id: r.Vector for r in embeddings.embedded(more.withColumn("VECTOR", F.lit(1)), path, model, vector="Vector").collect()}
    assert len(got) == 9 and embeddings.stored(spark, path, model).count() == 4
    for r in more.withColumn("want", retrieval.hash_embedding(F.col("text"), 8)).collect():
        assert np.allclose(got[r.id], r.want), r.id
    assert got[3] == got[4] == got[5] == got[6] == [0.0] * 8


def test_models_do_not_share_vectors_and_empty_tables_work(spark, tmp_path):
    path = folder(tmp_path)
    none = spark.createDataFrame([], "id long, text string")
    assert embeddings.embedded(none, path, embeddings.hash_model(8)).collect() == []
    one = spark.createDataFrame([(1, "one")], "id long, text string")
    assert embeddings.looked_up(one, path, embeddings.hash_model(8)).first().vector is None
    assert embeddings.embed_missing(one, path, embeddings.hash_model(8)) == 1
    assert embeddings.embed_missing(one, path, embeddings.hash_model(4)) == 1
    assert len(embeddings.looked_up(one, path, embeddings.hash_model(4)).first().vector) == 4


def test_a_run_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    path, model = folder(tmp_path), embeddings.hash_model(8)

    def broken():
        inner = model.load()

        def predict(texts):
            if "bad" in list(texts):
                raise RuntimeError("refused")
            return inner(texts)

        return predict

    embeddings.embed_missing(spark.createDataFrame([("old",)], "text string"), path, model)
    texts = spark.createDataFrame([("good",), ("bad",), ("old",)], "text string")
    with pytest.raises(Exception, match="refused"):
        embeddings.embed_missing(texts, path, embeddings.Model(model.name, 8, broken))
    assert embeddings.stored(spark, path, model).count() == 1
    assert embeddings.embed_missing(texts, path, model) == 2


def test_fields_as_vectors_are_those_without_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red fox", "red fox"), (2, None, "blue"), (3, "red", "")], "id long, name string, body string")
    want = retrieval.field_vectors(rows, "id", ["name", "body"], lambda c: retrieval.hash_embedding(c, 8), 8)
    got = embeddings.embedded_fields(rows, "id", ["name", "body"], folder(tmp_path), embeddings.hash_model(8))
    plain = lambda df: {r.id: [round(x, 9) + 0.0 for x in r.name + r.body] for r in df.collect()}
    assert plain(got) == plain(want)
