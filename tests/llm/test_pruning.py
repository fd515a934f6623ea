"""Shards along the curve are pruned by every dimension, whatever its number of values."""

from pyspark.sql import functions as F

from quarry.llm import sharding
from quarry.llm.queries import table


def test_shards_are_pruned_by_dimensions_of_few_values(spark):
    """Sixteen shards by three dimensions: evenly shared, each dimension's values would be in 16 ** (-1 / 3), or 0.40, of them."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "source", "lang", F.length("text").cast("long").alias("size"))
    placed = sharding.hilbert_shards(docs, ["source", "lang", "size"], 16, ties=["doc_id"]).select("source", "lang", "shard").distinct().collect()
    for dim, most in (("lang", 0.6), ("source", 0.45)):
        held = {}
        for r in placed:
            held.setdefault(r[dim], set()).add(r.shard)
        assert sum(map(len, held.values())) / 16 / len(held) <= most
