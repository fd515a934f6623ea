"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes what the stage before it kept, written as Parquet and read again, and returns the columns of
``documents``; the last returns the encoded documents.

All stages: an empty table gives no rows; texts are taken whole, however long; extra columns are kept as they are, whatever
they are called, but in the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, line_dedup, quality, sentencepiece_codec, simhash
from quarry.llm.common import fresh
from quarry.llm.queries import model_file, table
from quarry.sources.tables import scratch


def counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``, ``n_chars`` (where there is one) being that of the new text; null for a null text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and so do null, empty and short texts.  Repeated rows are judged each; a null id is one without a label."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a large share of a source's documents have are dropped from texts; every document stays.

    A null text stays null, a text without any other line becomes ''.  Each repeated row is a page; a null source is a source.
    """
    kept, n_lines, n_dropped = (fresh(docs, c) for c in ("kept_", "n_lines_", "n_dropped_"))
    out = line_dedup.drop_lines(docs, kept=kept, n_lines=n_lines, n_dropped=n_dropped)
    return counted(out.withColumn("text", F.col(kept)), docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays; of rows with that id one.  Null, empty and word-less texts are one group."""
    return simhash.keep_one(docs)


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the passages of the benchmark are cut.  Null and empty texts stay."""
    return counted(decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with the source bytes at which they end, and digests of ids and decoded text; a null text is encoded like an empty one."""
    return sentencepiece_codec.encoded_documents(docs, model_file())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", remove_benchmark_text),
    ("sentencepiece_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = scratch(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


#: Hashes of shingles and the model's segmentation can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
