"""Vectors of texts from a model, kept in a table by content: a text is embedded once, however often it comes and whoever asks.

The table is Parquet under a folder for each model: (digest, vector).  The same table serves documents' fields, abstracts and queries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.tables import content_key, empty, exists

#: A table's columns.
VECTORS = "digest string, vector array<double>"


@dataclass(frozen=True)
class Model:
    """``load`` runs once in each worker and returns a function from an array of texts to an array of vectors, one a row.

    ``name`` must change whenever the vectors would: it is the folder of the vectors in the table.
    """

    name: str
    dims: int
    load: Callable[[], Callable[[np.ndarray], np.ndarray]]
    batch: int = 64


def hash_model(dims: int = 384) -> Model:
    """The stand-in of ``retrieval.hash_embedding`` as a model: signed token counts at md5 places, of length 1."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        places: dict[str, tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            if token not in places:
                if len(places) >= 1 << 16:  # bounded, whatever the vocabulary
                    places.clear()
                digest = hashlib.md5(token.encode()).hexdigest()
                places[token] = int(digest[:8], 16) % dims, -1.0 if int(digest[8], 16) % 2 else 1.0
            return places[token]

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for row, text in zip(out, texts, strict=True):
                for m in re.finditer("[a-z0-9]+", text.lower()):
                    at, sign = place(m.group())
                    row[at] += sign
                length = np.sqrt((row * row).sum())
                if length:
                    row /= length
            return out

        return predict

    return Model(f"hash-{dims}", dims, load)


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def stored(spark: SparkSession, path: str, model: Model) -> DataFrame:
    """(digest, vector) of what the table holds for a model."""
    folder = f"{path}/{model.name}"
    return spark.read.schema(VECTORS).parquet(folder) if exists(spark, folder) else empty(spark, VECTORS)


def embed_missing(texts: DataFrame, path: str, model: Model, text: str = "text") -> int:
    """Embed the texts that the table has not got, append their vectors, and return for how many the model was asked.

    A text counts once, however many rows have it; null and blank texts are never asked.  Copies meet as digests beside one text, summed
    in each task before the shuffle.  The append is one job's commit: a run that dies leaves the table as it was, and the next one
    asks again.  Calls are observed in the writing job, where a task that is tried twice counts once.  One writer at a time.
    """
    spark = texts.sparkSession
    asked = texts.filter(~blank(F.col(text))).select(content_key(F.col(text)).alias("digest"), F.col(text).alias("asked_")).dropDuplicates(["digest"])
    new = asked.join(stored(spark, path, model).select("digest"), "digest", "left_anti")
    predict = predict_batch_udf(model.load, return_type=T.ArrayType(T.DoubleType()), batch_size=model.batch)
    calls = Observation()
    made = new.select("digest", predict("asked_").alias("vector")).observe(calls, F.count(F.lit(1)).alias("calls"), F.count(F.when(F.size("vector") != model.dims, 1)).alias("odd"))
    made.write.mode("append").parquet(f"{path}/{model.name}")
    seen = calls.get
    if seen["odd"]:
        raise ValueError(f"{model.name}: {seen['odd']} vectors are not of {model.dims} entries")
    return seen["calls"]


def embedded(texts: DataFrame, path: str, model: Model, text: str = "text", vector: str = "vector") -> DataFrame:
    """``texts`` with their vectors, from the table; what it lacks is embedded first.  Null and blank texts have zeros.

    An existing column ``vector`` is replaced.  Rows meet vectors by digest; where many rows have one text, adaptive execution
    splits them, as the table has a digest once.
    """
    embed_missing(texts, path, model, text)
    return looked_up(texts, path, model, text, vector)


def looked_up(texts: DataFrame, path: str, model: Model, text: str = "text", vector: str = "vector") -> DataFrame:
    """``texts`` with the vectors that the table has; without the model.  A text that is not in it has null, a blank one zeros."""
    keep = [c for c in texts.columns if c.lower() != vector.lower()]
    key, zero = "digest_of_", F.array_repeat(F.lit(0.0), model.dims)
    held = stored(texts.sparkSession, path, model).select(F.col("digest").alias(key), F.col("vector").alias("vector_of_"))
    rows = texts.withColumn(key, F.when(~blank(F.col(text)), content_key(F.col(text))))
    joined = rows.join(held, key, "left")
    return joined.select(*keep, F.when(blank(F.col(text)), zero).otherwise(F.col("vector_of_")).alias(vector))


def embedded_fields(df: DataFrame, id_col: str, fields: list[str], path: str, model: Model) -> DataFrame:
    """(id, a vector for each field), as ``retrieval.vector_scores`` takes them: ``retrieval.field_vectors`` through the table.

    Ids are unique and not null, as in an index; of rows that share one, a vector of either is taken for each field.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    long = df.select(F.col(id_col).alias("id"), pairs.alias("x")).select("id", "x.field", "x.text")
    each = embedded(long, path, model)
    return each.groupBy("id").agg(*[F.first(F.when(F.col("field") == f, F.col("vector")), ignorenulls=True).alias(f) for f in fields])
