"""Composition, coverage, concentration and duplication of a catalog, and the sample to review."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import values as V
from quarry.operators.selection import running

RELATIONS = tuple(V.EVIDENCE_COLUMNS.values())


def composition(df: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """(dimension, value, n): counts by each dimension in one pass and one shuffle of counts; null is ``unknown``.

    An array dimension counts each of its entries, and an empty one as ``unspecified``.
    """
    parts = []
    for name, c in dimensions.items():
        kind = df.select(c.alias("c")).schema["c"].dataType.simpleString()
        one = F.coalesce(c.cast("string"), F.lit("unknown")) if not kind.startswith("array") else None
        many = F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, c).otherwise(F.array(F.lit("unspecified"))) if one is None else F.array(one)
        parts.append(label_all(many, name))
    return df.select(F.explode(F.concat(*parts)).alias("x")).select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def label_all(values: Column, name: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("dimension"), v.cast("string").alias("value")))


def top_values(counts: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def coverage(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """One row: the share of records with each property, to four places."""
    n = F.greatest(F.lit(1), F.count("*"))
    return df.agg(*[F.round(F.sum(F.coalesce(c, F.lit(False)).cast("int")) / n, 4).alias(k) for k, c in flags.items()])


def concentration(df: DataFrame, column: str) -> DataFrame:
    """One row: the commonest value (the first by name among equals), its share, and the number of distinct values."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "value"))
    return counts.agg(best.alias("b"), F.sum("n").alias("total"), F.count("*").alias("n_values")).select(F.col("b.value").alias("top_value"), F.round(F.col("b.n") / F.greatest(F.lit(1), F.col("total")), 4).alias("top_fraction"), "n_values")


def family_collapse(df: DataFrame, family: str) -> DataFrame:
    """Families of more than one record, and the share of records that families save."""
    sizes = df.groupBy(F.coalesce(F.col(family).cast("string"), F.lit("unknown")).alias("f")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum((F.col("n") > 1).cast("int")).alias("families_with_multiple_records"), F.round(1 - F.count("*") / F.greatest(F.lit(1), F.sum("n")), 4).alias("family_collapse_rate"))


def vocabulary_coverage(values: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """How much of a fixed vocabulary occurs, and what doesn't, sorted."""
    seen = values.filter(F.col(column).isin(*vocabulary)).agg(F.collect_set(column).alias("s"))  # of the vocabulary's size
    return seen.select(F.size("s").cast("long").alias("covered"), F.lit(len(vocabulary)).alias("available"), F.round(F.size("s") / len(vocabulary), 3).alias("fraction"), F.array_sort(F.array_except(F.array(*map(F.lit, vocabulary)), F.col("s"))).alias("uncovered"))


def upper_median(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The value at place n div 2 of the sorted values: not interpolated, the upper one of an even number.

    Values are counted first, and counts are added up over ranges of values, so no task holds a group.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("k"))
    half = F.floor(F.col("of_") / 2)
    placed = running(counts, by, "v", "k", "upto_", "of_")
    return placed.filter((F.col("upto_") > half) & (F.col("upto_") - F.col("k") <= half)).select(*by, F.col("v").alias("upper_median"))


def dropped_reasons(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("reason")).agg(F.count("*").alias("n"))


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def evidence_counts(items: DataFrame) -> DataFrame:
    """Quotes by relation."""
    return items.agg(*[F.sum(F.coalesce(F.array_size(r), F.lit(0))).alias(r) for r in RELATIONS if r in items.columns])


def review_sample(items: DataFrame, strata: DataFrame, size: int) -> DataFrame:
    """Records to look at: an equal share of each stratum, the most doubtful first, topped up over all.

    ``items`` (id, repo_id, family, subject, languages, downloads, relations); ``strata`` (repo_id, stratum).  Doubtful are
    records with subjects but no quote, with few downloads, of several languages, of crowded families.
    """
    crowd = items.groupBy(F.col("family").alias("family_of")).agg(F.count("*").alias("n_family"))
    j = items.join(crowd, F.col("family").eqNullSafe(F.col("family_of")), "left").drop("family_of").join(strata, "repo_id", "left").withColumn("stratum", F.coalesce("stratum", F.lit("unknown")))
    none = F.array().cast("array<string>")
    quoted = F.lit(False)
    for r in RELATIONS:
        if r in items.columns:
            quoted = quoted | (F.size(F.coalesce(r, none)) > 0)
    doubt = ((F.size(F.coalesce("subject", none)) > 0) & ~quoted).cast("int") + (F.coalesce("downloads", F.lit(0)) < 10_000).cast("int") + (F.size(F.coalesce("languages", none)) > 1).cast("int") + (F.col("n_family") > 1).cast("int")
    n_strata = j.select(F.countDistinct("stratum").alias("n_strata"))
    ranked = j.withColumn("doubt", doubt).withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("doubt"), "id"))).crossJoin(F.broadcast(n_strata))  # one row
    first = F.col("place") <= F.greatest(F.lit(1), F.floor(F.lit(size) / F.col("n_strata")))
    return ranked.orderBy(first.desc(), F.when(first, F.col("stratum")), F.desc("doubt"), "id").limit(size).drop("place", "n_strata", "n_family")
