"""Metadata of a model hub as a source: replayed from JSON lines, with the query language of its listing.

The network is outside the engine.  ``listing`` answers a listing query from stored raw records; ``retry_plan`` says
what a reader does after a response.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.records import raw_schema
from quarry.sources.readers import read_jsonl

SORTS = {"downloads": "downloads", "likes": "likes", "trendingScore": "trendingScore", "createdAt": "createdAt", "lastModified": "lastModified"}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, raw_schema())


def label(stratum: str, query: Mapping[str, object]) -> str:
    """A query's name in ``found_by``: its members in order, then the sort."""
    parts = [f"{k}={v}" for k, v in sorted(query.items()) if k != "sort"]
    return f"{stratum}:" + ",".join([*parts, f"sort={query.get('sort', 'downloads')}"])


def listing(raw: DataFrame, query: Mapping[str, object], most: int) -> DataFrame:
    """The first ``most`` records of a listing: by pipeline tag, search word, tags, library and language, in the order of a sort."""
    cond = F.lit(True)
    if query.get("pipeline_tag"):
        cond = cond & (F.col("pipeline_tag") == query["pipeline_tag"])
    if query.get("search"):
        cond = cond & F.contains(F.lower("id"), F.lit(str(query["search"]).lower()))
    wanted = [t for k in ("tags", "library", "language") for t in ([query[k]] if isinstance(query.get(k), str) else query.get(k) or [])]
    for t in wanted:
        cond = cond & F.array_contains("tags", t)
    return raw.filter(cond).orderBy(F.desc(SORTS[str(query.get("sort", "downloads"))]), "id").limit(most)


def discover(raw: DataFrame, strata: Mapping[str, list[Mapping[str, object]]], most: Mapping[str, int]) -> DataFrame:
    """(id, label, seq) of all listings, in order of strata and queries: what ``selection.pool`` joins."""
    out = None
    n = 0
    for stratum, queries in strata.items():
        for q in queries:
            part = listing(raw, q, most[stratum]).select(F.col("id").alias("repo_id"), F.lit(label(stratum, q)).alias("label"), F.lit(n).alias("seq"))
            out, n = part if out is None else out.unionByName(part), n + 1
    if out is None:
        raise ValueError("no queries")
    return out


def retry_plan(status: int | None, attempt: int, retry_after: str | None = None, most: int = 4, base: float = 1.0, jitter: float = 0.0) -> float | None:
    """Seconds to wait before another try; null if there is none.  No response, 429 and 5xx are tried again."""
    if attempt >= most or not (status is None or status == 429 or status >= 500):
        return None
    try:
        said = float(retry_after) if retry_after else math.nan
    except ValueError:
        said = math.nan
    return said if said >= 0 else base * 2 ** (attempt - 1) + jitter


def card_status(status: int | None, size: int | None, gated: bool, most_bytes: int = 2_000_000) -> str:
    """What became of fetching a card."""
    if status == 200:
        return "too_large" if size is not None and size > most_bytes else "ok"
    if status == 404:
        return "missing_readme"
    if status in (401, 403):
        return "gated" if gated else "not_found"
    return "error"
