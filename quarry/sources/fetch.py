"""Readers that fetch over HTTP: listings page by page, documents on condition, abstracts in batches.

Requests run in tasks, with retries inside them; what has been fetched is kept in tables of the shared folder, and a later run asks
only for what they lack.  A task that is repeated asks again, which changes nothing but the number of requests.
"""

from __future__ import annotations

import email.utils
import hashlib
import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.sources import hub
from quarry.sources.readers import Node
from quarry.sources.tables import current, exists, materialise, publish


@dataclass(frozen=True)
class Policy:
    """How requests are made: tries, the first wait in seconds (doubled each time) and the longest, a pause after each, size and time limits."""

    attempts: int = 4
    base: float = 1.0
    longest: float = 120.0
    pause: float = 0.0
    timeout: float = 30.0
    most_bytes: int = 50 << 20
    agent: str = "quarry/1.0"


@dataclass(frozen=True)
class Answer:
    status: int | None
    body: bytes
    headers: Mapping[str, str]
    attempts: int
    error: str | None


def asked_wait(headers: Mapping[str, str], body: bytes, now: float) -> str | None:
    """The seconds that a refusal asks to wait: of its header (a number or a date), or named in its text."""
    said = headers.get("retry-after")
    if said:
        try:
            return str(float(said))
        except ValueError:
            at = email.utils.parsedate_tz(said)
            if at:
                return str(max(0.0, email.utils.mktime_tz(at) - now))
    m = re.search(rb"(?i)retry after (\d+)", body[:10_000])
    return m[1].decode() if m else None


def get(url: str, policy: Policy, headers: Mapping[str, str] | None = None) -> Answer:
    """One answer, after as many tries as the policy allows; no answer at all has no status."""
    attempt = 0
    while True:
        attempt += 1
        status, body, got, error = None, b"", {}, None
        try:
            request = urllib.request.Request(url, headers={"User-Agent": policy.agent, **(headers or {})})
            with urllib.request.urlopen(request, timeout=policy.timeout) as answer:
                status, got, body = answer.status, answer.headers, answer.read(policy.most_bytes + 1)
        except urllib.error.HTTPError as e:
            status, got = e.code, e.headers
            body = e.read(10_000)
            error = None if status == 304 else f"HTTP {status}"
        except (OSError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
        lower = {k.lower(): v for k, v in got.items()}
        wait = hub.retry_plan(status, attempt, asked_wait(lower, body, time.time()), policy.attempts, policy.base, policy.base * random.random()) if error else None
        if wait is None:
            if policy.pause:
                time.sleep(policy.pause)
            return Answer(status, body, lower, attempt, error)
        time.sleep(min(wait, policy.longest))


# --- documents ---------------------------------------------------------------------------------------

#: Outcomes that another try would not change.
FINAL = ("ok", "empty", "too_large", "missing", "refused")
FETCHED = "key string, url string, status int, outcome string, body binary, bytes long, sha256 string, etag string, last_modified string, attempts int, error string"


def outcome(answer: Answer, policy: Policy) -> str:
    if answer.status == 304:
        return "not_modified"
    if answer.error:
        return {404: "missing", 410: "missing", 401: "refused", 403: "refused"}.get(answer.status or 0, "error")
    return "too_large" if len(answer.body) > policy.most_bytes else "ok" if answer.body.strip() else "empty"


def fetched(requests: DataFrame, policy: Policy = Policy(), tasks: int = 8) -> DataFrame:
    """A row of FETCHED for each row of ``requests`` (key, url, and, where known, etag and last_modified of what is held already).

    ``tasks`` bounds how many requests run at a time.  The body is there for outcome ``ok`` alone.
    """
    known = {c: F.col(c) if c in requests.columns else F.lit(None).cast("string") for c in ("etag", "last_modified")}
    narrow = requests.select(F.col("key").cast("string"), "url", *[c.alias(k) for k, c in known.items()])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, url, etag, modified in frame.itertuples(index=False):
                own = ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
                a = get(url, policy, own)
                kind = outcome(a, policy)
                body = a.body if kind == "ok" else None
                digest = hashlib.sha256(body).hexdigest() if body is not None else None
                yield pd.DataFrame([(key, url, a.status, kind, body, len(a.body), digest, a.headers.get("etag"), a.headers.get("last-modified"), a.attempts, a.error)], columns=[c.split()[0] for c in FETCHED.split(", ")]).astype({"status": "Int32"})

    return narrow.repartition(tasks).mapInPandas(ask, FETCHED)


def fetch_missing(wanted: DataFrame, store: str, policy: Policy = Policy(), tasks: int = 8) -> DataFrame:
    """Fetch what the table ``store`` has no final outcome of, append it, and return the last outcome of each wanted key.

    A run that breaks off has lost its own answers alone; errors are tried again by the next run.
    """
    spark = wanted.sparkSession
    asked = wanted.dropDuplicates(["key"])
    if exists(spark, store):
        asked = asked.join(spark.read.parquet(store).filter(F.col("outcome").isin(*FINAL)).select("key"), "key", "left_anti")
    fetched(asked, policy, tasks).withColumn("run", F.lit(time.time())).write.mode("append").parquet(store)
    rest = [c.split()[0] for c in FETCHED.split(", ")][1:]
    last = spark.read.parquet(store).groupBy("key").agg(F.max_by(F.struct(*rest), "run").alias("r")).select("key", "r.*")
    return last.join(wanted.select("key").distinct(), "key", "left_semi")


def refresh(sources: DataFrame, table: str, policy: Policy = Policy(), tasks: int = 8) -> DataFrame:
    """Fetch ``sources`` (key, url) on condition, publish a version of ``table`` if there is anything new, and report (key, outcome, changed, error).

    The table has the last good content of each source with its digest and validators.  A source that fails keeps what it had; a
    server that ignores conditions and sends the same content changes nothing; sources that are gone from the list are dropped.
    """
    spark = sources.sparkSession
    held = current(spark, table)
    old = sources.limit(0).select(F.col("key").cast("string"), F.lit(b"").alias("content"), *[F.lit("").alias(c) for c in ("sha256", "etag", "last_modified")]) if held is None else held
    named = old.select("key", *[F.col(c).alias(f"{c}_old") for c in ("content", "sha256", "etag", "last_modified")])
    asked = sources.select(F.col("key").cast("string"), "url").join(named.select("key", F.col("etag_old").alias("etag"), F.col("last_modified_old").alias("last_modified")), "key", "left")
    got = materialise(fetched(asked, policy, tasks), "answers").join(named, "key", "left")
    good = F.col("outcome") == "ok"
    new = got.select(
        "key", good.alias("good"), (good & ~F.col("sha256").eqNullSafe(F.col("sha256_old"))).alias("changed"), "outcome", "error",
        F.when(good, F.col("body")).otherwise(F.col("content_old")).alias("content"), F.when(good, F.col("sha256")).otherwise(F.col("sha256_old")).alias("sha256"),
        F.when(good | (F.col("outcome") == "not_modified"), F.coalesce("etag", "etag_old")).otherwise(F.col("etag_old")).alias("etag"),
        F.when(good | (F.col("outcome") == "not_modified"), F.coalesce("last_modified", "last_modified_old")).otherwise(F.col("last_modified_old")).alias("last_modified"),
    )
    kept = new.filter("content is not null").select("key", "content", "sha256", "etag", "last_modified")
    if new.filter("good").limit(1).count():
        publish(kept, table)
    return new.select("key", "outcome", "changed", "error")


# --- a hub -------------------------------------------------------------------------------------------


def card_requests(records: DataFrame, base: str) -> DataFrame:
    """Requests of the cards of (repo_id, sha), each at its revision."""
    return records.select(F.concat_ws("@", "repo_id", "sha").alias("key"), F.concat(F.lit(f"{base.rstrip('/')}/"), "repo_id", F.lit("/raw/"), "sha", F.lit("/README.md")).alias("url"))


def cards(answers: DataFrame) -> DataFrame:
    """(repo_id, sha, status, text, bytes, content_sha256, attempts, error) of fetched cards; malformed bytes are replaced in the text alone."""
    status = F.when(F.col("outcome").isin("ok", "empty"), "ok").when(F.col("outcome") == "missing", "missing_readme").when(F.col("outcome") == "refused", "gated").otherwise(F.col("outcome"))
    text = F.when(status == "ok", F.make_valid_utf8(F.coalesce("body", F.lit(b"")).cast("string")))
    return answers.select(F.substring_index("key", "@", 1).alias("repo_id"), F.substring_index("key", "@", -1).alias("sha"), status.alias("status"), text.alias("text"), "bytes", F.col("sha256").alias("content_sha256"), "attempts", "error")


def parameters(query: Mapping[str, object]) -> list[tuple[str, str]]:
    """A listing query as the parameters of a request: tags, library and language are all filters."""
    tags = [t for k in ("tags", "library", "language") for t in ([query[k]] if isinstance(query.get(k), str) else query.get(k) or [])]
    plain = [(k, str(query[k])) for k in ("pipeline_tag", "search") if query.get(k)]
    return [*plain, *[("filter", str(t)) for t in tags], ("sort", str(query.get("sort", "downloads")))]


@dataclass
class Asked(InputPartition):
    """One listing query: its label, place in order, first address and how many records it asks for."""

    label: str
    seq: int
    url: str
    limit: int


class Listing(DataSource):
    """Records of paged JSON listings.  Options: ``queries`` (JSON list of label, url, limit) and ``policy`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "quarry_listing"

    def schema(self) -> str:
        return "label string, seq long, place long, record string"

    def reader(self, schema: object) -> DataSourceReader:
        return ListingReader(json.loads(self.options["queries"]), Policy(**json.loads(self.options.get("policy", "{}"))))


class ListingReader(DataSourceReader):
    """A task walks the pages of one query by their links to the next."""

    def __init__(self, queries: list[dict], policy: Policy) -> None:
        self.queries, self.policy = queries, policy

    def partitions(self) -> list[Asked]:
        return [Asked(q["label"], k, q["url"], q["limit"]) for k, q in enumerate(self.queries)]

    def read(self, partition: Asked) -> Iterator[tuple]:
        url, n = partition.url, 0
        while url and n < partition.limit:
            answer = get(url, self.policy)
            if answer.error:
                raise RuntimeError(f"{url}: {answer.error}")
            for record in json.loads(answer.body)[: partition.limit - n]:
                yield partition.label, partition.seq, n, json.dumps(record, sort_keys=True)
                n += 1
            following = re.search(r'<([^>]+)>\s*;\s*rel="?next"?', answer.headers.get("link", ""))
            url = urllib.parse.urljoin(url, following[1]) if following else None


def listings(spark: SparkSession, base: str, strata: Mapping[str, Sequence[Mapping[str, object]]], most: Mapping[str, int], policy: Policy = Policy(), page: int = 1000) -> DataFrame:
    """(label, seq, place, record) of all queries of all strata, in order: what ``selection.pool`` joins after parsing.  A query is a partition."""
    queries = [
        {"label": hub.label(stratum, q), "limit": most[stratum], "url": f"{base}?{urllib.parse.urlencode([*parameters(q), ('limit', min(page, most[stratum]))])}"}
        for stratum, own in strata.items() for q in own
    ]
    if not queries:
        raise ValueError("no queries")
    spark.dataSource.register(Listing)
    return spark.read.format("quarry_listing").option("queries", json.dumps(queries)).option("policy", json.dumps(asdict(policy))).load()


# --- abstracts ---------------------------------------------------------------------------------------

ABSTRACT = "arxiv_id string, title string, abstract string, url string"
_ABS = re.compile(r"(?i)arxiv\.org/abs/([\w.\-/]+?)(?:v\d+)?$")


def abstracts_of(body: bytes) -> Iterator[tuple[str, str, str, str]]:
    """What an answer says of papers; entries of another kind or without a summary are left out."""
    import xml.etree.ElementTree as ET

    for e in Node(ET.fromstring(body)).children("entry"):
        m, summary = _ABS.search(e.text("id")), " ".join(e.text("summary").split())
        if m and summary:
            yield m[1], " ".join(e.text("title").split()), summary, f"https://arxiv.org/abs/{m[1]}"


def fetch_abstracts(ids: DataFrame, store: str, endpoint: str, policy: Policy = Policy(pause=3.0), batch: int = 100, tasks: int = 1) -> DataFrame:
    """Fetch the abstracts of ``ids`` (arxiv_id) that the table ``store`` lacks, ``batch`` ids a request, append them, and return those of ``ids``.

    A batch that fails after all tries, or whose answer is no XML, gives nothing and is asked for again by the next run.  One
    task by default: the service asks for one connection at a time.
    """
    import xml.etree.ElementTree as ET

    spark = ids.sparkSession
    wanted = ids.select("arxiv_id").filter("arxiv_id != ''").distinct()
    lacking = wanted if not exists(spark, store) else wanted.join(spark.read.parquet(store).select("arxiv_id"), "arxiv_id", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                own = frame["arxiv_id"].iloc[at : at + batch].tolist()
                a = get(f"{endpoint}?{urllib.parse.urlencode({'id_list': ','.join(own), 'max_results': len(own)})}", policy)
                try:
                    rows = [] if a.error else list(abstracts_of(a.body))
                except ET.ParseError:
                    rows = []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ABSTRACT.split(", ")])

    lacking.repartition(tasks).sortWithinPartitions("arxiv_id").mapInPandas(ask, ABSTRACT).write.mode("append").parquet(store)
    return spark.read.parquet(store).dropDuplicates(["arxiv_id"]).join(wanted, "arxiv_id", "left_semi")
