"""Sliding-window limits in event time: as a batch fold, as a stream, and as plain request rates."""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from quarry.operators.greedy import fold_segments, small
from quarry.sources.tables import materialise, united

DECISION = "event_id long, client string, ts double, accepted boolean, reason string, retry_after int"
REASONS = {"running": "Too many queries are already running.", "hour": "Hourly query budget reached.", "day": "Daily query budget reached.", "client": "Client query limit reached."}


@dataclass(frozen=True)
class Limits:
    """Accepted queries at most: of a client in a minute, of all in an hour and in a day, and of all at a time; 0 is no limit."""

    per_minute: int = 10
    per_hour: int = 0
    per_day: int = 0
    running: int = 0


class Window_:
    """Times of accepted events inside a half-open window: one exactly as old as the window is out."""

    def __init__(self, seconds: int, most: int, times: list[float] | None = None) -> None:
        self.seconds, self.most, self.times = seconds, most, deque(times or ())

    def wait(self, now: float) -> int | None:
        """Seconds to wait, at least 1; null if there is room."""
        while self.times and self.times[0] <= now - self.seconds:
            self.times.popleft()
        if self.most <= 0 or len(self.times) < self.most:
            return None
        return max(1, math.ceil(self.times[0] + self.seconds - now))


def decide(now: float, windows: list[tuple[str, Window_]]) -> tuple[bool, str | None, int | None]:
    """The first full window in order refuses; only accepted events are remembered."""
    for name, w in windows:
        wait = w.wait(now)
        if wait is not None:
            return False, REASONS[name], wait
    for _, w in windows:
        w.times.append(now)
    return True, None, None


def client_limits(events: DataFrame, limits: Limits) -> DataFrame:
    """Decisions under the client limit alone, of (event_id, client, ts): clients are independent, so they are dealt out by client.

    A client's events are streamed in order through its task and only the window is held; nothing of a client is collected.
    """
    ordered = events.select("event_id", F.col("client").cast("string"), F.col("ts").cast("double")).repartition("client").sortWithinPartitions("client", "ts", "event_id")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, window = None, None
        for part in parts:
            out = []
            for e, c, t in part.itertuples(index=False):
                if window is None or c != client:
                    client, window = c, Window_(60, limits.per_minute)
                out.append((e, c, t, *decide(t, [("client", window)])))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in DECISION.split(", ")])

    return ordered.mapInPandas(fold, DECISION)


class Leases:
    """Ends of accepted queries that still run; one that ends at a time has ended then."""

    def __init__(self, most: int) -> None:
        self.most, self.ends = most, []

    def full(self, now: float) -> bool:
        while self.ends and self.ends[0] <= now:
            heapq.heappop(self.ends)
        return 0 < self.most <= len(self.ends)


class Held:
    """What later decisions depend on: accepted times within the windows that limit anything, and ends of what runs."""

    def __init__(self, limits: Limits, accepted: Sequence[tuple[float, str | None, float]] = ()) -> None:
        self.limits, self.swept = limits, -math.inf
        self.shared = [(name, Window_(seconds, most)) for name, seconds, most in (("hour", 3600, limits.per_hour), ("day", 86400, limits.per_day)) if most > 0]
        self.clients: dict[str | None, Window_] = {}
        self.leases = Leases(limits.running)
        for t, c, end in accepted:
            for w in (*[w for _, w in self.shared], self.own(c)):
                w.times.append(t)
            self.run(end)

    def own(self, client: str | None) -> Window_:
        return self.clients.setdefault(client, Window_(60, self.limits.per_minute))

    def run(self, end: float) -> None:
        if self.limits.running > 0:
            heapq.heappush(self.leases.ends, end)

    def decide(self, t: float, client: str | None, end: float) -> tuple[bool, str | None, int | None]:
        if t - self.swept >= 60:  # clients that are quiet for a minute have an empty window
            self.clients = {c: w for c, w in self.clients.items() if w.times and w.times[-1] > t - 60}
            self.swept = t
        if self.leases.full(t):
            return False, REASONS["running"], 1
        got = decide(t, [*self.shared, ("client", self.own(client))])
        if got[0]:
            self.run(end)
        return got


#: Events that one task decides in a row at most; more of them without a pause are cut to segments.
SEGMENT_EVENTS = 2_000_000
LEASED = f"{DECISION}, end double"


def paused(rows: DataFrame, limits: Limits) -> DataFrame:
    """(bucket_, chunk_, rows_): spans of time as long as the longest window, the number of the chunk each is in, and the chunk's events.

    A chunk begins where nothing before it counts any more: all windows are empty and all leases have ended, whatever was accepted.
    A row for each span of time, not for each event.
    """
    longest = 86400 if limits.per_day > 0 else 3600 if limits.per_hour > 0 else 60
    # A second more than the window: rounding must not empty it too early.
    reach = F.col("ts") + (longest + 1)
    reach = F.greatest(reach, "end") if limits.running > 0 else reach
    spans = rows.groupBy(F.floor(F.col("ts") / longest).alias("bucket_")).agg(F.min("ts").alias("first_"), F.max(reach).alias("reach_"), F.count("*").alias("n_"))
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.max("reach_").over(before) <= F.col("first_"), F.lit(True))
    cut = spans.withColumn("begins_", begins.cast("int")).withColumn("chunk_", F.sum("begins_").over(Window.orderBy("bucket_")))
    chunks = cut.withColumn("rows_", F.sum("n_").over(Window.partitionBy("chunk_"))).select("bucket_", "chunk_", "rows_")
    return materialise(chunks, "chunks", 0).withColumn("longest_", F.lit(longest))


def walked(events: DataFrame, limits: Limits, end: Column, segment_events: int) -> DataFrame:
    """Decisions in order of time under all limits; see ``leased_limits``."""
    every = events.select("event_id", F.col("client").cast("string").alias("client"), F.col("ts").cast("double").alias("ts"), end.alias("end"))
    rows = every.filter(F.col("ts").isNotNull() & ~F.isnan("ts"))
    untimed = every.filter(F.col("ts").isNull() | F.isnan("ts")).selectExpr("event_id", "client", "ts", "cast(null as boolean) accepted", "cast(null as string) reason", "cast(null as int) retry_after")
    names = [c.split()[0] for c in LEASED.split(", ")]
    chunks = paused(rows, limits)
    longest = chunks.select("longest_").first()
    if longest is None:
        return untimed
    seconds = longest[0]
    placed = rows.withColumn("bucket_", F.floor(F.col("ts") / seconds)).join(small(chunks.drop("longest_"), chunks.count()), "bucket_").drop("bucket_")

    def decided(part: pd.DataFrame, held: Held) -> pd.DataFrame:
        return pd.DataFrame([(e, c, t, *held.decide(t, c, end), end) for e, c, t, end in zip(part["event_id"], part["client"], part["ts"], part["end"], strict=True)], columns=names)

    def by_chunk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held = None, None
        for part in parts:
            for k, own in part.groupby("chunk_", sort=False):
                if k != chunk:
                    chunk, held = k, Held(limits)
                yield decided(own, held)

    def on(parts: Iterator[pd.DataFrame], before: list[tuple[float, str | None, float]]) -> Iterator[pd.DataFrame]:
        held = Held(limits, before)
        for part in parts:
            yield decided(part, held)

    def onward(got: DataFrame, before: list[tuple[float, str | None, float]]) -> list[tuple[float, str | None, float]]:
        last = got.agg(F.max("ts")).first()[0]
        counts = lambda t, end: t > last - seconds or (limits.running > 0 and end > last)
        own = got.filter("accepted").filter((F.col("ts") > last - seconds) | (F.lit(limits.running > 0) & (F.col("end") > last)))
        return sorted([x for x in before if counts(x[0], x[2])] + [tuple(r) for r in own.select("ts", "client", "end").collect()], key=lambda x: x[0])

    order = ["ts", "event_id", "client", "end"]
    few = placed.filter(F.col("rows_") <= segment_events).drop("rows_").repartition("chunk_").sortWithinPartitions("chunk_", *order).mapInPandas(by_chunk, LEASED)
    out = [few]
    if not chunks.filter(F.col("rows_") > segment_events).isEmpty():
        many = placed.filter(F.col("rows_") > segment_events).drop("rows_", "chunk_")
        out.append(fold_segments(many, order, on, LEASED, [], onward, segment_events))
    return united(*[f.drop("end") for f in out], untimed)


def all_limits(events: DataFrame, limits: Limits, segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """Decisions under the limits of clients, hours and days; like ``leased_limits`` without queries that run."""
    if limits.per_hour <= 0 and limits.per_day <= 0:
        return client_limits(events, limits)
    return walked(events, replace(limits, running=0), F.lit(0.0), segment_events)


def leased_limits(events: DataFrame, limits: Limits, segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """Decisions under all limits of (event_id, client, ts, end): the limit of running queries is asked first, and lets no event be remembered.

    A shared budget makes each decision depend on those before it, but not across a pause as long as the longest window in which nothing
    runs: events between such pauses are dealt out as chunks and decided side by side.  A chunk of more than ``segment_events`` is
    cut in order, each segment decided by its own task, with what still counts handed over: the accepted events of the
    last window, so never more than the budgets allow (without an hourly or daily one: those of a minute).  Events of the
    same time are taken by id.  An event without an end runs for ever; one without a time is not decided: ``accepted`` is null, and it counts for nothing.
    """
    return walked(events, limits, F.coalesce(F.col("end").cast("double"), F.lit(math.inf)), segment_events)


def responses(decisions: DataFrame) -> DataFrame:
    """What a client is told: status 200, or 429 with the reason and the seconds to wait."""
    ok = F.col("accepted")
    return decisions.select("event_id", F.when(ok, 200).otherwise(429).alias("status"), F.when(~ok, F.col("retry_after").cast("string")).alias("retry_after"), F.when(~ok, F.to_json(F.struct(F.col("reason").alias("error")))).alias("body"))


class ClientLimiter(StatefulProcessor):
    """The client limit on a stream: state is the accepted times of the last minute, and goes when they are old."""

    def __init__(self, per_minute: int) -> None:
        self.per_minute = per_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times array<double>", ttlDurationMs=3_600_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.times.get()
        window = Window_(60, self.per_minute, list(held[0]) if held else [])
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = [(e, key[0], t, *decide(t, [("client", window)])) for e, t in zip(batch["event_id"], batch["ts"], strict=True)]
        self.times.update((list(window.times),))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in DECISION.split(", ")])

    def close(self) -> None:
        pass


def stream_client_limits(events: DataFrame, limits: Limits) -> DataFrame:
    """The same as ``client_limits`` for a streaming frame; events are ordered within each micro-batch."""
    rows = events.select("event_id", F.col("client").cast("string").alias("client"), F.col("ts").cast("double").alias("ts"))
    return rows.groupBy("client").transformWithStateInPandas(ClientLimiter(limits.per_minute), outputStructType=DECISION, outputMode="append", timeMode="processingTime")


def request_rate(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of a client in the window that ends with each one, refused ones included and the far border excluded."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("client").orderBy("micros_").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("micros_", micros).withColumn("requests", F.count("*").over(w)).drop("micros_")


def concurrency(leases: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """(at, active): how many leases run after each change; ends come before starts of the same time.

    Changes are summed by time first, and times are range-partitioned: sums of whole partitions are added as offsets.
    """
    changes = leases.select(F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("x")).select("x.*").filter("at is not null")
    sums = changes.groupBy("at").agg(F.sum("d").alias("d"))
    day = sums.withColumn("day_", F.to_date("at"))
    per_day = day.groupBy("day_").agg(F.sum("d").alias("net_"))
    before = per_day.withColumn("offset_", F.coalesce(F.sum("net_").over(Window.orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each day
    inside = F.sum("d").over(Window.partitionBy("day_").orderBy("at"))
    return day.join(before.select("day_", "offset_"), "day_").select("at", (inside + F.col("offset_")).alias("active"))


def event_sequence(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Numbers from 1 in order within each query's events."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def paid(path: Column, body: Column) -> Column:
    """Whether a request has to be paid for: a question, or a tool call that asks one."""
    v = F.try_parse_json(body)
    call = (F.try_variant_get(v, "$.method", "string") == "tools/call") & (F.try_variant_get(v, "$.params.name", "string") == "ask")
    return F.when(path == "/ask", True).when(path == "/mcp", F.coalesce(call, F.lit(False))).otherwise(False)


def client_key(remote: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The client's address; a forwarded one counts from trusted proxies only."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.when(remote.isin(*trusted) & (F.coalesce(first, F.lit("")) != ""), first).otherwise(F.coalesce(remote, F.lit("unknown")))
