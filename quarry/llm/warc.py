"""A deterministic, sharded WARC writer, and a reader.

Records are sorted by page id and cut to shards at ids that the sizes of payloads alone decide; a task writes a shard's files under temporary
names, rolls to the next file by compressed size, and reports what it wrote.  Only reports of tasks that
Spark accepted reach the manifest; its files get their final names, and readers go by the manifest alone, so lost
or repeated tasks leave nothing that is read.  The same pages give the same bytes in the same files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches
from quarry.sources.tables import materialise

#: Compressed bytes after which a file is rolled.
ROLL_BYTES = 256 << 20
#: A shard has a two-thousandth of all payload bytes, within these bounds.
SHARDS, SHARD_BYTES = 2000, (8 << 20, 1 << 30)
#: Equal steps of the id range between which shards may be cut; a step of more bytes than a shard is cut to finer ones.
STEPS, FINER = 1 << 14, 8
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 0
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE = "shard int, seq int, name string, temporary string, records long, bytes long, sha256 string, first_id long, last_id long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str, name: str, block: bytes, headers: list[tuple[str, str]], content: str) -> bytes:
    """A WARC record, compressed as a gzip member of its own without a time stamp."""
    top = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Date", DATE)]
    top += [("WARC-Target-URI", uri)] if uri else []
    top += [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", content), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in top) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, nth: int | str, revisit: bool) -> bytes:
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:quarry:page:{page_id}"
    digest = base32_sha1(payload)
    name = f"{page_id}:{digest}:{nth}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = [("WARC-Payload-Digest", f"sha1:{digest}")] + ([("Quarry-Page-Id", str(page_id))] if page_id is not None else [])
    if revisit:
        own += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(SPACE, f'{first}:{digest}:0')}>"), ("Quarry-Refers-To-Page-Id", str(first))]
    return record("revisit" if revisit else "response", uri, name, head if revisit else head + payload, own, "application/http;msgtype=response")


class ShardFiles:
    """The files of one shard, written one after another under temporary names."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, attempt: str, roll: int) -> None:
        self.fs, self.folder, self.shard, self.attempt, self.roll = fs, folder, shard, attempt, roll
        self.seq, self.out, self.done = 0, None, []

    def add(self, data: bytes, page_id: int | None) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:04d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}/{self.name}"
            self.fs.create_dir(f"{self.folder}/_temporary/{self.attempt}", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}")
            self.size, self.n, self.sha, self.ids = 0, 0, hashlib.sha256(), []
            self._write(record("warcinfo", "", f"warcinfo:{self.name}", f"format: WARC File Format 1.1\r\npart: {self.name}\r\n".encode(), [("WARC-Filename", self.name)], "application/warc-fields"))
        self._write(data)
        self.n += 1
        if page_id is not None:
            self.ids = [self.ids[0] if self.ids else page_id, page_id]
        if self.size >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            ids = self.ids or [None, None]
            self.done.append((self.shard, self.seq, self.name, self.temporary, self.n, self.size, self.sha.hexdigest(), *ids))
            self.seq += 1


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


FILE_SCHEMA = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def step_of(page_id: Column, low: int, width: int) -> Column:
    """The begin of an id's step; ids may lie further apart than a long reaches."""
    at = page_id.cast("decimal(20,0)")
    return F.call_function("div", at - F.lit(low).cast("decimal(20,0)"), F.lit(width).cast("decimal(20,0)"))


def cut_shards(narrow: DataFrame) -> tuple[list[tuple[int, int, list[int]]], tuple[int, int], int, int]:
    """How ids are dealt to shards: (step, shard of its begin, ids at which the next shards begin) by step, the steps' begin and
    width, the number of shards, and how many more the rows without an id take.

    Bytes are summed by steps of equal width; a step of more bytes than a shard is cut again, until it has one id or few
    enough bytes, so that ids may lie as unevenly as they like.  The driver gets at most STEPS sums, and FINER for each shard.
    """
    low, high, total, lost = narrow.agg(F.min("page_id"), F.max("page_id"), F.sum("payload_bytes"), F.sum(F.when(F.col("page_id").isNull(), F.col("payload_bytes") + 1))).first()
    most = min(max((total or 0) // SHARDS, SHARD_BYTES[0]), SHARD_BYTES[1])
    extra = -(-(lost or 0) // most)
    if low is None:
        return [], (0, 1), 0, extra
    top = (high - low) // STEPS + 1
    known = narrow.filter("page_id is not null").withColumn("cell", step_of(F.col("page_id"), low, top))
    cells = {low + c * top: (top, n) for c, n in known.groupBy("cell").agg(F.sum("payload_bytes")).collect()}
    known = known.withColumn("begin", (F.col("cell").cast("decimal(20,0)") * top + low).cast("decimal(20,0)")).select("page_id", "payload_bytes", "begin")
    heavy = {b: wn for b, wn in cells.items() if wn[1] > most and wn[0] > 1}
    while heavy:
        finer = []
        for begin, (width, n) in heavy.items():
            finer.append((begin, max(1, -(-width // min(STEPS, FINER * (n // most + 1))))))
            del cells[begin]
        widths = dict(finer)
        own = narrow.sparkSession.createDataFrame([(Decimal(b), Decimal(w)) for b, w in finer], "begin decimal(20,0), width decimal(20,0)")
        met = known.join(F.broadcast(own), "begin")  # no more rows than shards
        known = met.withColumn("to", (F.col("begin") + F.call_function("div", F.col("page_id").cast("decimal(20,0)") - F.col("begin"), F.col("width")).cast("decimal(20,0)") * F.col("width")).cast("decimal(20,0)")).select("page_id", "payload_bytes", F.col("begin").alias("from"), F.col("to").alias("begin"))
        heavy = {}
        for start, begin, n in known.groupBy("from", "begin").agg(F.sum("payload_bytes")).collect():
            cells[int(begin)] = (widths[int(start)], n)
            if n > most and widths[int(start)] > 1:
                heavy[int(begin)] = cells[int(begin)]
        known = known.select("page_id", "payload_bytes", "begin")
    shard, held, begins = 0, 0, {}
    for begin in sorted(cells):
        n = cells[begin][1]
        if held and held + n > most:
            shard, held = shard + 1, 0
            begins.setdefault((begin - low) // top, []).append(begin)
        held += n
    rows, at = [], 0
    for step in sorted({(b - low) // top for b in cells}):
        rows.append((step, at, begins.get(step, [])))
        at += len(begins.get(step, []))
    return rows, (low, top), shard + 1, extra


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT_BYTES, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` as WARC files into ``folder`` (a URI that all executors reach) and return the manifest.

    Of equal payloads of at least ``min_revisit`` bytes, that of the smallest id is a response record, the others revisit it; among repeated
    rows of that id one is the response.  A null html is an empty payload; a null id has no page-id header, and is
    never revisited; rows without an id are dealt by digest and url.  A null url becomes a urn.  An empty table gives an empty
    manifest.  Other columns are ignored, whatever they are called.  Payloads are written whole, however long; rows of one
    id are written by one task.
    """
    spark = pages.sparkSession
    bound_batches(pages.sparkSession)
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    narrow = materialise(rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "digests")
    copies = narrow.filter((F.col("payload_bytes") >= min_revisit) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # Written, so that both sides of the join are plain exchanges and a payload of many pages can be split.
    first = materialise(copies.filter("n > 1").select("digest", "first_id"), "firsts")
    roles = narrow.filter((F.col("payload_bytes") >= min_revisit) & F.col("page_id").isNotNull()).join(first, "digest").select("page_id", "digest", "first_id").distinct()
    steps, (low, width), n_shards, extra = cut_shards(narrow)
    both = rows.select("page_id", F.sha1("payload").alias("digest"), F.lit(None).cast("long").alias("first_id"), F.lit(1).alias("kind"), "url", "payload").unionByName(
        roles.select("page_id", "digest", "first_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    )
    cuts = F.broadcast(spark.createDataFrame(steps, "step long, base int, cuts array<long>"))  # at most STEPS rows, and an id for each shard
    placed = both.withColumn("step", step_of(F.col("page_id"), low, width)).join(cuts, "step", "left")
    by_id = F.col("base") + F.size(F.filter("cuts", lambda c: c <= F.col("page_id")))
    by_content = n_shards + F.pmod(F.xxhash64("digest", "url"), F.lit(max(1, extra)))
    dealt = placed.withColumn("shard", F.when(F.col("page_id").isNull(), by_content).otherwise(by_id).cast("int")).select("shard", "page_id", "digest", "kind", "first_id", "url", "payload").repartitionById(max(1, n_shards + extra), F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        files: ShardFiles | None = None
        key, first, nth = None, None, 0
        for batch in batches:
            for shard, page_id, digest, kind, known, link, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield batch_of(files.done, FILE_SCHEMA)
                    files = ShardFiles(fs, top, shard, attempt, roll)
                if key != (page_id, digest):
                    key, first, nth = (page_id, digest), None, 0
                if not kind:
                    first = known
                    continue
                revisit = first is not None and (first != page_id or nth > 0)
                files.add(page_record(page_id, link, data, first, nth if page_id is not None else f"{shard}-{nth}", revisit), page_id)
                nth += 1
        if files is not None:
            files.close()
            yield batch_of(files.done, FILE_SCHEMA)

    written = materialise(ordered.mapInArrow(write, FILE), "written")
    return commit(written, folder)


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Give the files of accepted tasks their final names, then write the manifest; both can be repeated at any point."""
    spark = written.sparkSession

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if fs.get_file_info(f"{top}/{temporary}").type != pafs.FileType.NotFound:
                    fs.move(f"{top}/{temporary}", f"{top}/{name}")
                elif fs.get_file_info(f"{top}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{top}/{temporary}")
            yield batch

    done = written.mapInArrow(rename, FILE).drop("temporary")
    done.write.mode("overwrite").parquet(f"{folder}/_manifest")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    left = hadoop.Path(f"{folder}/_temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a compressed archive, one at a time."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers: dict[str, str] = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                headers[k.strip().lower()] = v.strip()
            yield headers, f.read(int(headers["content-length"]))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, payload binary"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each response and revisit record of the archives in the manifest; payload is null for revisits.

    Every digest is computed again; a difference is an error.
    """
    files = read_manifest(spark, folder).select("name")
    n = max(1, min(files.count(), 1 << 16))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("payload", pa.binary())])

    def number(v: str | None) -> int | None:
        return None if v is None else int(v)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            rows, size = [], 0
            with fs.open_input_stream(f"{top}/{name}") as stream:
                for h, block in records(stream):
                    if h["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"{name}: a block does not match its digest")
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    new = h["warc-type"] == "response"
                    if new and (base32_sha1(payload) != digest or len(payload) != length):
                        raise ValueError(f"{name}: a payload does not match its digest or length")
                    rows.append((number(h.get("quarry-page-id")), h.get("warc-target-uri"), length, digest, h["warc-type"], number(h.get("quarry-refers-to-page-id")), name, payload if new and with_payload else None))
                    size += len(payload) if with_payload else 200
                    if size > 4 << 20:
                        yield batch_of(rows, schema)
                        rows, size = [], 0
            yield batch_of(rows, schema)

    return files.repartition(n).mapInArrow(read, READ)
