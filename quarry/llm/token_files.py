"""Token ids in binary files of patched frame-of-reference blocks.

File format, all numbers little-endian:

* header: ``QTOK0001``, u32 ids of a block.
* blocks: u32 least id, u8 width, u8 zero, u16 number of ids, u16 number of exceptions; then every id less the least in
  ``width`` bits (low bits of exceptions); then the exceptions' places (u16) and their whole differences (u32).
* index: a u64 byte offset for each block; then for each document an i64 id, a u8 (0: it has no id), a u64 number of ids.
* trailer: u64 offset of the index, u64 ids, u32 blocks, u32 documents, u32 CRC-32 of the index, ``QTOKEND1``.

The width of a block is that of a percentile of its differences, so that few large ids don't widen all others.  Ids of a file are
one stream: blocks don't end with documents, and any run of ids is read from the blocks that the index names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, release
from quarry.sources.tables import materialise

HEAD, END = b"QTOK0001", b"QTOKEND1"
BLOCK, TAIL = struct.Struct("<IBBHH"), struct.Struct("<QQIII8s")
#: Ids of a block, and the share of its differences that the packed width has room for.
BLOCK_IDS, PERCENTILE = 4096, 0.98
#: Blocks that are packed or read together.
TOGETHER = 64
#: Ids after which a file is rolled, between documents.
ROLL_IDS = 1 << 26
#: A shard has a two-thousandth of all text bytes, within these bounds.
SHARDS, SHARD_BYTES = 2000, (8 << 20, 512 << 20)
END_ID = 0


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of the rows of ``ids`` (equally long, at most 65,535 each)."""
    rows, n = ids.shape
    least = ids.min(axis=1)
    rest = ids - least[:, None]
    nth = min(n - 1, int(percentile * n))
    widths = [int(v).bit_length() for v in np.partition(rest, nth, axis=1)[:, nth]]
    out = [b""] * rows
    for w in set(widths):
        own = [i for i in range(rows) if widths[i] == w]
        some = rest[own]
        kind = np.dtype("<u2" if w <= 16 else "<u4")
        bits = np.unpackbits(some.astype(kind).view(np.uint8), axis=1, bitorder="little").reshape(len(own), n, 8 * kind.itemsize)[:, :, :w]
        packed = np.packbits(bits.reshape(len(own), n * w), axis=1, bitorder="little")
        wide = some.astype(np.uint64) >> np.uint64(w) != 0
        for k, i in enumerate(own):
            at = np.flatnonzero(wide[k])
            out[i] = BLOCK.pack(int(least[i]), w, 0, n, len(at)) + packed[k].tobytes() + at.astype("<u2").tobytes() + some[k, at].astype("<u4").tobytes()
    return out


def unpack_block(data: bytes | memoryview, at: int = 0) -> np.ndarray:
    """The ids of the block that begins at ``at``."""
    least, w, _, n, odd = BLOCK.unpack_from(data, at)
    at += BLOCK.size
    size = (n * w + 7) // 8
    padded = np.zeros(size + 8, np.uint8)
    padded[:size] = np.frombuffer(data, np.uint8, size, at)
    first = np.arange(n, dtype=np.int64) * w
    windows = np.ndarray((size + 1,), "<u8", padded, 0, (1,))  # eight bytes from each byte on
    ids = (windows[first >> 3] >> (first & 7).astype(np.uint64) & np.uint64((1 << w) - 1)).astype(np.uint32)
    at += size
    ids[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return ids + np.uint32(least)


class TokenWriter:
    """Writes one file: documents one after another, blocks as they fill."""

    def __init__(self, out, block: int = BLOCK_IDS, percentile: float = PERCENTILE) -> None:
        self.out, self.block, self.percentile = out, block, percentile
        self.held: list[np.ndarray] = []
        self.n_held, self.n_ids = 0, 0
        self.starts, self.ids, self.known, self.lengths = array("Q"), array("q"), bytearray(), array("Q")
        self.at, self.sum = 0, 0
        self._write(HEAD + struct.pack("<I", block))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray, doc_ids: Sequence[int | None], lengths: np.ndarray) -> None:
        """Some documents' ids in a row, with the number of each."""
        self.ids.extend(0 if i is None else i for i in doc_ids)
        self.known.extend(i is not None for i in doc_ids)
        self.lengths.extend(lengths.tolist())
        self.held.append(ids.astype(np.uint32, copy=False))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block * TOGETHER:
            self._flush()

    def _flush(self) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, np.uint32)])
        full = len(ids) // self.block
        for at in range(0, full, TOGETHER):
            self._blocks(ids[at * self.block : min(at + TOGETHER, full) * self.block].reshape(-1, self.block))
        self.held, self.n_held = [ids[full * self.block :]], len(ids) - full * self.block

    def _blocks(self, rows: np.ndarray) -> None:
        for data in pack_blocks(rows, self.percentile):
            self.starts.append(self.at)
            self._write(data)

    def close(self) -> None:
        self._flush()
        if self.n_held:
            self._blocks(self.held[0][None, :])
        index, top = b"".join([self.starts.tobytes(), self.ids.tobytes(), bytes(self.known), self.lengths.tobytes()]), self.at
        self._write(index)
        self._write(TAIL.pack(top, self.n_ids, len(self.starts), len(self.ids), zlib.crc32(index), END))
        self.out.close()


class TokenFile:
    """Reads one file; ``source`` can seek."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        if source.read_at(len(HEAD), 0) != HEAD:
            raise ValueError("not a token file")
        self.block = struct.unpack("<I", source.read_at(4, len(HEAD)))[0]
        top, self.n_ids, blocks, docs, crc, end = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        index = source.read_at(size - TAIL.size - top, top)
        if end != END or zlib.crc32(index) != crc:
            raise ValueError("a damaged index")
        self.starts = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(top)).astype(np.int64)
        ids = np.frombuffer(index, "<i8", docs, 8 * blocks).tolist()
        known = index[8 * (blocks + docs) : 8 * (blocks + docs) + docs]
        self.doc_ids = [i if k else None for i, k in zip(ids, known, strict=True)]
        self.begins = np.concatenate([[0], np.cumsum(np.frombuffer(index, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64))])

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the file, from the blocks that hold them alone."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block + 1
        top = int(self.starts[first])
        data = self.source.read_at(int(self.starts[last]) - top, top)
        ids = np.concatenate([unpack_block(data, int(s) - top) for s in self.starts[first:last]])
        return ids[start - first * self.block : stop - first * self.block]

    def runs(self) -> Iterator[np.ndarray]:
        """All ids, TOGETHER blocks at a time."""
        for at in range(0, self.n_ids, self.block * TOGETHER):
            yield self.read(at, at + self.block * TOGETHER)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, begin and ids of each document.  No more than a run of blocks and one document are held."""
        runs, held, low = self.runs(), np.zeros(0, np.uint32), 0
        for k, i in enumerate(self.doc_ids):
            begin, end = int(self.begins[k]), int(self.begins[k + 1])
            parts = [held[begin - low :]]
            while low + len(held) < end:
                low += len(held)
                held = next(runs)
                parts.append(held[: end - low])
            yield i, begin, np.concatenate(parts) if len(parts) > 1 else held[begin - low : end - low]


#: Parts of texts that a worker remembers with their ids (twice, the last and those before), and the longest that it does.
MEMO_PARTS, MEMO_BYTES = 1 << 19, 64
#: Parts whose ids are gathered together.
GATHERED = 1 << 15
#: Kinds of bytes whose runs the pre-tokenizer parts: the rest is odd, the apostrophe too (it may begin an ending).
ODD, LETTER, DIGIT, SIGN, LINE_END = range(5)
_KINDS = np.zeros(256, np.uint8)
for _kind, _of in ((LETTER, [*range(65, 91), *range(97, 123)]), (DIGIT, range(48, 58)), (SIGN, [b for b in range(33, 127) if not chr(b).isalnum() and b != 39]), (LINE_END, [10])):
    _KINDS[list(_of)] = _kind
#: First bytes of À to ȿ (letters all, but for × and ÷).
_LATIN = range(0xC3, 0xC9)
#: White space by its number of bytes, as big-endian numbers.
_WHITE = {n: np.array([int.from_bytes(w) for w in (chr(c).encode() for c in range(0xD800) if chr(c).isspace()) if len(w) == n]) for n in (1, 2, 3)}
_WHITE_BYTE = np.isin(np.arange(256), _WHITE[1])
_WHITE_LEAD = np.isin(np.arange(256), [*_WHITE[2] >> 8, *_WHITE[3] >> 16])

#: The character by which byte-level vocabularies write a byte: itself where Latin-1 prints it, else the next free one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = dict(zip((b for b in range(256) if b not in _PRINTED), map(chr, range(256, 512))))
#: The same as UTF-16; a zero byte, which no run holds, becomes the space, which is no byte's sign.
_SIGNS = np.array([ord(_BYTE_SIGNS.get(b, chr(b))) if b else 32 for b in range(256)], "<u2")


def utf8_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in a row (null: empty), and where each begins, with the whole length at the end."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def cut_texts(data: np.ndarray, at: np.ndarray, special: Sequence[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of texts begin, and whether each is odd.

    Texts are cut before every space that something other than white space follows.  What lies between two cuts is cut to runs of
    letters, digits, signs and single line ends (a space before a run goes with it), if there is nothing else in it; otherwise it
    stays whole and is odd.
    """
    size = len(data)
    begins = np.zeros(size + 1, bool)
    begins[at] = True
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[~begins[spaces + 1]]
    spaces = spaces[~_WHITE_BYTE[data[spaces + 1]]]
    wide = np.flatnonzero(_WHITE_LEAD[data[spaces + 1]])
    if len(wide):
        padded = np.append(data, np.zeros(2, np.uint8))
        two = padded[spaces[wide] + 1].astype(np.int64) << 8 | padded[spaces[wide] + 2]
        three = two << 8 | padded[spaces[wide] + 3]
        spaces = np.delete(spaces, wide[np.isin(two, _WHITE[2]) | np.isin(three, _WHITE[3])])
    begins[spaces] = True
    kinds = _KINDS[data]
    lead = np.flatnonzero((data >= _LATIN[0]) & (data <= _LATIN[-1]))
    lead = lead[(data[lead] != 0xC3) | (data[lead + 1] & 0xDF != 0x97)]
    kinds[lead] = kinds[lead + 1] = LETTER
    ends = kinds == LINE_END
    kinds[:-1][ends[:-1] & ends[1:]] = ODD
    for word in special:
        for m in re.finditer(re.escape(word), data):
            kinds[m.start() : m.end()] = ODD
    kinds[spaces] = kinds[spaces + 1]
    starts = np.flatnonzero(begins[:size])
    odd = np.repeat(np.logical_or.reduceat(kinds == ODD, starts), np.diff(starts, append=size)) if size else np.zeros(0, bool)
    begins[1:size] |= (kinds[1:] != kinds[:-1]) & ~odd[1:]
    starts = np.flatnonzero(begins[:size])
    return starts, odd[starts]


def gather(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` ids from each of the places ``first`` on, in a row."""
    begins = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(begins[-1]), ids.dtype)
    for at in range(0, len(size), GATHERED):
        own = slice(at, at + GATHERED)
        low, high = int(begins[at]), int(begins[min(at + GATHERED, len(size))])
        out[low:high] = ids[np.repeat(first[own] - begins[:-1][own], size[own]) + np.arange(low, high)]
    return out


class Memo:
    """Parts of texts and their ids; number 0 is that of no part."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def find(self, parts: list[bytes]) -> np.ndarray:
        """The number of each part, 0 for those that are not known."""
        return np.fromiter(map(self.places.get, parts, repeat(0)), np.int64, len(parts))

    def add(self, parts: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.places.update(zip(parts, range(len(self.first), len(self.first) + len(parts))))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, ids)


class TextEncoder:
    """The ids of texts under a tokenizer file, with an end id after each text.

    Byte-level tokenizers without normaliser never join what stands before a space with what follows it, if that is no white
    space: so texts are cut there and to runs of one kind of characters, and the ids of a part are asked of the library once and
    remembered.  All new runs of a batch are asked at once.  Other tokenizers get whole texts.
    """

    def __init__(self, file: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        self.special = [a["content"].encode() for a in added]
        self.cuts = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            and model.get("type") == "BPE" and not model.get("dropout") and all(_BYTE_SIGNS.get(b, chr(b)) in model["vocab"] for b in range(256))
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in added)
        )
        self.end_id = end_id
        self.memo, self.before = Memo(), Memo()
        if self.cuts:
            self.runs = Tokenizer(self.tokenizer.model)
            self.runs.pre_tokenizer = CharDelimiterSplit(" ")
            self.width = np.zeros(max(model["vocab"].values()) + 1, np.int64)  # bytes of each id
            self.width[list(model["vocab"].values())] = [len(v) for v in model["vocab"]]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _runs(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of one kind of characters in a row, as the library's model takes them, and the number of each."""
        signs = _SIGNS[np.frombuffer(b"\0".join(parts), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.runs.encode_batch_fast([signs], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))  # ids of a run end where its bytes do
        return ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), stops, "right"), prepend=0)

    def _asked(self, parts: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts in a row, and the number of each."""
        if not odd.any():
            return self._runs(parts)
        ids, size = self._runs([p for p, o in zip(parts, odd, strict=True) if not o])
        whole = [self._whole(p.decode()) for p, o in zip(parts, odd, strict=True) if o]
        sizes = np.zeros(len(parts), np.int64)
        sizes[~odd], sizes[odd] = size, [len(w) for w in whole]
        out = np.zeros(int(sizes.sum()), np.uint32)
        of_odd = np.repeat(odd, sizes)
        out[~of_odd], out[of_odd] = ids, np.fromiter(chain.from_iterable(whole), np.uint32, int(sizes[odd].sum()))
        return out, sizes

    def _known(self, parts: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For different parts: some ids, and where among them each part's begin, and their number."""
        if len(self.memo.places) > MEMO_PARTS:  # begin anew; what is remembered stays at hand until the next time
            self.memo, self.before = Memo(), self.memo
        memo, extra = self.memo, []
        found = memo.find(parts)
        for source in (self.before, None):
            new = np.flatnonzero(found == 0)
            if not len(new):
                break
            own = [parts[i] for i in new]
            if source is None:
                ids, size = self._asked(own, odd[new])
            else:
                at = source.find(own)
                hit = at > 0
                new, own, at = new[hit], [p for p, h in zip(own, hit, strict=True) if h], at[hit]
                ids, size = gather(source.ids, source.first[at], source.size[at]), source.size[at]
            short = np.fromiter(map(len, own), np.int64, len(own)) <= MEMO_BYTES
            found[new[short]] = len(memo.first) + np.arange(int(short.sum()))
            keep = np.repeat(short, size)
            memo.add([p for p, s in zip(own, short, strict=True) if s], ids[keep], size[short])
            if not short.all():
                extra.append((new[~short], ids[~keep], size[~short]))
        first, sizes = memo.first[found], memo.size[found]
        pool = [memo.ids]
        for at, ids, size in extra:
            first[at], sizes[at] = sum(map(len, pool)) + np.cumsum(size) - size, size
            pool.append(ids)
        return np.concatenate(pool), first, sizes

    def encode_all(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each, ends included."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        if not self.cuts:
            got = [[*self._whole(t or ""), self.end_id] for t in texts.to_pylist()]
            size = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size
        data, at = utf8_of(texts)
        starts, odd = cut_texts(data, at, self.special)
        offsets = np.append(starts, len(data))
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which = parts.indices.to_numpy()
        different = parts.dictionary.to_numpy(zero_copy_only=False).tolist()  # bytes, some ten times as fast as to_pylist
        odd_ones = np.zeros(len(different), bool)
        odd_ones[which[odd]] = True
        ids, first, size = self._known(different, odd_ones)
        stops = np.searchsorted(starts, at[1:])  # each text's end is a part of its own
        which = np.insert(which, stops, len(different))
        first, size = np.append(first, len(ids))[which], np.append(size, 1)[which]
        total = np.concatenate([[0], np.cumsum(size)])
        return gather(np.append(ids, np.uint32(self.end_id)), first, size), np.diff(total[stops + np.arange(1, len(stops) + 1)], prepend=0)


_encoders: dict[tuple[str, int], TextEncoder] = {}


def encoder_for(file: str, end_id: int) -> TextEncoder:
    if (file, end_id) not in _encoders:
        _encoders[file, end_id] = TextEncoder(file, end_id)
    return _encoders[file, end_id]


FILE = "shard int, seq int, name string, temporary string, docs long, ids long, bytes long"
FILE_SCHEMA = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    block: int = BLOCK_IDS,
    percentile: float = PERCENTILE,
    roll: int = ROLL_IDS,
    shard_bytes: tuple[int, int] = SHARD_BYTES,
) -> DataFrame:
    """Write the ids of all ``docs``, in ascending order of their ids, into files in ``folder`` (a URI that all executors reach); returns the manifest.

    Documents are range-sorted to shards; a task encodes and writes a shard at a time, under temporary names.  Only files that
    accepted tasks report reach the manifest, with the number of ids before each; readers go by it alone.  A null text
    is an empty one (the end id alone); rows without an id come first; rows of one id are ordered by their texts' hash, equal rows
    are interchangeable.  Texts are encoded whole, however long.  An empty table gives an empty manifest; other columns are ignored.
    ``tokenizer_file`` has to be readable under the same path on every executor.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    size = min(max(total // SHARDS, shard_bytes[0]), shard_bytes[1])
    ordered = rows.repartitionByRange(total // size + 1, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        context, encoder = TaskContext.get(), encoder_for(tokenizer_file, end_id)
        shard, attempt, seq, out, done = context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, None, []

        def close() -> None:
            out.close()
            name = f"part-{shard:06d}-{seq:04d}.tokens"
            done.append((shard, seq, name, f"_temporary/{attempt}/{name}", len(out.ids), out.n_ids, out.at))

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(f"{top}/_temporary/{attempt}", recursive=True)
                out = TokenWriter(fs.open_output_stream(f"{top}/_temporary/{attempt}/part-{shard:06d}-{seq:04d}.tokens"), block, percentile)
            ids, lengths = encoder.encode_all(batch.column(1))
            out.add(ids, batch.column(0).to_pylist(), lengths)
            if out.n_ids >= roll:
                close()
                seq, out = seq + 1, None
        if out is not None:
            close()
        release()  # once a shard: what is given back after a batch the next one has to fault in again
        yield table_of(done, FILE_SCHEMA)

    return commit(materialise(ordered.mapInArrow(write, FILE), "token-files"), folder)


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Number the files' first ids, give files their final names and write the manifest; all can be repeated at any point."""
    spark = written.sparkSession
    start, starts = 0, []
    for shard, seq, n in written.select("shard", "seq", "ids").orderBy("shard", "seq").collect():  # a row for each file
        starts.append((shard, seq, start))
        start += n
    at = F.broadcast(spark.createDataFrame(starts, "shard int, seq int, start long"))  # as many rows as files

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if fs.get_file_info(f"{top}/{temporary}").type != pafs.FileType.NotFound:
                    fs.move(f"{top}/{temporary}", f"{top}/{name}")
                elif fs.get_file_info(f"{top}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{top}/{temporary}")
            yield batch

    numbered = written.join(at, ["shard", "seq"]).select("shard", "seq", "name", "temporary", "docs", "ids", "bytes", "start")
    numbered.mapInArrow(rename, f"{FILE}, start long").drop("temporary").write.mode("overwrite").parquet(f"{folder}/_manifest")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    left = hadoop.Path(f"{folder}/_temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/_manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """A row for each document of the files in the manifest: id, number of ids before it, its own number, their CRC-32 as 32-bit integers, and the ids (null unless ``with_ids``).

    One task reads a file, some blocks at a time.
    """
    files = read_manifest(spark, folder).select("name", "start")
    n = max(1, min(files.count(), 1 << 16))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for name, start in ((x, s) for b in batches for x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            rows, size = [], 0
            with fs.open_input_file(f"{top}/{name}") as source:
                for doc_id, begin, ids in TokenFile(source).documents():
                    rows.append((doc_id, start + begin, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), ids.astype(np.int32) if with_ids else None))
                    size += len(ids) if with_ids else 16
                    if size > 1 << 20:
                        yield table_of(rows, schema)
                        rows, size = [], 0
            yield table_of(rows, schema)

    return files.repartition(n).mapInArrow(read, READ)
