"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map; each normalised
character remembers the source bytes that it stands for.  The normalised text is cut to chunks where no piece
can reach across, so that memory doesn't grow with a text's length; chunks are segmented by the library's
model, and every piece is projected to the source bytes of its characters.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from quarry.llm.common import as_bytes, bound_batches, release

SPACE = "▁"
#: Characters of a chunk at least, but for a text's last.
CHUNK = 4096
#: Kinds of pieces in a model file.
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
BPE = 2


class CharacterMap:
    """The compiled character map: a double-array trie of source strings and the strings that replace them.

    The file has the trie's size in bytes, its 32-bit units, and the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest mapped prefix of ``data[at:]`` and that prefix's length."""
        if not self.units:
            return None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        best = None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if (unit & 0x800000FF) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                best = self.strings[start : self.strings.index(b"\0", start)], i + 1 - at
        return best


def char_length(data: bytes, at: int) -> int:
    """Bytes of the valid UTF-8 character at ``at``; 0 if there is none."""
    b = data[at]
    n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    try:
        return n if n and data[at : at + n].decode() and at + n <= len(data) else 0
    except UnicodeDecodeError:
        return 0


#: Ids, begins and ends of a text's pieces, and the ids as text, joined by commas.
Encoded = tuple[np.ndarray, np.ndarray, np.ndarray, str]
#: Bytes of text whose chunks are segmented together.
TOGETHER_BYTES = 1 << 20


class Codec:
    """``encode(data)`` to pieces with begins and ends in source bytes; ``decode(ids)`` to text."""

    def __init__(self, model_file: str) -> None:
        proto = model_pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != BPE or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with white space as prefix is asked for")
        if any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.map.units and not self.trim and self.escape
        self.decoder = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.names = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        # The same model without a normaliser segments what is normalised already.
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, True
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        inside = any(SPACE in p.lstrip(SPACE) for p in self.names)
        #: No piece reaches across to a run of space marks, so a chunk ends before one.
        self.chunks = re.compile("(?s).+" if inside else f"(?s).{{{CHUNK}}}{SPACE}*[^{SPACE}]*|.+")
        self.sizes = [len(p) for p in self.names]
        self.byte_of = np.array([int(n[3:5], 16) if k == BYTE else -1 for n, k in zip(self.names, self.kinds, strict=True)], np.int16)
        self.size_of = np.where(self.byte_of < 0, np.array(self.sizes, np.int32), 0)
        self.unknown = np.array([k == UNKNOWN for k in self.kinds])
        self.digits = [str(i) for i in range(len(self.names))]

    def normalise(self, data: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters the source byte at which it begins; one more for the end."""
        out: list[str] = []
        at: list[int] = []
        i, n = 0, len(data)
        step = self._step
        if self.trim:
            while i < n and step(data, i)[0] == " ":
                i += step(data, i)[1]
        if i == n:
            return "", np.zeros(1, np.int64)
        mark = SPACE if self.escape else " "
        if self.dummy:
            out.append(mark)
            at.append(i)
        spaced = self.trim
        while i < n:
            text, size = step(data, i)
            while spaced and text.startswith(" "):
                text = text[1:]
            for ch in text:
                out.append(mark if ch == " " else ch)
                at.append(i)
            if text:
                spaced = text.endswith(" ")
            i += size
            spaced = spaced and self.trim
        if self.trim:
            while out and out[-1] == mark:
                out.pop()
                i = at.pop()
        return "".join(out), np.array([*at, i], np.int64)

    def _step(self, data: bytes, i: int) -> tuple[str, int]:
        """What the next source bytes become, and how many they are; a malformed byte becomes U+FFFD."""
        got = self.map.longest(data, i)
        if got:
            return got[0].decode("utf-8", "replace"), got[1]
        n = char_length(data, i)
        return (data[i : i + n].decode(), n) if n else ("�", 1)

    def segment(self, texts: Sequence[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Of each normalised text the ids, and the number of characters that each piece stands for.

        Bytes of a character without a piece: the last stands for the character, those before for nothing.
        """
        chunks = [[t] if len(t) <= CHUNK else self.chunks.findall(t) for t in texts]
        got = iter(self.segmenter.encode([c for own in chunks for c in own], num_threads=1))
        for own in chunks:
            parts = [next(got) for _ in own]
            ids = parts[0] if len(parts) == 1 else [i for p in parts for i in p]
            at = np.array(ids, np.int32)
            if self.unknown[at].any():
                yield ids, np.array([n for c, p in zip(own, parts, strict=True) for n in self._sizes(c, p)], np.int32)
                continue
            byte = self.byte_of[at]
            last = byte >= 0
            last[:-1] &= (byte[1:] < 0x80) | (byte[1:] > 0xBF)
            yield ids, self.size_of[at] + last

    def _sizes(self, cut: str, ids: Sequence[int]) -> tuple[int, ...]:
        kinds, names = self.kinds, self.names
        sizes: list[int] = []
        at, left = 0, 0  # left: bytes to come of the character at `at`
        for i in ids:
            if kinds[i] == BYTE:
                left = (left or len(cut[at].encode())) - 1
                sizes.append(0 if left else 1)
                at += not left
            elif kinds[i] == UNKNOWN:  # stands for all characters up to the next known piece
                n = 1
                sizes.append(n)
                at += n
            else:
                sizes.append(len(names[i]))
                at += len(names[i])
        if at != len(cut) and ids:  # neighbouring unknown characters share one piece
            sizes = self._spread(cut, ids)
        return tuple(sizes)

    def _spread(self, cut: str, ids: Sequence[int]) -> list[int]:
        """Sizes where a run of unknown characters is one piece: known pieces are found again after it."""
        sizes, at = [], 0
        for k, i in enumerate(ids):
            if self.kinds[i] != UNKNOWN:
                sizes.append(len(self.names[i]))
            elif k + 1 == len(ids):
                sizes.append(len(cut) - at)
            else:
                sizes.append(max(1, cut.find(self.names[ids[k + 1]], at + 1) - at))
            at += sizes[-1]
        return sizes

    def encode(self, data: bytes | None) -> Encoded:
        return next(self.encode_all([data]))

    def encode_all(self, texts: Sequence[bytes | None]) -> Iterator[Encoded]:
        """The pieces of each text.  Texts are taken some at a time, so that the library is called for many chunks."""
        held: list[tuple[str, np.ndarray | None, bool]] = []
        size = 0
        for data in texts:
            held.append(self._normalised(data))
            size += len(data or b"")
            if size >= TOGETHER_BYTES:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _normalised(self, data: bytes | None) -> tuple[str, np.ndarray | None, bool]:
        """A normalised text, where its characters begin (none: each at its own number), and whether a dummy prefix goes before them."""
        if not data:
            return "", None, False
        if self.plain and SPACE.encode() not in data and (text := plain_text(data)) is not None:
            # Each character begins where its bytes do; the dummy prefix stands before the first and takes none.
            at = None if len(text) == len(data) else char_offsets(data)
            return (SPACE if self.dummy else "") + text.replace(" ", SPACE), at, self.dummy
        text, at = self.normalise(data)
        return text, at, False

    def _encoded(self, held: Sequence[tuple[str, np.ndarray | None, bool]]) -> Iterator[Encoded]:
        digits = self.digits
        for (_, at, shift), (ids, sizes) in zip(held, self.segment([h[0] for h in held]), strict=True):
            if not ids:
                none = np.zeros(0, np.int64)
                yield none, none, none, ""
                continue
            ends = np.cumsum(sizes)
            if shift:
                ends = np.maximum(ends - 1, 0)
            if at is not None:
                ends = at[ends]
            yield np.array(ids, np.int32), np.concatenate([[0 if at is None else int(at[0])], ends[:-1]]), ends, ",".join([digits[i] for i in ids])

    def decode(self, ids: Sequence[int]) -> str:
        return self.decoder.decode(ids.tolist() if isinstance(ids, np.ndarray) else list(ids)) if len(ids) else ""


def plain_text(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def char_offsets(data: bytes) -> np.ndarray:
    """Byte offsets of a text's characters, and its length."""
    begin = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(begin, len(data))


_codecs: dict[str, Codec] = {}


def codec_for(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


ENCODED = "struct<n_tokens: long, ids: array<int>, begins: array<int>, ends: array<int>, decoded: string>"


def lists(parts: Sequence[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode_column(df: DataFrame, model_file: str, text: str = "text", to: str = "pieces", decode: bool = True) -> DataFrame:
    """``df`` with a struct: n_tokens, ids, begins and ends (source bytes of each piece), and the decoded text (null unless ``decode``).

    A null text is encoded like an empty one: no pieces, decoded ''.  Texts are encoded whole.  Repeated rows give repeated rows,
    an empty table none; a column called like ``to`` is replaced.  ``model_file`` has to be readable under the same path on every executor.
    """

    bound_batches(df.sparkSession)
    @F.arrow_udf(ENCODED)
    def encode(texts: pa.Array) -> pa.Array:
        codec = codec_for(model_file)
        batch = as_bytes(texts)
        got = list(codec.encode_all(batch))
        decoded = pa.array([codec.decode(g[0]) for g in got] if decode else [None] * len(got), pa.string())
        columns = [pa.array([len(g[0]) for g in got], pa.int64()), lists([g[0] for g in got]), lists([g[1] for g in got]), lists([g[2] for g in got]), decoded]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "ids", "begins", "ends", "decoded"])

    return df.withColumn(to, encode(F.col(text)))


def encoded_documents(df: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, the ids, the source bytes at which pieces end, and digests of ids and decoded text.

    A null text is encoded like an empty one: no pieces.  Texts are encoded whole, however long.  Repeated rows and ids give a
    row each, an empty table none; other columns are ignored, whatever they are called.
    """
    from hashlib import sha256

    kind = "struct<n_tokens: long, ids: array<int>, ends: array<int>, ids_sha256: string, decoded_sha256: string>"

    bound_batches(df.sparkSession)
    @F.arrow_udf(kind)
    def encode(texts: pa.Array) -> pa.Array:
        codec = codec_for(model_file)
        ids, ends, digests = [], [], []
        for i, _, e, joined in codec.encode_all(as_bytes(texts)):
            ids.append(i.astype(np.int32))
            ends.append(e.astype(np.int32))
            digests.append((sha256(joined.encode()).hexdigest(), sha256(codec.decode(i).encode()).hexdigest()))
        release()
        columns = [pa.array([len(i) for i in ids], pa.int64()), lists(ids), lists(ends), pa.array([d[0] for d in digests], pa.string()), pa.array([d[1] for d in digests], pa.string())]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "ids", "ends", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col), encode(F.col(text)).alias("d")).select(id_col, "d.*")


def encoding_digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, digests of the ids and of the decoded text, and the source bytes that the pieces span.

    The digests are taken where the pieces are made, so that no arrays leave the Python worker.  A null text is encoded like
    an empty one; texts are encoded whole; repeated rows give a row each, an empty table none; other columns are ignored.
    """
    from hashlib import sha256

    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spanned_bytes", pa.int64())])

    bound_batches(df.sparkSession)
    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string, spanned_bytes: long>")
    def digests(texts: pa.Array) -> pa.Array:
        codec, rows = codec_for(model_file), []
        for ids, begins, ends, joined in codec.encode_all(as_bytes(texts)):
            rows.append(
                {
                    "n_tokens": len(ids),
                    "ids_sha256": sha256(joined.encode()).hexdigest(),
                    "decoded_sha256": sha256(codec.decode(ids).encode()).hexdigest(),
                    "spanned_bytes": int((ends - begins).sum()),
                }
            )
        release()
        return pa.array(rows, kind)

    return df.select(F.col(id_col), digests(F.col(text)).alias("d")).select(id_col, "d.*")
