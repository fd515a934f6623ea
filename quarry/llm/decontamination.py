"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised to words.  The automaton holds every run of words of every item; a
document streams through it one word at a time, and the length of the longest run that ends at the word
tells whether a window of an item occurs there.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bound_batches, release, fresh

#: Words of a window; an item of fewer is one window.
WINDOW = 13
#: A document is contaminated if this many times its hit words are at least its words.
COVERAGE = 20
#: Words of items in one automaton: larger item sets are cut to blocks of so many.
BLOCK_WORDS = 400_000
#: Automata that a worker holds at once, and bytes of text that are taken together where there are more.
HELD, TOGETHER_BYTES = 5, 16 << 20

#: Bytes to normalised bytes: A-Z to lower case, other ASCII than digits and letters to spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_TABLE).split() if data else []


class SuffixAutomaton:
    """All runs of words of ``items``; ``scan(words)`` finds the windows of items that occur."""

    def __init__(self, items: Sequence[tuple[str, Sequence[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        self.least = window
        ends: list[list[int]] = []
        for name, words in items:
            if not words:
                continue
            self.names.append(name)
            self.least = min(self.least, len(words))
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                path.append(last)
            ends.append([self.vocabulary[w] for w in words])
        #: Of states whose runs include one of exactly ``window`` words: the items with it.
        self.full: dict[int, list[int]] = {}
        #: Of states with an item of fewer words: its length and the items.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, ids in enumerate(ends):
            state, n = 0, 0
            for t in ids:  # the item's own path: all its runs are in the automaton
                state, n = self._step(state, n, t)
                if n >= window:
                    at = state
                    while self.length[self.link[at]] >= window:
                        at = self.link[at]
                    own = self.full.setdefault(at, [])
                    if not own or own[-1] != k:
                        own.append(k)
            if len(ids) < window:
                at = state
                while self.length[self.link[at]] >= len(ids):
                    at = self.link[at]
                self.short.setdefault(at, []).append((len(ids), k))
        self._pack()

    def _pack(self) -> None:
        """Flat arrays in place of a dictionary for each state: most states have one way on, its word and where it leads; dictionaries stay for the others."""
        self.word, self.to, self.more = array("i", [-1]) * len(self.next), array("i", [-1]) * len(self.next), {}
        for state, ways in enumerate(self.next):
            if len(ways) == 1:
                ((self.word[state], self.to[state]),) = ways.items()
            elif ways:
                self.more[state] = ways
        self.more.setdefault(0, {})
        self.link, self.length = array("i", self.link), array("i", self.length)
        del self.next

    def _extend(self, last: int, t: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if t in nxt[last]:
            q = nxt[last][t]
            return q if length[q] == length[last] + 1 else self._clone(last, q, t)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and t not in nxt[p]:
            nxt[p][t] = new
            p = link[p]
        if p != -1:
            q = nxt[p][t]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, t)
        return new

    def _clone(self, p: int, q: int, t: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p != -1 and nxt[p].get(t) == q:
            nxt[p][t] = c
            p = link[p]
        return c

    def _step(self, state: int, n: int, t: int) -> tuple[int, int]:
        """The longest run that ends with word t after the run of n words at ``state``."""
        nxt, link = self.next, self.link
        while state and t not in nxt[state]:
            state = link[state]
            n = self.length[state]
        return (nxt[state][t], n + 1) if t in nxt[state] else (0, 0)

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal spans of hit words (start, end) and the numbers of the items with windows that occur."""
        word, ways, more, link, length, least = self.word, self.to, self.more, self.link, self.length, self.least
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state, n = 0, 0
        for i, t in enumerate(map(self.vocabulary.get, words)):
            if t is None:
                state = n = 0
                continue
            while True:  # the longest run that ends with word t after the run of n words at `state`
                if word[state] == t:
                    to = ways[state]
                    break
                if state in more:
                    to = more[state].get(t)
                    if to is not None:
                        break
                if not state:
                    to = None
                    break
                state = link[state]
                n = length[state]
            if to is None:
                n = 0
                continue
            state = to
            n += 1
            if n >= least:
                hit = self._windows(state, n, items)
                if hit:
                    start = i + 1 - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items

    def _windows(self, state: int, n: int, items: set[int]) -> int:
        """Adds the items with a window that ends here; the words of the longest such run, 0 for none."""
        at, hit = state, 0
        if n >= self.window:
            while self.length[self.link[at]] >= self.window:
                at = self.link[at]
            items.update(self.full[at])
            hit = self.window
        while at > 0 and self.short:
            for size, k in self.short.get(at, ()):
                if size <= n:
                    items.add(k)
                    hit = max(hit, size)
            at = self.link[at]
        return hit


def item_blocks(items: DataFrame, id_col: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (id, words), in blocks of bounded size, streamed to the driver one partition at a time."""
    block, n = [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text)).toLocalIterator():
        words = words_of((row[1] or "").encode())
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((str(row[0]), words))
        n += len(words)
    yield block


def unite(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def word_offsets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text begin and end."""
    word = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cut(data: bytes, spans: Sequence[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    begin, end = word_offsets(data)
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : begin[s]])
        at = int(end[e - 1])
    return b"".join([*out, data[at:]])


FOUND = "struct<n_words: long, n_hit: long, spans: array<struct<start: int, end: int>>, items: array<string>, clean_text: string>"


def find_contamination(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, found: str = "found", block_words: int = BLOCK_WORDS, with_text: bool = True, least_cut: int = WINDOW) -> DataFrame:
    """``df`` with a struct ``found``: n_words, n_hit, spans of hit words, ids of items with occurring windows (sorted as
    strings) and the text without the spans of ``least_cut`` words at least (null if ``with_text`` is false or there is none).

    Nulls and empty texts have no words; items without words have no windows; with no items nothing is hit.  An
    item id that comes twice counts once.  Repeated rows give repeated rows, an empty table none.  Texts are scanned whole, however
    long.  A column called like ``found`` is replaced.  Each automaton holds ``block_words`` words of items; a worker holds
    HELD of them, and where there are more they are loaded one after another, each once for TOGETHER_BYTES of text.
    """
    bound_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    shared = [context.broadcast(SuffixAutomaton(b, window)) for b in item_blocks(items, item_id, item_text, block_words)]  # each of a bounded size
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string())), ("clean_text", pa.string())])

    def look(batches: list[list[list[bytes]]]) -> list[list[tuple[list[tuple[int, int]], set[str]]]]:
        """Spans and items of each text of some batches: each automaton is at hand once for all of them."""
        got = [[([], set()) for _ in words] for words in batches]
        for b in shared:
            automaton = b.value
            for words, results in zip(batches, got, strict=True):
                for own, (spans, ids) in zip(words, results, strict=True):
                    hit, of = automaton.scan(own)
                    spans += hit
                    ids.update(automaton.names[k] for k in of)
            if len(shared) > HELD:
                b.__dict__.pop("_value", None)
        return got

    def told(texts: list[bytes | None], words: list[list[bytes]], results: list) -> pa.Array:
        rows = []
        for data, own, (hits, ids) in zip(texts, words, results, strict=True):
            spans = unite(hits)
            long = [x for x in spans if x[1] - x[0] >= least_cut]
            clean = cut(data, long).decode("utf-8", "replace") if long and with_text else None
            rows.append({"n_words": len(own), "n_hit": sum(e - s for s, e in spans), "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(ids), "clean_text": clean})
        return pa.array(rows, kind)

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, size = [], 0
        for texts in batches:
            held.append(as_bytes(texts))
            size += texts.nbytes
            if len(shared) <= HELD or size >= TOGETHER_BYTES:
                yield from finish(held)
                held, size = [], 0
                release()
        yield from finish(held)

    def finish(held: list[list[bytes | None]]) -> Iterator[pa.Array]:
        words = [[words_of(data) for data in texts] for texts in held]
        for texts, own, results in zip(held, words, look(words), strict=True):
            yield told(texts, own, results)

    return df.withColumn(found, scan.asNondeterministic()(F.col(text)))  # a filter on it doesn't evaluate it twice


def contaminated(found: str, coverage: int = COVERAGE):
    return (F.col(f"{found}.n_hit") > 0) & (F.lit(coverage) * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def remove_contamination(df: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, coverage: int = COVERAGE, **options: object) -> DataFrame:
    """``df`` without contaminated documents; of the others, which are below the coverage limit, spans of at least a window are cut out of the text.

    Shorter spans, of items of fewer words, count for the coverage and stay.  Null and empty texts stay as they are; repeated
    rows are judged each; an empty table gives no rows; no other column is changed.
    """
    mark = fresh(df, "found_")
    found = find_contamination(df, items, text, window=window, found=mark, least_cut=window, **options).filter(~contaminated(mark, coverage))
    return found.withColumn(text, F.coalesce(F.col(f"{mark}.clean_text"), F.col(text))).select(*df.columns)


def ids_digest(ids: Sequence[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
