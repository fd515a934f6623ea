"""Token counts by linear longest-match over a vocabulary trie.

Greedy word pieces take the longest vocabulary entry at each point of a word.  A trie with failure links
finds them in one pass without stepping back (the scheme published as LinMaxMatch, 2021): when no edge
leaves a node, its failure link names the node that stands for what is left after the greedy pieces of the
node's string have been popped.  Only their number is kept here, so a word's count is a sum of numbers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bound_batches

#: Words a worker remembers the counts of before it forgets them all.
MEMO_WORDS = 200_000
NONE = -1


class PieceCounter:
    """The trie automaton of a vocabulary of initial pieces and of continuation pieces.

    ``count(word)`` is the number of greedy pieces of a word, or ``unknown`` (1 by default) for a word that
    the vocabulary can't spell.
    """

    def __init__(self, initial: Iterable[str], continuing: Iterable[str], unknown: int = 1) -> None:
        self.unknown = unknown
        self.edges: list[dict[str, int]] = [{}, {}]  # nodes 0 and 1: roots of initial and of continuation pieces
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for ch in piece:
                    step = self.edges[node].get(ch)
                    if step is None:
                        step = self.edges[node][ch] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                    node = step
                final[node] = final[node] or bool(piece)
        self.fail = [NONE] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque([(0, ch, v) for ch, v in self.edges[0].items()] + [(1, ch, v) for ch, v in self.edges[1].items()])
        while queue:  # breadth first: shorter strings are done before longer ones
            parent, ch, node = queue.popleft()
            if final[node]:
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, n = self.fail[parent], self.popped[parent]
                while at != NONE and ch not in self.edges[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at != NONE:
                    self.fail[node], self.popped[node] = self.edges[at][ch], n
            queue.extend((node, c, v) for c, v in self.edges[node].items())

    def count(self, word: str) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node, n = 0, 0
        for ch in word:
            step = edges[node].get(ch)
            while step is None:
                n += popped[node]
                node = fail[node]
                if node == NONE:
                    return self.unknown
                step = edges[node].get(ch)
            node = step
        while node > 1:  # pop what is left, to an empty continuation
            n += popped[node]
            node = fail[node]
        return n if node == 1 else (self.unknown if node == NONE else 0)


def vocabulary_of(model_file: str) -> tuple[list[str], list[str]]:
    """Initial pieces (their word-start mark taken off) and continuation pieces of a SentencePiece model file's normal pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    normal = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [p[1:] for p in normal if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]], [p for p in normal if "▁" not in p]


_counters: dict[str, tuple[PieceCounter, dict[bytes, int]]] = {}


def counter_for(model_file: str) -> tuple[PieceCounter, dict[bytes, int]]:
    """This worker's automaton for a vocabulary file, with its memo of words."""
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(*vocabulary_of(model_file), unknown=NONE), {}
    return _counters[model_file]


def count_tokens(df: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_words`` and ``n_unknown`` (words of no spelling), ``n_tokens`` and ``max_word_tokens``.

    Words are the maximal runs of characters other than ASCII white space; a word that can't be spelt is one
    token.  A null or empty text has no words: all zero.  Repeated rows give repeated rows, an empty table none.
    ``model_file`` has to be readable under the same path on every executor, as the tokenizer package is.
    """

    bound_batches(df.sparkSession)
    @F.arrow_udf("struct<n_words: long, n_tokens: long, n_unknown: long, max_word_tokens: long>")
    def counts(texts: pa.Array) -> pa.Array:
        counter, memo = counter_for(model_file)
        rows = []
        for data in as_bytes(texts):
            words = (data or b"").split()
            try:
                got = [memo[w] for w in words]
            except KeyError:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                got = []
                for w in words:
                    n = memo.get(w)
                    if n is None:
                        n = memo[w] = counter.count(w.decode("utf-8", "replace"))
                    got.append(n)
            v = np.array(got, np.int64)
            bad = v == NONE
            rows.append((len(words), int(v.sum()) + 2 * int(bad.sum()), int(bad.sum()), int(np.abs(v).max(initial=0))))
        return pa.array([dict(zip(("n_words", "n_tokens", "n_unknown", "max_word_tokens"), r, strict=True)) for r in rows], pa.struct([(n, pa.int64()) for n in ("n_words", "n_tokens", "n_unknown", "max_word_tokens")]))

    return df.select(F.col(id_col), counts(F.col(text)).alias("c")).select(id_col, "c.*")
