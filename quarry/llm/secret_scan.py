"""Secret scans with one combined deterministic automaton.

Rule regexes are parsed to position automata; subset construction runs all rules together, with the matches
of a rule kept apart by where they began, so that leftmost, longest, non-overlapping matches end where the
automaton says.  The result is minimised to transition arrays over byte classes.  One pass over a text's
bytes finds the ends of all rules' matches; transition arrays of the reversed rule give each match's start.  Both are compiled once, in
the driver, and broadcast.

A rule has to be one of those whose matches, once complete, either grow with the next byte or end
(``body+`` at the end or a fixed length): that is checked when rules are compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from re import _constants as K
from re import _parser as P

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bound_batches


@dataclass(frozen=True)
class Rule:
    """``pattern``: a regex of literals, classes, groups, alternatives and repeats over ASCII; ``nocase`` literals in either case.

    A match counts if ``group`` (0: all of it) is at least ``least`` long.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    nocase: str = ""


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, "keyword"),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Formats of tokens that issuers publish: fixed values.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# --- regex to position automaton -------------------------------------------------------------------


def cased(rule: Rule) -> str:
    """The pattern with its first group's letters in either case, if the rule asks for that."""
    if rule.nocase != "keyword":
        return rule.pattern
    end = rule.pattern.index(")")
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", rule.pattern[: end + 1]) + rule.pattern[end + 1 :]


def char_set(op: int, arg: object) -> frozenset[int]:
    if op is K.LITERAL:
        return frozenset([arg])
    if op is K.NOT_LITERAL:
        return frozenset(range(128)) - {arg}
    if op is K.IN:
        out: set[int] = set()
        negate = False
        for o, a in arg:
            if o is K.NEGATE:
                negate = True
            elif o is K.LITERAL:
                out.add(a)
            elif o is K.RANGE:
                out.update(range(a[0], a[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {o}")
        return frozenset(range(128)) - out if negate else frozenset(out)
    raise ValueError(f"not supported in a rule: {op}")


@dataclass
class Positions:
    """Glushkov's position automaton: sets of first, last and following positions, each position with its bytes."""

    sets: list[frozenset[int]] = field(default_factory=list)
    follow: list[set[int]] = field(default_factory=list)
    first: set[int] = field(default_factory=set)
    last: set[int] = field(default_factory=set)

    @classmethod
    def of(cls, pattern: str) -> Positions:
        own = cls()
        own.first, own.last, empty = own.build(list(P.parse(pattern)))
        if empty:
            raise ValueError("a rule may not match nothing")
        if any(own.follow[p] - own.last for p in own.last):
            raise ValueError("a complete match of a rule must grow with each byte or end")
        return own

    def build(self, tree: list) -> tuple[set[int], set[int], bool]:
        first, last, empty = set(), set(), True
        for op, arg in tree:
            if op is K.SUBPATTERN:
                f, la, e = self.build(list(arg[3]))
            elif op is K.BRANCH:
                f, la, e = set(), set(), False
                for part in arg[1]:
                    g, h, i = self.build(list(part))
                    f, la, e = f | g, la | h, e or i
            elif op is K.MAX_REPEAT:
                low, high, part = arg
                f, la, e = self.repeat(low, None if high is K.MAXREPEAT else high, list(part))
            else:
                n = len(self.sets)
                self.sets.append(char_set(op, arg))
                self.follow.append(set())
                f, la, e = {n}, {n}, False
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | la if e else la
            empty = empty and e
        return first, last, empty

    def repeat(self, low: int, high: int | None, part: list) -> tuple[set[int], set[int], bool]:
        """low copies, then either a loop on the last or as many optional copies as are left."""
        first, last, empty = set(), set(), True
        copies = max(low, 1) if high is None else high
        for i in range(copies):
            f, la, e = self.build(part)
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            optional = e or i >= low
            last = last | la if optional else la
            empty = empty and optional
            if high is None and i == copies - 1:
                for p in la:
                    self.follow[p] |= f
        return first, last, empty

    def reverse(self) -> Positions:
        back: list[set[int]] = [set() for _ in self.sets]
        for p, after in enumerate(self.follow):
            for q in after:
                back[q].add(p)
        return Positions(self.sets, back, set(self.last), set(self.first))


# --- subset construction ---------------------------------------------------------------------------


def byte_classes(sets: Sequence[frozenset[int]]) -> tuple[bytes, list[int]]:
    """A table from byte to class, and a byte of each class: bytes that no rule tells apart share a class."""
    seen: dict[tuple[bool, ...], int] = {}
    table, sample = bytearray(256), []
    for b in range(256):
        key = tuple(b in s for s in sets)
        if key not in seen:
            seen[key] = len(sample)
            sample.append(b)
        table[b] = seen[key]
    return bytes(table), sample


#: What one rule's scan knows: sets of positions by where matches began, earliest first; whether the earliest is complete.
Threads = tuple[tuple[frozenset[int], ...], bool]


def advance(nfa: Positions, now: Threads, b: int) -> tuple[Threads, bool]:
    """One byte on; also whether a match ended just before this byte."""
    groups, done = now
    moved = [frozenset(q for p in g for q in nfa.follow[p] if b in nfa.sets[q]) for g in groups]
    if done and not moved[0]:
        groups, moved, done, ended = (), [], False, True  # the scan starts anew at this byte
    else:
        ended = False
    if not done:
        moved.append(frozenset(q for q in nfa.first if b in nfa.sets[q]))
    out: list[frozenset[int]] = []
    held: set[int] = set()
    complete = False
    for g in moved:
        own = g - held  # an earlier match in the same position goes on just as well
        if not own:
            continue
        held |= own
        out.append(own)
        if own & nfa.last:
            # Later starts lose to this one; earlier ones that may still complete stay before it.
            complete = len(out) == 1
            break
    return (tuple(out), complete), ended


def rule_states(nfa: Positions, sample: Sequence[int]) -> tuple[list[list[int]], list[list[bool]], list[bool]]:
    """The scan of one rule as an automaton: next state and 'a match ended' by state and class; whether the state is complete."""
    start: Threads = ((), False)
    number, todo = {start: 0}, [start]
    to: list[list[int]] = []
    ends: list[list[bool]] = []
    while len(to) < len(todo):
        row, flags = [], []
        for b in sample:
            after, ended = advance(nfa, todo[len(to)], b)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append(number[after])
            flags.append(ended)
        to.append(row)
        ends.append(flags)
    return to, ends, [s[1] for s in todo]


def minimised(to: list[list[int]], label: list) -> tuple[list[list[int]], list, list[int]]:
    """Moore's partition refinement; also each old state's new number, 0 for the start."""
    ids: dict = {}
    block = [ids.setdefault(x, len(ids)) for x in label]
    while True:
        ids = {}
        refined = [ids.setdefault((block[s], *[block[t] for t in row]), len(ids)) for s, row in enumerate(to)]
        if len(ids) == len(set(block)):
            break
        block = refined
    keep: dict[int, int] = {}
    for s, b in enumerate(refined):
        keep.setdefault(b, s)
    return [[refined[t] for t in to[s]] for s in keep.values()], [label[s] for s in keep.values()], refined


def reversed_rows(nfa: Positions, sample: Sequence[int]) -> tuple[list[list[int]], list[int], int]:
    """A reversed rule as an automaton: next state by state and class, each state's mark (0: nothing can follow, 2: a match may begin here), and the start."""
    number: dict[frozenset[int] | None, int] = {None: 0, frozenset(): 1}
    states: list[frozenset[int] | None] = list(number)  # None is the start, before any byte
    to: list[list[int]] = []
    while len(to) < len(states):
        own = states[len(to)]
        after = nfa.first if own is None else {q for p in own for q in nfa.follow[p]}
        row = []
        for b in sample:
            key = frozenset(q for q in after if b in nfa.sets[q])
            if key not in number:
                number[key] = len(states)
                states.append(key)
            row.append(number[key])
        to.append(row)
    marks = [1 if s is None else 0 if not s else 2 if s & nfa.last else 1 for s in states]
    rows, marks, places = minimised(to, marks)
    return rows, marks, places[0]


def linked(rows: Sequence[Sequence[int]], marks: Sequence[int]) -> list[list]:
    """Transition arrays: each state is the list of its successors by class, its last entry its mark."""
    table: list[list] = [[None] * len(row) + [mark] for row, mark in zip(rows, marks, strict=True)]
    for own, row in zip(table, rows, strict=True):
        for c, t in enumerate(row):
            own[c] = table[t]
    return table


class Scanner:
    """All rules in one automaton.  ``scan(data)`` gives (kind number, start, end) in bytes, ordered by start and kind."""

    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        self.rules = rules
        nfas = [Positions.of(cased(r)) for r in rules]
        self.classes, sample = byte_classes([s for n in nfas for s in n.sets])
        width = len(sample)
        parts = []
        for n in nfas:
            to, ends, complete = rule_states(n, sample)
            # Moore form: a state also says whether a match ended before the byte that led to it.
            number, states = {(0, False): 0}, [(0, False)]
            rows: list[list[int]] = []
            while len(rows) < len(states):
                s, _ = states[len(rows)]
                row = []
                for c in range(width):
                    key = (to[s][c], ends[s][c])
                    if key not in number:
                        number[key] = len(states)
                        states.append(key)
                    row.append(number[key])
                rows.append(row)
            rows, labels, _ = minimised(rows, [(e, complete[s]) for s, e in states])
            parts.append((rows, labels))
        start = tuple(0 for _ in parts)
        number, states = {start: 0}, [start]
        to: list[list[int]] = []
        while len(to) < len(states):
            own = states[len(to)]
            row = []
            for c in range(width):
                key = tuple(p[0][s][c] for p, s in zip(parts, own, strict=True))
                if key not in number:
                    number[key] = len(states)
                    states.append(key)
                row.append(number[key])
            to.append(row)
        label = [(tuple(k for k, (p, s) in enumerate(zip(parts, own, strict=True)) if p[1][s][0]), tuple(k for k, (p, s) in enumerate(zip(parts, own, strict=True)) if p[1][s][1])) for own in states]
        to, label, _ = minimised(to, label)
        # States that end a match come last, so one comparison tells them.
        order = sorted(range(len(to)), key=lambda s: (bool(label[s][0]), s))
        place = {s: i for i, s in enumerate(order)}
        self.n_states, self.width = len(to), width
        self.start = place[0]
        self.ending = next((i for i, s in enumerate(order) if label[s][0]), len(to))
        self.ended = [label[s][0] for s in order]
        self.complete = [label[s][1] for s in order]
        self.rows = [[place[t] for t in to[s]] for s in order]
        self.back_rows = [reversed_rows(n.reverse(), sample) for n in nfas]
        self.checks: list[re.Pattern | None] = [re.compile(cased(r).encode()) if r.group else None for r in rules]
        self.link()

    def link(self) -> None:
        self.table = linked(self.rows, range(len(self.rows)))
        self.back = [linked(rows, marks)[start] for rows, marks, start in self.back_rows]

    def __getstate__(self) -> dict:
        """Without the linked arrays, which refer to each other as deep as there are states."""
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "back")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.link()

    def ends(self, classes: bytes) -> list[tuple[int, int, int]]:
        """(kind, least start, end) of every match that can be long enough, by one pass over the classes of bytes.

        Matches of a kind don't overlap, so one that ends less than ``least`` bytes after the last is too short.
        """
        found: list[tuple[int, int, int]] = []
        before, short = [0] * len(self.rules), [r.least for r in self.rules]
        state, width, ending, i = self.table[self.start], self.width, self.ending, 0
        for b in classes:
            state = state[b]
            if state[width] >= ending:
                for k in self.ended[state[width]]:
                    if i - before[k] >= short[k]:
                        found.append((k, before[k], i))
                    before[k] = i
            i += 1
        return found + [(k, before[k], i) for k in self.complete[state[width]] if i - before[k] >= short[k]]

    def begin(self, kind: int, classes: bytes, end: int, least: int) -> int:
        """Where the match of a rule that ends at ``end`` began: the reversed rule's longest match back to ``least``."""
        state, width, best = self.back[kind], self.width, end
        for at in range(end - 1, least - 1, -1):
            state = state[classes[at]]
            mark = state[width]
            if mark == 2:
                best = at
            elif not mark:
                break
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        spans, classes = [], data.translate(self.classes)
        for kind, least, end in self.ends(classes):
            start = self.begin(kind, classes, end, least)
            rule = self.rules[kind]
            at = start
            if self.checks[kind] is not None:
                at = self.checks[kind].fullmatch(data, start, end).start(rule.group)
            if end - at >= rule.least:
                spans.append((kind, start, end))
        return sorted(spans, key=lambda s: (s[1], s[0]))


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner_for(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def code_points(data: bytes, offsets: Sequence[int]) -> dict[int, int]:
    """Code point offsets of byte offsets."""
    out, at, n = {}, 0, 0
    for o in sorted(set(offsets)):
        n += len(data[at:o].decode("utf-8", "replace"))
        out[o], at = n, o
    return out


def scan_frame(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per row: id and ``found``, an array of (kind, start, end) ordered by start and by the order of the rules.

    Offsets are code points, ends exclusive.  A null or empty text has an empty array.  Repeated rows give
    repeated rows, an empty table none; other columns are ignored.
    """
    bound_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(scanner_for(rules))
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf("array<struct<kind: string, start: int, end: int>>")
    def found(texts: pa.Array) -> pa.Array:
        scanner, out = sent.value, []
        for data in as_bytes(texts):
            spans = scanner.scan(data) if data else []
            at = code_points(data, [o for s in spans for o in s[1:]]) if spans else {}
            out.append([{"kind": rules[k].kind, "start": at[s], "end": at[e]} for k, s, e in spans])
        return pa.array(out, pa.list_(item))

    out = df.select(F.col(id_col), found(F.col(text)).alias("found"))
    return also(out) if also else out
