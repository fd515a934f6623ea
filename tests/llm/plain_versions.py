"""Definitions in plain Python, by which the operators are tested."""

import hashlib
import re
from datetime import date, timedelta
from itertools import combinations

from quarry.llm import secret_scan
from quarry.llm.decontamination import WINDOW
from quarry.llm.pii import DAYS, FIRST_DAY, ROUNDS
from quarry.llm.simhash import DISTANCE

def naive_feistel(x: int, a: int, b: int, key: str, kind: str) -> int:
    left, right = divmod(x, b)
    for i in range(ROUNDS):
        half = right if i % 2 == 0 else left
        v = int(hashlib.sha256(f"{key}:{kind}:{i}:{half}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + v) % a
        else:
            right = (right + v) % b
    return left * b + right


def naive_luhn(d: str) -> bool:
    v = [int(c) for c in reversed(d)]
    return (sum(v[::2]) + sum(2 * x - 9 * (x > 4) for x in v[1::2])) % 10 == 0


def naive_replacement(m: str, key: str) -> tuple[str | None, str]:
    def permuted(d: str, kind: str) -> str:
        low = len(d) // 2
        return str(naive_feistel(int(d), 10 ** (len(d) - low), 10**low, key, kind)).zfill(len(d))

    def refilled(s: str, d: str) -> str:
        it = iter(d)
        return "".join(next(it) if c in "0123456789" else c for c in s)

    only = re.sub("[^0-9]", "", m)
    if "@" in m:
        return "email", "u" + hashlib.sha256(f"{key}:email:{m.lower()}".encode()).hexdigest()[:11] + m[m.index("@") :]
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4}", m):
        iso = m[4] == "-"
        y, mo, d = (int(m[:4]), int(m[5:7]), int(m[8:])) if iso else (int(m[6:]), int(m[3:5]), int(m[:2]))
        try:
            n = (date(y, mo, d) - FIRST_DAY).days
        except ValueError:
            return None, m
        if not 0 <= n < DAYS[0] * DAYS[1]:
            return None, m
        to = FIRST_DAY + timedelta(naive_feistel(n, *DAYS, key, "date"))
        return "date", to.strftime("%Y-%m-%d") if iso else to.strftime(f"%d{m[2]}%m{m[2]}%Y")
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        a, g, s = (int(p) for p in m.split("-"))
        if a in (0, 666) or a > 899 or not g or not s:
            return None, m
        y = naive_feistel(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, key, "ssn")
        y, s = divmod(y, 9999)
        a, g = divmod(y, 99)
        return "ssn", f"{a + 1 + (a + 1 >= 666):03}-{g + 1:02}-{s + 1:04}"
    if m.startswith("+"):
        two = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98}
        if not 7 <= len(only) <= 15 or only[0] == "0" or only[:2] in ("28", "83", "89"):
            return None, m
        n = 1 if only[0] in "17" else 2 if int(only[:2]) in two else 3
        return "phone", refilled(m, only[:n] + permuted(only[n:], "phone"))
    if m.count(".") == 3:
        o = [int(p) for p in m.split(".")]
        if max(o) > 255:
            return None, m
        y = naive_feistel(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, key, "ipv4")
        return "ipv4", ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
    if not naive_luhn(only):
        return None, m
    body = permuted(only[:-1], "card")
    return "card", refilled(m, body + next(c for c in "0123456789" if naive_luhn(body + c)))


def naive_components(fps: list[int], ids: list[int], distance: int = DISTANCE) -> list[int]:
    """The definition, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def naive_hits(words: list[bytes], items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> tuple[set[int], set[str]]:
    """The definition, by comparing every window at every place: hit word numbers and item ids."""
    hit: set[int] = set()
    ids: set[str] = set()
    for name, own in items:
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                ids.add(name)
    return hit, ids


def naive_spans(text: str, rules: tuple = secret_scan.RULES) -> list[tuple[str, int, int]]:
    """The definition, a rule at a time by the regex library."""
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(secret_scan.cased(r), text) if len(m[r.group]) >= r.least]
    return [(rules[k].kind, s, e) for s, k, e in sorted(out)]


def greedy_count(word: str, initial: set[str], continuing: set[str], unknown: int = 1) -> int:
    """The definition, by trying every length."""
    at, n = 0, 0
    while at < len(word):
        vocabulary = continuing if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return unknown
        at, n = end, n + 1
    return n
