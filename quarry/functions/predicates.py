"""The predicate language: a specification is a conjunction of keys, each of which becomes one column.

Items have typed columns: repository, name, description, task, library, license_status, discovery_scope
(string), parameters (long), category, subject, languages, keywords, capability, limitation and one column of
quotes for each evidence relation (array of string).  Columns that are absent count as null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import values as V

Spec = Mapping[str, object]
RELATIONS = tuple(V.EVIDENCE_COLUMNS)
LISTS = ("category", "subject", "languages", "keywords", "capability", "limitation", *V.EVIDENCE_COLUMNS.values())
NUMBERS = ("parameters",)


class Items:
    """Typed access to an item's columns, absent ones included."""

    def __init__(self, df: DataFrame) -> None:
        self.have = set(df.columns)

    def text(self, c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) if c in self.have else F.lit("")

    def list(self, c: str) -> Column:
        none = F.array().cast("array<string>")
        return F.coalesce(F.col(c), none) if c in self.have else none

    def number(self, c: str) -> Column:
        return F.col(c).cast("long") if c in self.have else F.lit(None).cast("long")

    def lower(self, c: str) -> Column:
        return F.transform(self.list(c), F.lower)

    def evidence(self, relations: Sequence[str] = RELATIONS) -> Column:
        known = [r for r in relations if r in RELATIONS]
        return reduce(lambda a, b: a | b, [F.size(self.list(V.EVIDENCE_COLUMNS[r])) > 0 for r in known], F.lit(False))


def lowered(values: object) -> Column:
    return F.array(*[F.lit(str(v).lower()) for v in values]).cast("array<string>")


def overlap(have: Column, want: object) -> Column:
    return F.coalesce(F.arrays_overlap(have, lowered(want)), F.lit(False))


def any_keyword(i: Items, needles: object, spaced_subjects: bool) -> Column:
    subject = F.array_join(i.list("subject"), " ")
    subject = F.replace(subject, F.lit("-"), F.lit(" ")) if spaced_subjects else subject
    quotes = [F.array_join(i.list(c), " ") for c in V.EVIDENCE_COLUMNS.values()]
    text = F.lower(F.concat_ws(" ", i.text("name"), i.text("description"), F.array_join(i.list("keywords"), " "), F.array_join(i.list("capability"), " "), subject, *quotes))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(str(n).lower())) for n in needles], F.lit(False))


KEYS: dict[str, Callable[[Items, object], Column]] = {
    "repo_any": lambda i, v: F.lower(i.text("repository")).isin([str(x).lower() for x in v]),
    "has_limitations": lambda i, v: (F.size(i.list("limitation")) > 0) == F.lit(bool(v)),
    "task_any": lambda i, v: overlap(F.array_append(i.lower("category"), F.lower(i.text("task"))), v),
    "subject_any": lambda i, v: overlap(i.lower("subject"), v),
    "language_any": lambda i, v: overlap(i.lower("languages"), v),
    "library_any": lambda i, v: F.lower(i.text("library")).isin([str(x).lower() for x in v]),
    "license_status_any": lambda i, v: i.text("license_status").isin([str(x) for x in v]),
    "max_parameters": lambda i, v: F.coalesce(i.number("parameters") <= int(v), F.lit(False)),
    "min_parameters": lambda i, v: F.coalesce(i.number("parameters") >= int(v), F.lit(False)),
    "discovery_scope": lambda i, v: i.text("discovery_scope") == F.lit(v),
    "evidence_type_any": lambda i, v: i.evidence(list(v)),
    "min_confidence": lambda i, v: i.evidence(),
}
BUILDER_KEYS = tuple(k for k in KEYS if k not in ("repo_any", "has_limitations")) + ("keyword_any",)


def compile_spec(df: DataFrame, spec: Spec | None, flavour: str = "benchmark") -> Column:
    """One boolean column for a specification.  Keys that are absent don't constrain; unknown ones are an error.

    Flavour ``builder`` reads subjects with spaces for hyphens in ``keyword_any`` and ignores the two keys
    that only the benchmark knows.
    """
    if flavour not in ("benchmark", "builder"):
        raise ValueError(flavour)
    i, out = Items(df), F.lit(True)
    for key, value in (spec or {}).items():
        if key == "keyword_any":
            out = out & any_keyword(i, value, flavour == "builder")
        elif key not in KEYS:
            raise ValueError(f"unknown predicate {key!r}")
        elif flavour == "benchmark" or key in BUILDER_KEYS:
            out = out & KEYS[key](i, value)
    return out


def relevant(df: DataFrame, query: Mapping[str, object], flavour: str = "benchmark") -> Column:
    """Benchmark: what is required and not to be avoided.  Builder: what is required."""
    out = compile_spec(df, query.get("requires"), flavour)
    if flavour == "benchmark" and query.get("avoid"):
        out = out & ~compile_spec(df, query["avoid"], flavour)
    return out


def trapped(df: DataFrame, query: Mapping[str, object], flavour: str = "benchmark") -> Column:
    return compile_spec(df, query["avoid"], flavour) if query.get("avoid") else F.lit(False)


def judged_pairs(df: DataFrame, queries: Sequence[Mapping[str, object]], key: str, flavour: str = "benchmark") -> DataFrame:
    """(query_id, key, is_gold, is_trap) of every query and item that it wants or warns of: one scan for all queries, no join."""
    marks = [F.struct(F.lit(str(q["id"])).alias("query_id"), relevant(df, q, flavour).alias("is_gold"), trapped(df, q, flavour).alias("is_trap")) for q in queries]
    hits = F.filter(F.array(*marks), lambda m: m["is_gold"] | m["is_trap"])
    return df.select(F.col(key), F.explode(hits).alias("m")).select("m.query_id", key, "m.is_gold", "m.is_trap")


def load_queries(text: str) -> list[dict]:
    """Queries of a JSON list, or of an object's ``queries``; each needs an id and a question."""
    data = json.loads(text)
    queries = data["queries"] if isinstance(data, dict) else data
    for q in queries:
        if not q.get("id") or not q.get("question"):
            raise ValueError(f"a query needs an id and a question: {q!r}")
    return queries


def category(query: Mapping[str, object]) -> str:
    return "known-item" if "repo_any" in (query.get("requires") or {}) else "descriptive"
