"""What repository names say: owner, kind of packaging, size, family."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import values as V

Patterns = Mapping[str, Sequence[str]]


def owner(repo: Column) -> Column:
    return F.when(F.contains(repo, F.lit("/")), F.split_part(repo, F.lit("/"), F.lit(1))).otherwise("")


def name(repo: Column) -> Column:
    return F.element_at(F.split(repo, "/"), -1)


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """The first pattern of the list that is found in the text, whatever the case; null for none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for p in patterns:
        out = out.when(text.rlike(f"(?i){p}"), p)
    return out


def variant_kind(repo: Column, patterns: Patterns = V.NAME_PATTERNS) -> Column:
    """quantization, format_conversion, checkpoint, mirror or null; of the name alone, never the owner.

    Plain words have to be a whole part of the name; other patterns are searched for.
    """
    own = name(repo)
    parts = F.split(F.lower(own), "[-_.]+")
    out = F.when(own.rlike(f"(?i){V.QUANT_SUFFIX}"), "quantization")
    for kind in ("quantization", "format_conversion"):
        listed = patterns.get(kind, ())
        found = F.arrays_overlap(parts, F.array(*map(F.lit, listed))) if listed else F.lit(False)
        searched = [p for p in listed if not p.isalnum()]
        out = out.when(found | matches_any(own, searched), kind)
    for kind in ("checkpoint", "mirror"):
        out = out.when(matches_any(own, patterns.get(kind, ())), kind)
    return out


def stem(repo: Column, patterns: Patterns = V.NAME_PATTERNS) -> Column:
    """The name without its trailing packaging parts, of which at least one sign stays."""
    words = [re.escape(p) for k in ("quantization", "format_conversion") for p in patterns.get(k, ()) if p.isalnum()]
    tail = "|".join([r"i?q\d+(?:[_-][a-z0-9]+)*", *words])
    return F.regexp_replace(name(repo), f"(?i)(?<=.)(?:[-_.](?:{tail}))+$", "")


def family_key(repo: Column, bases: Column | None = None, patterns: Patterns = V.NAME_PATTERNS) -> Column:
    """A cheap family of a repository: the stem of its first base model, else its own, in lower case."""
    root = repo if bases is None else F.coalesce(F.try_element_at(F.array_sort(bases), F.lit(1)), repo)
    return F.lower(stem(root, patterns))


def family_id(repo: Column, patterns: Patterns = V.NAME_PATTERNS) -> Column:
    """``owner--stem`` as slugs; the stem alone without an owner."""

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")

    own = plain(owner(repo))
    return F.when(own == "", plain(stem(repo, patterns))).otherwise(F.concat(own, F.lit("--"), plain(stem(repo, patterns))))


def size_in_name(repo: Column) -> Column:
    """Parameters from the last '7B' or '350M' of a name; null for none."""
    own = F.lower(name(repo))
    found = F.regexp_extract_all(own, F.lit(r"(?<![a-z0-9.])(?:\d+(?:\.\d+)?)\s*[bm](?![a-z0-9])"), F.lit(0))
    last = F.try_element_at(found, F.lit(-1))
    number = F.regexp_extract(last, r"^\d+(?:\.\d+)?", 0).cast("double")
    return F.when(last.isNotNull(), (number * F.when(last.endswith("b"), 1e9).otherwise(1e6)).cast("long"))


def humanize(repo: Column) -> Column:
    """A name to show: separators to spaces, dots kept before digits."""
    spaced = F.regexp_replace(F.regexp_replace(name(repo), "[-_]+", " "), r"\.(?![0-9])", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def base_models(api: Column, card: Column) -> Column:
    """Declared parents of the API and then of the card, each once, in order; both arrays may be null."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(api, none), F.coalesce(card, none))))
