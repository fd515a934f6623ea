"""Text functions as columns: tokenizers, normalisation, slugs, phrases.

All are built from Catalyst expressions, so they stay in whole-stage code and need no Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import values as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Search tokens: runs of ASCII letters and digits of the lower-cased text; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def rich_tokens(text: Column) -> Column:
    """Evaluation tokens, which keep plus, dot, hash and hyphen after their first sign."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9+.#-]*"), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Tokens of a query without function words; a query of nothing else keeps all.  Repeats count."""

    def content(all_: Column) -> Column:
        return let(F.filter(all_, lambda t: ~t.isin(*V.STOPWORDS)), lambda c: F.when(F.size(c) > 0, c).otherwise(all_))

    return let(tokens(text), content)


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct windows of ``size`` tokens; none for a shorter text."""

    def windows(t: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(size)), " "))
        return F.when(F.size(t) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))

    return let(tokens(text), windows)


def squeeze(text: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Typographic variants of hyphens, quotes and spaces to their plain forms."""
    singles = {k: v for k, v in V.PUNCTUATION.items() if len(v) <= 1}
    kept = [k for k, v in singles.items() if v] + [k for k, v in singles.items() if not v]
    out = F.translate(text, "".join(kept), "".join(singles[k] for k in kept))
    for k, v in V.PUNCTUATION.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def comparable(text: Column) -> Column:
    """The form in which quotes and cards are compared: lower case, folded, without emphasis signs, squeezed."""
    return squeeze(F.lower(fold(F.translate(text, V.EMPHASIS, ""))))


def quote_occurs(quote: Column, card: Column, least: int = 12) -> Column:
    """Whether a quote of at least ``least`` comparable signs occurs in a card."""
    q = comparable(F.coalesce(quote, F.lit("")))
    return (F.length(q) >= least) & F.contains(comparable(F.coalesce(card, F.lit(""))), q)


def slug(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold(F.trim(label))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip_markup(text: Column) -> Column:
    """Tags to spaces, the common entities to their signs, white space squeezed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for name, sign in V.ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return squeeze(out)


def iso_duration(text: Column) -> Column:
    """``H:M:S`` (or M:S, or S) as an ISO-8601 duration; anything else as it is, blank as null."""
    t = F.trim(text)
    parts = F.transform(F.split(t, ":"), lambda p: p.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 60 + p)
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    made = F.concat(F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""), s.cast("string"), F.lit("S"))
    return F.when(t == "", None).when(t.startswith("PT") | ~t.rlike(r"^[0-9]+(:[0-9]+)*$"), t).otherwise(made)


def size_phrase(parameters: Column) -> Column:
    """A parameter count as people type it: number and unit, size words, and words for where it runs."""
    billion = F.lit(1_000_000_000).cast("long")

    def six(v: Column) -> Column:
        """Six significant digits without trailing zeros."""
        text = F.format_string("%.6f", v)
        digits = F.greatest(F.lit(0), 6 - F.length(F.split_part(text, F.lit("."), F.lit(1))))
        rounded = F.aggregate(F.array(digits), v, lambda acc, d: F.bround(acc * F.pow(F.lit(10.0), d)) / F.pow(F.lit(10.0), d))
        return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", rounded), "0+$", ""), "[.]$", "")

    size = F.when(parameters >= billion, F.concat(six(parameters / 1e9), F.lit("B"))).otherwise(F.concat(six(parameters / 1e6), F.lit("M")))
    band = F.when(parameters <= billion, "small tiny lightweight").when(parameters <= 15 * billion, "mid-sized single GPU").otherwise("large frontier scale datacenter")
    place = F.when(parameters <= 9 * billion, " local laptop on-device").otherwise("")
    return F.concat(size, F.lit(" parameters "), band, place)


def parameter_band(parameters: Column) -> Column:
    """Half-open bands of parameter counts; null is unknown."""
    out = F.when(parameters.isNull(), "unknown")
    for low, high, label in V.PARAMETER_BANDS:
        inside = parameters >= low
        out = out.when(inside & (parameters < high) if high is not None else inside, label)
    return out.otherwise("unknown")


def age_bucket(modified: Column, as_of: Column) -> Column:
    """Months (of 30.4 days) since a time: cumulative buckets in order; null is unknown."""
    days = (F.unix_micros(as_of) - F.unix_micros(modified)) / 86_400e6
    out = F.when(modified.isNull(), "unknown")
    for months in (3, 6, 12):
        out = out.when(days <= 30.4 * months, f"<={months} months")
    return out.otherwise(">12 months")


def recency(modified: Column, as_of: Column, half_life_days: float = 365.0) -> Column:
    """Half-life decay by whole days of age, to four places; no date scores 0."""
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(modified)) / 86_400e6)
    return F.when(modified.isNull(), 0.0).otherwise(F.bround(F.pow(F.lit(0.5), F.greatest(F.lit(0), days) / F.lit(half_life_days)), 4))


def canonical_language(value: Column) -> Column:
    """ISO-639-1 code of a known language name or code, else the trimmed lower-case value."""
    key = F.lower(F.trim(value))
    codes = F.create_map(*[F.lit(x) for code, name in V.LANGUAGES.items() for x in (name, code)])
    return F.coalesce(F.try_element_at(codes, key), key)


def language_aliases(value: Column) -> Column:
    """A language's key with its code or name where known."""
    key = F.lower(F.trim(value))
    names = F.create_map(*[F.lit(x) for pair in V.LANGUAGES.items() for x in pair])
    codes = F.create_map(*[F.lit(x) for code, name in V.LANGUAGES.items() for x in (name, code)])
    return F.array_distinct(F.array_compact(F.array(key, F.try_element_at(names, key), F.try_element_at(codes, key))))


def plausible_language(value: Column) -> Column:
    """Whether free text may name a natural language: no digits, at most two words, not a programming language."""
    key = squeeze(F.lower(value))
    return (key != "") & ~key.rlike("[0-9]") & ~key.isin(*V.PROGRAMMING_LANGUAGES) & (F.size(F.split(key, " ")) <= 2)


def ordered_distinct(values: Column) -> Column:
    """Non-empty values, each once, in order of first sight."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def languages(declared: Column, derived: Column) -> Column:
    """Declared languages first, then plausible ones read from a card, as codes, each once."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(declared, empty), F.filter(F.coalesce(derived, empty), plausible_language))
    return ordered_distinct(F.transform(both, canonical_language))


def heading_role(title: Column) -> Column:
    """The first role of which a keyword occurs anywhere in a heading."""
    low = F.lower(F.trim(title))
    out = F.when(low == "", "preamble")
    for role, words in V.SECTION_ROLES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, role)
    return out.otherwise("other")


def placeholders(text: Column) -> Column:
    """Blanks left unfilled in a card template."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?i)\[?More Information Needed\]?"))


def usable_card(clean_text: Column, least: int = 240, most_blanks: int = 5) -> Column:
    return (F.length(clean_text) >= least) & (placeholders(clean_text) <= most_blanks)


def card_anchor(page: Column, version: Column, quote: Column) -> Column:
    """The card's address at a revision, with a text fragment of the quote's first 60 signs."""
    base = F.concat(page, F.lit("/blob/"), F.coalesce(F.nullif(version, F.lit("")), F.lit("main")), F.lit("/README.md"))
    start = F.substring(squeeze(quote), 1, 60)
    coded = F.replace(F.replace(F.url_encode(start), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    coded = F.replace(F.replace(coded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.when(start == "", base).otherwise(F.concat(base, F.lit("#:~:text="), coded))


def tidy_reason(text: Column) -> Column:
    """A judge's reason without stock openings and edge signs, its first letter upper case."""
    core = F.ltrim(F.trim(F.coalesce(text, F.lit(""))), F.lit(". "))
    core = F.regexp_replace(core, "(?i)^(?:" + "|".join(V.REASON_OPENINGS) + r")\s*", "")
    return F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, 2, 1 << 20))


def thread_title(question: Column, most: int = 72) -> Column:
    """A question on one line; a longer one than ``most`` is cut and ends in an ellipsis."""
    return let(squeeze(question), lambda q: F.when(F.length(q) > most, F.concat(F.substring(q, 1, most - 1), F.lit("…"))).otherwise(q))


def thread_digest(text: Column, most: int = 4000) -> Column:
    """What a thread is found by: its text on one line in lower case, cut."""
    return F.substring(F.lower(squeeze(text)), 1, most)


def thread_matches(title: Column, digest: Column, term: str) -> Column:
    return F.contains(digest, F.lit(term.lower())) | F.coalesce(F.contains(F.lower(title), F.lit(term.lower())), F.lit(False))
