"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Numbers and dates that pass their checks are permuted within their own format by a keyed Feistel network, so
equal values get equal pseudonyms in all documents, different ones different, and the result passes the same check.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh

ROUNDS = 8
#: First day and number of days of the dates that are permuted: four centuries, 27 * 5411 days.
FIRST_DAY, DAYS = date(1700, 1, 1), (27, 5411)

#: Candidates by kind, in order of precedence.  Runs are possessive and repeats bounded, so that matching takes time in
#: proportion to a text and little stack whatever the text holds: a name of over 64 signs gives its last 64, and a domain
#: may have 128 labels.
EMAIL = r"[\p{L}0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z+])\+(?:1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3})(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "date": DATE, "ssn": SSN, "phone": PHONE, "ipv4": IPV4, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Digits of an international phone number at most (E.164), and of those that are asked for here at least.
PHONE_DIGITS = (7, 15)
#: Country codes of one and of two digits; all others have three.  First digits that aren't given out.  Fixed values.
SHORT_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
NO_CODES = r"0|28|83|89"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def noise(key: str, kind: str, i: Column, half: Column) -> Column:
    """A number below 2**60 from the key, the kind, the round and a half."""
    text = F.concat(F.lit(f"{key}:{kind}:"), i.cast("string"), F.lit(":"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 ... a*b - 1: halves modulo a and b are shifted in turn by noise of the other half."""
    low = (x % b).cast("long")
    start = F.struct(F.call_function("div", x, b).cast("long").alias("l"), low.alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + noise(key, kind, i, s["r"]) % a, a)).otherwise(s["l"]).cast("long").alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + noise(key, kind, i, s["l"]) % b, b)).cast("long").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def power(n: Column) -> Column:
    """10**n as a long, for n up to 18."""
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n.cast("int") + 1)


def permute_digits(d: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 18 to another of the same length."""
    n = F.length(d)
    low = F.floor(n / 2)
    return F.lpad(feistel(d.cast("long"), power(n - low), power(low), key, kind).cast("string"), n, "0")


def refill(m: Column, new: Column) -> Column:
    """``m`` with its digits replaced by those of ``new``, in order."""
    at = F.sequence(F.lit(1), F.length(m))
    return F.array_join(F.transform(at, lambda i: F.when(m.substr(i, F.lit(1)).rlike("[0-9]"), new.substr(F.length(digits(m.substr(F.lit(1), i))), F.lit(1))).otherwise(m.substr(i, F.lit(1)))), "")


def luhn_sum(d: Column, last_single: bool) -> Column:
    """Luhn's sum; every second digit is doubled, from the last one on unless it stands single."""
    n = F.length(d)

    def part(i: Column) -> Column:
        v = d.substr(n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(v < 5, v * 2).otherwise(v * 2 - 9)
        return F.when(i % 2 == (0 if last_single else 1), twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + part(i))


def new_card(m: Column, key: str) -> Column:
    d = digits(m)
    body = permute_digits(d.substr(F.lit(1), F.length(d) - 1), key, "card")
    return refill(m, F.concat(body, F.pmod(10 - luhn_sum(body, False) % 10, F.lit(10)).cast("string")))


def new_ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    x = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    y = feistel(x, F.lit(65536), F.lit(65536), key, "ipv4")
    return F.element_at(F.transform(F.array(y), lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])), 1)


def date_parts(m: Column) -> tuple[Column, Column, Column]:
    iso = m.substr(5, 1) == "-"
    year = F.when(iso, m.substr(1, 4)).otherwise(m.substr(7, 4)).cast("int")
    month = F.when(iso, m.substr(6, 2)).otherwise(m.substr(4, 2)).cast("int")
    day = F.when(iso, m.substr(9, 2)).otherwise(m.substr(1, 2)).cast("int")
    return year, month, day


def valid_date(m: Column) -> Column:
    y, mo, d = date_parts(m)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    most = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    return y.between(FIRST_DAY.year, FIRST_DAY.year + 399) & mo.between(1, 12) & d.between(1, most)


def new_date(m: Column, key: str) -> Column:
    first = F.lit(FIRST_DAY.isoformat()).cast("date")
    n = F.date_diff(F.make_date(*date_parts(m)), first).cast("long")
    to = F.date_add(first, feistel(n, F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date").cast("int"))
    iso = F.date_format(to, "yyyy-MM-dd")
    mark = m.substr(3, 1)
    return F.when(m.substr(5, 1) == "-", iso).otherwise(F.concat(iso.substr(9, 2), mark, iso.substr(6, 2), mark, iso.substr(1, 4)))


def valid_phone(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(*PHONE_DIGITS) & ~d.rlike(f"^(?:{NO_CODES})")


def new_phone(m: Column, key: str) -> Column:
    """The country code stays, the rest is permuted; both are read off the digits, so all spellings of a number stay linked."""
    d = digits(m)
    code = F.regexp_extract(d, f"^(?:{SHORT_CODES}|[0-9]{{3}})", 0)
    rest = d.substr(F.length(code) + 1, F.length(d))
    return refill(m, F.concat(code, permute_digits(rest, key, "phone")))


def new_ssn(m: Column, key: str) -> Column:
    """Of the numbers that are given out (area 1 to 899 but 666, group 1 to 99, serial 1 to 9999)."""
    area, group, serial = m.substr(1, 3).cast("long"), m.substr(5, 2).cast("long"), m.substr(8, 4).cast("long")
    x = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
    y = feistel(x, F.lit(898 * 99), F.lit(9999), key, "ssn")
    number = F.transform(F.array(y), lambda v: F.struct(F.call_function("div", v, F.lit(99 * 9999)).alias("a"), F.call_function("div", v % (99 * 9999), F.lit(9999)).alias("g"), (v % 9999).alias("s")))
    text = F.transform(number, lambda p: F.concat_ws("-", F.lpad(F.when(p["a"] + 1 >= 666, p["a"] + 2).otherwise(p["a"] + 1).cast("string"), 3, "0"), F.lpad((p["g"] + 1).cast("string"), 2, "0"), F.lpad((p["s"] + 1).cast("string"), 4, "0")))
    return F.element_at(text, 1)


def new_email(m: Column, key: str) -> Column:
    """A keyed name of twelve signs before the domain; letter case of an address doesn't matter."""
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}:email:"), F.lower(m)).cast("binary"), 256), 1, 11), F.regexp_extract(m, "@.*", 0))


def replacement(m: Column, key: str) -> Column:
    """(kind, new text) of a candidate; kind null and the old text if it fails its check."""

    def whole(p: str) -> Column:
        return m.rlike(f"^(?:{p})$")

    def made(kind: str, new: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), new.alias("new"))

    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") < 256)
    ssn = ~m.substr(1, 3).isin("000", "666") & (m.substr(1, 1) != "9") & (m.substr(5, 2) != "00") & (m.substr(8, 4) != "0000")
    return (
        F.when(m.contains("@"), made("email", new_email(m, key)))
        .when(whole(DATE), F.when(valid_date(m), made("date", new_date(m, key))))
        .when(whole(SSN), F.when(ssn, made("ssn", new_ssn(m, key))))
        .when(m.startswith("+"), F.when(valid_phone(m), made("phone", new_phone(m, key))))
        .when(whole(IPV4), F.when(octets, made("ipv4", new_ipv4(m, key))))
        .when(luhn_sum(digits(m), True) % 10 == 0, made("card", new_card(m, key)))
    )


def number(made: Column, kind: str) -> Column:
    return F.coalesce(F.array_size(F.filter(made, lambda x: x["kind"] == F.lit(kind))), F.lit(0)).cast("long")


def pseudonymise(df: DataFrame, key: str, text: str = "text", to: str = "clean_text", counts: str = "n_") -> DataFrame:
    """``df`` with the text in which validated personal data are pseudonyms, and the number of each kind.

    A null text stays null with counts of 0, an empty one stays empty.  What fails its check stays as it is.  Slash and dot dates are
    read day first.  Time grows with a text's length, however long it is and whether or not it has blanks.  Every row is treated
    alone, without a shuffle: repeated rows give repeated rows, an empty table none.  Columns named like the outputs are replaced.
    """
    made = fresh(df, "made_")
    matches = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    outputs = {to, *(counts + k for k in KINDS)}
    others = [c for c in df.columns if c not in outputs or c == text]
    found = fresh(df, "found_")
    mapped = F.when(F.array_size(found) > 0, F.transform(F.col(found), lambda m: F.coalesce(replacement(m, key), F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))))
    gaps = F.split(F.col(text), ANY, -1)
    news = F.concat(F.transform(F.col(made), lambda x: x["new"]), F.array(F.lit("")))
    joined = F.array_join(F.flatten(F.zip_with(gaps, news, lambda g, n: F.array(g, n))), "")
    kept = [F.col(c) for c in others if c != to]
    return (
        df.withColumn(found, matches)
        .withColumn(made, mapped)
        .select(*kept, F.when(F.col(made).isNull(), F.col(text)).otherwise(joined).alias(to), *[number(F.col(made), k).alias(counts + k) for k in KINDS])
    )
