import pytest
from pyspark.sql import functions as F

from quarry.functions import naming, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("repo", "kind", "stem", "size", "shown"),
    [
        ("org/LFM2.5-2.6B-Heretic-GGUF", "quantization", "LFM2.5-2.6B-Heretic", 2_600_000_000, "LFM2.5 2.6B Heretic GGUF"),
        ("org/Model-Q4_K_M", "quantization", "Model", None, "Model Q4 K M"),
        ("onnx-community/plain", None, "plain", None, "plain"),
        ("org/bert-onnx-int8", "quantization", "bert", None, "bert onnx int8"),
        ("org/x-checkpoint-500", "checkpoint", "x-checkpoint-500", None, "x checkpoint 500"),
        ("org/thing-mirror", "mirror", "thing-mirror", None, "thing mirror"),
        ("gguf", "quantization", "gguf", None, "gguf"),
        ("Qwen/Qwen3-8B", None, "Qwen3-8B", 8_000_000_000, "Qwen3 8B"),
        ("a/b-350m", None, "b-350m", 350_000_000, "b 350m"),
    ],
)
def test_names(spark, repo, kind, stem, size, shown):
    r = F.col("r")
    got = spark.createDataFrame([(repo,)], "r string").select(naming.variant_kind(r), naming.stem(r), naming.size_in_name(r), naming.humanize(r)).first()
    assert tuple(got) == (kind, stem, size, shown)


def test_families_of_names(spark):
    assert one(spark, naming.family_id(F.col("r")), r="Qwen/Qwen2.5-7B-GGUF") == "qwen--qwen2-5-7b"
    assert one(spark, naming.family_id(F.col("r")), r="bert") == "bert"
    assert one(spark, naming.first_match(F.col("r"), ["^b", "T$"]), r="art") == "T$"


@pytest.mark.parametrize(("n", "said"), [(300_000_000, "300M parameters small tiny lightweight local laptop on-device"), (1_100_000_000, "1.1B parameters mid-sized single GPU local laptop on-device"), (8_000_000_000, "8B parameters mid-sized single GPU local laptop on-device"), (70_000_000_000, "70B parameters large frontier scale datacenter"), (1_000_000_000, "1B parameters small tiny lightweight local laptop on-device"), (9_000_000_000, "9B parameters mid-sized single GPU local laptop on-device"), (15_000_000_000, "15B parameters mid-sized single GPU"), (124_439_808, "124.44M parameters small tiny lightweight local laptop on-device")])
def test_size_phrases(spark, n, said):
    assert one(spark, text.size_phrase(F.col("n")), n=n) == said


def test_query_tokens(spark):
    assert one(spark, text.query_tokens(F.col("q")), q="What is the Small SMALL model?") == ["small", "small", "model"]
    assert one(spark, text.query_tokens(F.col("q")), q="it is a") == ["it", "is", "a"]
    assert one(spark, text.tokens(F.col("q")), q="Été naïve") == ["t", "na", "ve"]


def test_quotes(spark):
    card = "The model shows **significantly   enhanced**\nreasoning on “GPT‑2” data…"
    assert one(spark, text.quote_occurs(F.col("q"), F.col("c")), q='significantly enhanced reasoning on "GPT-2" data...', c=card)
    assert not one(spark, text.quote_occurs(F.col("q"), F.col("c")), q="enhanced significantly reasoning", c=card)
    assert not one(spark, text.quote_occurs(F.col("q"), F.col("c")), q="model shows", c=card)  # eleven signs
    assert one(spark, text.quote_occurs(F.col("q"), F.col("c")), q="e model shows", c=card.replace("The", "The"))


@pytest.mark.parametrize(("clock", "iso"), [("1:02:03", "PT1H2M3S"), ("90", "PT1M30S"), ("0:00", "PT0S"), ("PT5S", "PT5S"), ("soon", "soon"), ("  ", None)])
def test_durations(spark, clock, iso):
    assert one(spark, text.iso_duration(F.col("c")), c=clock) == iso


def test_languages(spark):
    got = one(spark, text.languages(F.col("d"), F.col("c")), d=["en", "no"], c=["English", "92 coding languages", "Python", "Quechua", "xml documents containing data"])
    assert got == ["en", "no", "quechua"]
    assert one(spark, text.slug(F.col("s")), s=" Vision‑Language ") == "vision-language"


def test_roles_and_bands(spark):
    for title, role in (("Metadata", "training"), ("How to use", "intended_use"), ("", "preamble"), ("Fun", "other")):
        assert one(spark, text.heading_role(F.col("t")), t=title) == role
    for n, band in ((149_999_999, "<150M"), (150_000_000, "150M-1B"), (80_000_000_000, ">80B"), (None, "unknown")):
        assert one(spark, text.parameter_band(F.col("n").cast("long")), n=n) == band


def test_reasons_and_anchors(spark):
    assert one(spark, text.tidy_reason(F.col("t")), t=" .The record provides information about whales") == "Whales"
    assert one(spark, text.card_anchor(F.col("p"), F.col("v"), F.col("q")), p="https://h/m", v="", q="a b/c~") == "https://h/m/blob/main/README.md#:~:text=a%20b/c~"
    assert one(spark, text.strip_markup(F.col("t")), t="<b>a</b>&amp;lt;  b\n&quot;c&quot;") == 'a &lt; b "c"'
