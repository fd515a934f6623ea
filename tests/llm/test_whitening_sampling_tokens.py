"""Whitening, importance resampling and token files: against brute force, the library, exact round trips, and on odd input."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import importance, token_files, whitening
from quarry.llm.queries import QUERIES, table

VECTORS = "vec_id long, embedding array<float>"


def tokenizer_file():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


# --- whitening


def brute_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, e[::-1], v[:, ::-1], c


def test_whitening_query_against_eigenvectors(spark, tiny):
    vectors = {r.vec_id: r.embedding for r in table(spark, tiny, "embeddings").collect()}
    ids = sorted(vectors)
    n, deviation, e, v, c = brute_whitening([vectors[i] for i in ids])
    got = {}
    for r in QUERIES["op11_whitening"](spark, tiny).collect():
        got[r.vec_id, r.component] = r
    assert len(got) == 8 * n
    for k in range(8):
        want = c @ v[:, k] / math.sqrt(e[k])
        mine = np.array([got[i, k + 1].whitened for i in ids])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert abs(got[ids[0], k + 1].explained / (e[k] / e.sum()) - 1) < 1e-9
    assert [got[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in got.values()} == {n} and 0 <= got[ids[0], 1].identity_error < 1e-9


def test_factors_of_many_tasks_merge_to_the_same_directions(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(900, 6)) * [9, 5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(a)], VECTORS)
    one, many = whitening.fit(df.coalesce(1)), whitening.fit(df.repartition(40))
    assert one.n == many.n == 900 and one.sums == many.sums
    assert np.allclose(one.singular, many.singular) and np.allclose(one.directions, many.directions)
    assert whitening.identity_error(df.repartition(40), many) < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [3.0, 5.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [-2.0, 0.5])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("Whitened", F.lit("clash")).withColumn("w_", F.lit("stays"))
    model = whitening.fit(df)
    got = whitening.transform(df, model).collect()
    assert model.n == 5 and len(got) == 5 and {r.vec_id for r in got} == {1, None, 8, 9} and {r["w_"] for r in got} == {"stays"}
    n, deviation, e, v, c = brute_whitening([r[1] for r in rows if r[0] in (1, None, 8, 9)])
    assert sorted(int(r.deviation) for r in got) == sorted(deviation)
    same = whitening.fit(df.filter("vec_id = 8"))
    assert not same.varied.any() and all(r.whitened == [0.0, 0.0] for r in whitening.transform(df, same).collect()) and whitening.identity_error(df, same) == 0.0
    none = whitening.fit(df.limit(0))
    assert none.n == 0 and whitening.transform(df, none).collect() == [] and whitening.identity_error(df, none) == 0.0


def test_deviations_beyond_longs_are_exact(spark):
    rows = [(i, [3.0e38 * (-1) ** i, 1.0e10 * i]) for i in range(5)]
    df = spark.createDataFrame(rows, VECTORS)
    model = whitening.fit(df)
    x = [[max(-(1 << 53), min(1 << 53, math.floor(1024 * np.float64(np.float32(c))))) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert model.sums == tuple(sums)
    want = {i: sum((5 * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for i, r in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in whitening.transform(df, model).collect()} == want


@pytest.mark.parametrize("case", ["odd", "empty"])
def test_whitening_query_on_odd_and_empty_tables(spark, tmp_path, case):
    rows = [(1, [1.0, 2.0], 0), (2, None, 0), (3, [0.0, 1.0], None)] if case == "odd" else []
    spark.createDataFrame(rows, VECTORS + ", label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_whitening"](spark, f"file://{tmp_path}")
    assert len(got.collect()) == (4 if case == "odd" else 0)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# --- importance resampling


def brute_resample(docs, target, percent=10, min_words=20, buckets=10_000, run=1):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(words) - k + 1)]

    s, t, of = [0] * buckets, [0] * buckets, []
    for doc_id, text in docs:
        n, got = features(text)
        of.append((doc_id, n, got))
        for b in got:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for doc_id, n, got in of:
        weight = math.floor(sum(gain[b] for b in got) / len(got)) if got else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n, len(got), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {r[0]: i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return {r[0]: (r[2], r[3], r[4], rank.get(r[0])) for r in rows}


def by_id(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"percent": 37, "min_words": 5}, {"run": 3, "buckets": 500, "percent": 50}, {"percent": 100, "min_words": 0}, {"percent": 0}])
def test_resampling_against_brute_force(spark, tiny, options):
    docs, items = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()], **options)
    assert by_id(importance.resample(docs, items, **options)) == want


def test_copies_count_as_often_as_they_are_there(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Alpha", "beta", "ÉTÉ", "x1"]) for _ in range(rng.randint(1, 40))) for _ in range(30)] + [None, "", "--- !!"]
    docs = [(i, texts[0] if i % 3 else rng.choice(texts)) for i in range(400)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(9).withColumn("rank", F.lit("clash")).withColumn("t", F.lit(1)), spark.createDataFrame([("alpha beta",), (None,)], "text string"), min_words=3)
    assert by_id(got) == brute_resample(docs, ["alpha beta", None], min_words=3)


def test_repeated_rows_and_null_ids_get_ranks_of_their_own(spark):
    text = "one two three " * 10
    docs = spark.createDataFrame([(1, text)] * 50 + [(None, text)] * 10 + [(2, text)] * 40, "doc_id long, text string")
    got = importance.resample(docs, docs.limit(0), percent=30).collect()
    assert len(got) == 100 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31))
    least = min(r.score for r in got if r["rank"])
    assert all(r["rank"] for r in got if r.score > least)


# --- token files


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 50_256), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), st.sampled_from([0.0, 0.5, 0.98, 1.0]))
def test_blocks_round_trip(ids, percentile):
    block = token_files.pack_blocks(np.array([ids], np.uint32), percentile)[0]
    assert token_files.unpack_block(b"junk" + block, 4).tolist() == ids


def test_outliers_are_exceptions_and_do_not_widen_a_block():
    ids = np.array([[1000 + i % 8 for i in range(4096)]], np.uint32)
    ids[0, [5, 4000]] = [50_000, 4_000_000_000]
    least, width, _, n, odd = token_files.BLOCK.unpack_from(token_files.pack_blocks(ids)[0])
    assert (least, width, n, odd) == (1000, 3, 4096, 2)


def test_any_run_of_ids_is_read_by_the_index(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 0, 700, 64, 5000, 1)]
    path = f"{tmp_path}/x.tokens"
    out = token_files.TokenWriter(pafs.LocalFileSystem().open_output_stream(path), block=64)
    for i, d in enumerate(docs):
        out.add(d, [None if i == 2 else i], np.array([len(d)]))
    out.close()
    with pafs.LocalFileSystem().open_input_file(path) as source:
        file = token_files.TokenFile(source)
        flat = np.concatenate(docs)
        for a, b in [(0, 0), (0, 1), (63, 65), (700, 5000), (5765, 9999), (0, 10_000)]:
            assert np.array_equal(file.read(a, b), flat[a:b])
        got = list(file.documents())
    assert [g[0] for g in got] == [0, 1, None, 3, 4, 5] and all(np.array_equal(g[2], d) for g, d in zip(got, docs, strict=True))
    data = bytearray(open(path, "rb").read())
    data[-40] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(pa.BufferReader(bytes(data)))


ODD_TEXTS = [
    "", " ", "  ", "\n", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a\n\n b", "a \t  b", "it's they'll", " 's", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b  <|endoftext|>", "x  y", "a\x1c b \x1cc", "　 z",
    "naïve façade", "日本 語 テキスト", "🙂 🙂🙂", "1 23 4,5 ...", "don't 12abc \r\n\r\nx", "q" * 5000, ("w" * 60 + " ") * 3, "\u0085 a", "é a",
]


def test_cut_texts_have_the_ids_of_whole_ones(spark, tiny):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(tokenizer_file()), token_files.TextEncoder(tokenizer_file(), 0)
    assert encoder.cuts
    rng = random.Random(7)
    mixed = ["".join(rng.choice([" ", "  ", "\n", "a", "Word", ".", "'s", "é", "\t", "12", "<|endoftext|>"]) for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    texts = ODD_TEXTS + mixed + [r.text for r in table(spark, tiny, "documents").limit(60).collect()]
    ids, lengths = encoder.encode_all([*texts, None])
    want = [[*e.ids, 0] for e in library.encode_batch(texts, add_special_tokens=False)] + [[0]]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


class Counted:
    """An object whose calls of methods are counted."""

    def __init__(self, inner, calls: list) -> None:
        self.inner, self.calls = inner, calls

    def __getattr__(self, name):
        got = getattr(self.inner, name)
        return (lambda *a, **k: (self.calls.append(name), got(*a, **k))[1]) if callable(got) else got


def test_new_words_of_a_batch_are_asked_of_the_library_at_once():
    encoder, calls, rng = token_files.TextEncoder(tokenizer_file(), 0), [], random.Random(4)
    for name in ("tokenizer", "model", "runs"):
        if hasattr(encoder, name) and not isinstance(getattr(encoder, name), dict):
            setattr(encoder, name, Counted(getattr(encoder, name), calls))
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(4, 12))) + rng.choice(["", ",", ".", "17", "\nX"]) for _ in range(3000)]
    ids, lengths = encoder.encode_all([" ".join(words[i : i + 100]) for i in range(0, 3000, 100)])
    assert len(lengths) == 30 and len(ids) == lengths.sum()
    assert len(calls) <= 2  # one for each word or run before


SPANS = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u3000", "a", "Bc", "é", "×", "÷", "ȿ", "ɐ", "ª", "ß", "7", "²", "٣", ".", "'", "'s", "…", "“", "日本", "あ", "🙂", "e\u0301", "\0", "\x7f", "<|endoftext|>", "<|endof", "text|>"])


@pytest.fixture(scope="module")
def library_and_encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file()), token_files.TextEncoder(tokenizer_file(), 0)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.one_of(SPANS, st.characters(exclude_categories=["Cs"])), max_size=25).map("".join), max_size=6))
def test_any_texts_have_the_ids_of_whole_ones(library_and_encoder, texts):
    library, encoder = library_and_encoder
    ids, lengths = encoder.encode_all(texts)
    want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_remembered_parts_keep_their_ids_however_few_are_remembered(monkeypatch, library_and_encoder):
    library, rng = library_and_encoder[0], random.Random(5)
    monkeypatch.setattr(token_files, "MEMO_PARTS", 30)
    monkeypatch.setattr(token_files, "MEMO_BYTES", 9)
    encoder = token_files.TextEncoder(tokenizer_file(), 9)
    words = ["".join(rng.choice("abé1.日'") for _ in range(rng.randint(1, 14))) for _ in range(90)]
    for _ in range(60):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 6))]
        ids, lengths = encoder.encode_all(pa.array(["cut off", *texts, None]).slice(1))
        want = [[*library.encode(t, add_special_tokens=False).ids, 9] for t in [*texts, ""]]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(encoder.memo.places) <= 30 + 100


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = str(public_tokenizers.path("word_bpe_49k.json"))
    encoder = token_files.TextEncoder(file, 5)
    assert not encoder.cuts
    assert encoder.encode_all(["Two  words", ""])[0].tolist() == [*Tokenizer.from_file(file).encode("Two  words", add_special_tokens=False).ids, 5, 5]


def test_token_query_against_the_library(spark, tiny):
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(tokenizer_file()), 0, {}
    for r in table(spark, tiny, "documents").orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op13_token_files"](spark, tiny).collect()}
    assert got == want


def test_token_files_of_odd_rows_in_many_files(spark, tmp_path):
    rows = [(i, ODD_TEXTS[i % len(ODD_TEXTS)]) for i in range(-40, 40)] + [(None, "no id"), (None, None), (7, "again"), (7, "again"), (2**62, "far"), (-(2**62), "x " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("tie", F.lit("clash"))
    manifest = token_files.write_tokens(df.repartition(5), f"file://{tmp_path}/t", tokenizer_file(), block=128, roll=500, shard_bytes=(20_000, 20_000))
    assert manifest.count() > 1
    got = sorted(token_files.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    want = sorted([(str(i), [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows])
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
