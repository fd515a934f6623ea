"""The pipeline against its stages on plain Python data."""

import hashlib
import re

import corpus_pipeline
import plain_versions
from quarry.llm import decontamination as dc
from quarry.llm import line_dedup, quality, simhash
from quarry.llm.queries import model_file, table


def test_pipeline(spark, tiny):
    import sentencepiece

    docs = {r.doc_id: (r.text, r.source) for r in table(spark, tiny, "documents").collect()}
    model = quality.fit(table(spark, tiny, "documents"), table(spark, tiny, "labels"))
    kept = {}
    for i, (text, source) in docs.items():
        counts, ids, at = quality.text_counts(text.encode())
        if not quality.base_failed(counts[0], counts[4]) and model.score(ids, at) >= model.threshold:
            kept[i] = (text, source)
    pages, seen = {}, {}
    for text, source in kept.values():
        pages[source] = pages.get(source, 0) + 1
        for line in {x.strip(" ") for x in text.split("\n")} - {""}:
            seen[source, line] = seen.get((source, line), 0) + 1
    over = {k for k, n in seen.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    clean = {i: "\n".join(x for x in text.split("\n") if (source, x.strip(" ")) not in over) for i, (text, source) in kept.items()}
    ids = sorted(clean)
    groups = plain_versions.naive_components([simhash.text_fingerprint(clean[i].encode()) for i in ids], ids)
    clean = {i: clean[i] for i, g in zip(ids, groups, strict=True) if i == g}
    items = [(str(r.item_id), dc.words_of(r.text.encode())) for r in table(spark, tiny, "benchmark").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file())
    want = {}
    for i, text in clean.items():
        words = dc.words_of(text.encode())
        hit, _ = plain_versions.naive_hits(words, items)
        if hit and 20 * len(hit) >= len(words):
            continue
        if hit:
            spans = dc.unite([(h, h + 1) for h in hit])
            text = dc.cut(text.encode(), spans).decode()
        ids_ = sp.encode(text)
        want[i] = (len(ids_), hashlib.sha256(",".join(map(str, ids_)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids_).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, tiny).collect()}
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, tiny):
    docs = table(spark, tiny, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tiny).columns == docs.columns


def test_no_word_is_cut_apart():
    data = "Été, the quick-brown fox. Fin".encode()
    begin, end = dc.word_offsets(data)
    assert [data[b:e].decode() for b, e in zip(begin, end, strict=True)] == re.findall(r"\w+", data.decode())
    assert dc.cut(data, [(1, 3)]) == "Été, -brown fox. Fin".encode()
