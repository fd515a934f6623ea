"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, importance, line_dedup, pii, quality, secret_scan, sentencepiece_codec, sharding, simhash, token_counts, token_files, warc, whitening
from quarry.sources.tables import scratch

#: A key of the pseudonyms for tests; a deployment passes its own.
PII_KEY = "quarry-example-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_lines(docs).select("doc_id", "clean_text", "n_lines", "n_dropped")


OP1_SQL = f"""
WITH pages AS (
  SELECT source, count(*) AS n_pages FROM documents GROUP BY source
), lines AS (
  SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')))) AS line FROM documents
), over AS (
  SELECT l.source, l.line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  WHERE l.line <> '' GROUP BY l.source, l.line, p.n_pages
  HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > {line_dedup.RATIO} * p.n_pages
), per_host AS (
  SELECT source, list(line) AS drops FROM over GROUP BY source
), split AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS ls,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(h.drops, []), trim(x, ' '))) AS good
  FROM documents d LEFT JOIN per_host h ON d.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, array_to_string(good, chr(10)) AS clean_text, coalesce(len(ls), 0)::BIGINT AS n_lines,
       coalesce(len(ls) - len(good), 0)::BIGINT AS n_dropped
FROM split
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), with_text=False)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated("found").alias("contaminated"),
    )


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents), iw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
  sized AS (SELECT item_id, w, least({decontamination.WINDOW}, len(w)) AS k FROM iw WHERE len(w) > 0),
  win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
  ks AS (SELECT DISTINCT k FROM win),
  dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
  hit AS (SELECT doc_id, i, k, item_id FROM dwin JOIN win USING (k, s)),
  cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontamination.COVERAGE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model_file())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY).drop("text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoding_digests(table(spark, sf_dir, "documents"), model_file())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


NIBBLES = ", ".join(f"'{i:04b}'" for i in range(16))
OP8_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
  b AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(string_split(hex, ''), lambda c: [{NIBBLES}][instr('0123456789abcdef', c)]), '') AS bits, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CASE substr(bits, 5 * i + j + 1, 1) WHEN '1' THEN 2 ** (4 - j) ELSE 0 END))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_frame(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    of_base = F.filter("found", lambda s: s["kind"].isin(*base))

    def number(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in base], F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.col("text"), "UTF-8")
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), "source", "lang")
    placed = sharding.hilbert_shards(narrow, ["source", "lang", "size"], 16, ties=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Components of the whitening query.
COMPONENTS = 8


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    k = min(COMPONENTS, len(model.sums))
    share = F.array(*[F.lit(float(v)) for v in model.explained[:k]])
    rows = whitening.transform(vectors, model, components=COMPONENTS)
    each = rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        (F.get(share, "at") if k else F.lit(0.0)).alias("explained"),
        F.lit(whitening.identity_error(vectors, model, components=COMPONENTS)).alias("identity_error"),
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 of a word's UTF-8, byte by byte through the table of the reversed polynomial 0xEDB88320.
OP12_SQL = f"""
WITH crc AS (
  SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS steps FROM (SELECT unnest(range(0, 256)) AS v)
), dw AS (SELECT doc_id, {WORDS} AS w FROM documents), iw AS (SELECT {WORDS} AS w FROM benchmark),
  counted AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT unnest(w) AS word, 1 AS s, 0 AS t FROM dw UNION ALL SELECT unnest(w), 0, 1 FROM iw) GROUP BY word),
  hexed AS (SELECT word, s, t, hex(encode(word)) AS h FROM counted),
  hashed AS (
    SELECT word, s, t, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1),
      lambda c, b: xor(crc.steps[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295) % {importance.BUCKETS} AS bucket
    FROM hexed, crc
  ), sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket), totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
  gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + {importance.BUCKETS}))::DOUBLE / ((s + 1) * (t_all + {importance.BUCKETS}))::DOUBLE))::BIGINT AS gain FROM sums, totals),
  by_word AS (SELECT word, gain FROM hashed JOIN gains USING (bucket)),
  weights AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS word FROM dw) JOIN by_word USING (word) GROUP BY doc_id),
  scored AS (
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score
    FROM dw LEFT JOIN weights USING (doc_id)
  ), placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {importance.MIN_WORDS}),
  drawn AS (SELECT ({importance.PERCENT} * count(*)) // 100 AS k FROM placed)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id), drawn
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, str(public_tokenizers.path("byte_bpe_50k.json")))
    return token_files.read_tokens(spark, folder, with_ids=False).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_pii": op6_pii,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc": op8_warc,
    "op9_secret_scan": op9_secret_scan,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_whitening": op11_whitening,
    "op12_importance": op12_importance,
    "op13_token_files": op13_token_files,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op8_warc": OP8_SQL, "op12_importance": OP12_SQL}
