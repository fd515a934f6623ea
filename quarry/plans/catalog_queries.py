"""Registered queries of the catalog's operators: raw metadata, cards, claims, families, selection, predicates, evaluation.

Inputs are made from the driver's tables by SQL that both engines read (``shared``); what is expected of an operator is then
said in SQL by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import naming, predicates
from quarry.functions import text as X
from quarry.functions import values as V
from quarry.operators import cards, evaluation, evidence, families, records, reports, retrieval, selection
from quarry.plans.queries import AS_OF, query, table
from quarry.streaming import limits


def shared(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """A frame from SQL that names tables in braces."""
    import re

    return spark.sql(sql, **{t: table(spark, sf, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def duck(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


def joined(c: str | F.Column, sep: str = "|") -> F.Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


# --- raw metadata -------------------------------------------------------------------------------------

MODEL_ID = """'org' || CAST(p_partkey % 5 AS STRING) || '/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING) || CASE p_partkey % 4 WHEN 0 THEN '-7B' WHEN 1 THEN '-350m' ELSE '' END"""
MODELS = f"""SELECT p_partkey AS k, 'org' || CAST(p_partkey % 5 AS STRING) AS org,
  {MODEL_ID} AS id,
  replace(p_name, '-', ' ') || ' ' || CAST(p_partkey AS STRING) || CASE p_partkey % 4 WHEN 0 THEN ' 7B' WHEN 1 THEN ' 350m' ELSE '' END AS shown,
  CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 6 > 1 THEN 'Org ' || CAST(p_partkey % 5 AS STRING) END AS author,
  CASE WHEN p_partkey % 3 > 0 THEN 'v' || CAST(p_partkey AS STRING) END AS sha,
  CASE p_partkey % 4 WHEN 0 THEN 'text-generation' WHEN 1 THEN 'sentence-similarity' WHEN 3 THEN 'odd-task' END AS task,
  CASE WHEN p_partkey % 2 = 0 THEN 'transformers' END AS library,
  CASE WHEN p_partkey % 10 > 0 THEN p_partkey * 10 END AS downloads, CASE WHEN p_partkey % 4 > 0 THEN p_partkey * 0.5 END AS trending,
  CASE p_partkey % 5 WHEN 1 THEN 'false' WHEN 2 THEN 'auto' WHEN 3 THEN 'manual' WHEN 4 THEN '' END AS gated,
  CASE p_partkey % 3 WHEN 0 THEN 7000000000 WHEN 1 THEN 3000000000 END AS measured,
  CASE p_partkey % 4 WHEN 0 THEN 7000000000 WHEN 1 THEN 350000000 END AS named,
  CASE p_partkey % 5 WHEN 0 THEN 'apache-2.0' WHEN 1 THEN 'MIT ' WHEN 2 THEN 'odd' WHEN 4 THEN 'other' END AS licence,
  CASE WHEN p_partkey % 5 = 4 THEN 'https://l/x' END AS link,
  CASE p_partkey % 4 WHEN 0 THEN '["en","FR"]' WHEN 1 THEN 'de' WHEN 2 THEN '' END AS language,
  CASE p_partkey % 3 WHEN 0 THEN 'wiki' WHEN 1 THEN '["a","b"]' END AS datasets,
  CASE p_partkey % 4 WHEN 0 THEN 'up/Base' WHEN 1 THEN '["up/Two","up/Base"]' WHEN 3 THEN '' END AS card_base,
  CASE p_partkey % 3 WHEN 0 THEN 'up/Base' WHEN 1 THEN 'up/Api' END AS api_base
FROM {{part}}"""


def raw_models(spark, sf):
    m = shared(spark, sf, MODELS)
    k = F.col("k")
    tags = F.array_compact(F.array(F.when(k % 3 == 0, "conversational"), F.lit("license:mit"), F.concat(F.lit("arxiv:2401."), F.lpad(k.cast("string"), 5, "0")), F.lit("long-context"), F.when(k % 5 == 0, "onnx"), F.when(k % 7 == 0, "gguf")))
    no = F.lit(None).cast("long")
    return m.select(
        "id", "author", "sha", F.col("task").alias("pipeline_tag"), F.col("library").alias("library_name"), tags.alias("tags"), "downloads", no.alias("downloadsAllTime"), k.alias("likes"),
        F.col("trending").cast("double").alias("trendingScore"), F.lit("2024-01-01").alias("createdAt"), F.lit("2024-02-01").alias("lastModified"), "gated", F.when(k % 11 == 0, True).alias("private"), F.lit(None).cast("boolean").alias("disabled"),
        F.struct(F.col("measured").alias("total"), F.lit(None).cast("map<string,long>").alias("parameters")).alias("safetensors"),
        F.struct(
            F.when(k % 3 > 0, F.array(F.concat(F.lit("Arch"), (k % 3).cast("string")))).alias("architectures"), F.lit("arch").alias("model_type"), F.when(k % 4 == 0, 4096).cast("long").alias("max_position_embeddings"),
            F.when(k % 4 == 1, 2048).cast("long").alias("n_positions"), F.when(k % 4 == 2, 1024).cast("long").alias("max_sequence_length"), F.when(k % 8 == 0, 8).cast("long").alias("num_experts"), no.alias("num_local_experts"),
        ).alias("config"),
        F.struct(F.col("licence").alias("license"), F.col("link").alias("license_link"), "language", "datasets", F.col("card_base").alias("base_model")).alias("cardData"),
        F.struct(F.lit(None).cast("string").alias("relation"), F.when(F.col("api_base").isNotNull(), F.array(F.struct(F.col("api_base").alias("id")))).alias("models")).alias("baseModels"),
    )


CARD_BASES = "CASE k % 4 WHEN 0 THEN ['up/Base'] WHEN 1 THEN ['up/Two', 'up/Base'] ELSE []::VARCHAR[] END"
API_BASES = "CASE k % 3 WHEN 0 THEN ['up/Base'] WHEN 1 THEN ['up/Api'] ELSE []::VARCHAR[] END"


@query(f"""WITH m AS ({duck(MODELS)})
SELECT id AS repo_id, CASE WHEN k % 6 < 2 THEN org ELSE author END AS author, coalesce(sha, '') AS sha, coalesce(downloads, 0)::BIGINT AS downloads, coalesce(trending, 0)::DOUBLE AS trending_score, k % 11 = 0 AS private,
  CASE k % 4 WHEN 0 THEN 'en|FR' WHEN 1 THEN 'de' ELSE '' END AS languages, CASE k % 3 WHEN 0 THEN 'wiki' WHEN 1 THEN 'a|b' ELSE '' END AS datasets,
  array_to_string(list_sort(list_distinct(list_concat({CARD_BASES}, {API_BASES}))), '|') AS base_models,
  coalesce(measured, named)::BIGINT AS parameters, CASE WHEN measured IS NOT NULL THEN 'safetensors' WHEN named IS NOT NULL THEN 'inferred_from_name' ELSE 'none' END AS parameters_source FROM m""")
def record_candidates(spark, sf):
    """Discovery rows: authors, polymorphic lists, parents, parameters."""
    c = records.candidates(raw_models(spark, sf))
    return c.select("repo_id", "author", "sha", "downloads", "trending_score", "private", joined("languages").alias("languages"), joined("datasets").alias("datasets"), joined("base_models").alias("base_models"), F.col("parameters").cast("long").alias("parameters"), "parameters_source")


# --- cards --------------------------------------------------------------------------------------------

PROSE = "'This card of model ' || CAST(p_partkey AS STRING) || ' says at length what it is for and how well it does in tests of many kinds.'"
NL = "chr(10)"
CARD = f"""SELECT m.*, p.prose, p.raw, p.clean, p.first_part FROM ({MODELS}) m JOIN (SELECT p_partkey, {PROSE} AS prose,
  '---' || {NL} || 'license: mit' || {NL} || 'language:' || {NL} || '- en' || {NL} || '- no' || {NL} || '---' || {NL} || '# Title ' || CAST(p_partkey AS STRING) || {NL} || {NL} || '![b](https://img.shields.io/b)' || {NL} || {PROSE} || {NL} || {NL} || {NL}
    || 'a <b>bold</b> word<!-- gone -->' || {NL} || '| w.gguf | q4.gguf |' || {NL} || '## Limitations' || {NL} || {NL} || 'It may be wrong.' || CASE WHEN p_partkey % 3 = 0 THEN ' [More Information Needed]' ELSE '' END || {NL} AS raw,
  '# Title ' || CAST(p_partkey AS STRING) || {NL} || {NL} || {PROSE} || {NL} || {NL} || 'a bold word' || {NL} AS first_part,
  '# Title ' || CAST(p_partkey AS STRING) || {NL} || {NL} || {PROSE} || {NL} || {NL} || 'a bold word' || {NL} || '## Limitations' || {NL} || {NL} || 'It may be wrong.' || CASE WHEN p_partkey % 3 = 0 THEN ' [More Information Needed]' ELSE '' END || {NL} AS clean
FROM {{part}} WHERE p_partkey % 2 = 0) p ON m.k = p.p_partkey"""


def card_texts(spark, sf):
    return shared(spark, sf, CARD).select("k", F.col("id").alias("repo_id"), "raw")


def clean(spark, sf):
    return cards.clean_cards(card_texts(spark, sf))


@query(f"""WITH c AS ({duck(CARD)}) SELECT id AS repo_id, clean AS clean_text, sha256(raw) AS raw_sha256, sha256(clean) AS clean_sha256, 'mit' AS license, 'en,no' AS language, '' AS front_matter_error,
  1 AS badges, 1 AS inventories, 0 AS citations, (k % 3 = 0)::INT AS placeholders, length(raw)::INT AS raw_chars,
  round_even(0.25 * least(1, length(clean) / 4000) + 0.1 + 0.05 + 0.05, 4) AS quality, length(clean) >= 240 AND (k % 3 = 0)::INT <= 5 AS usable FROM c""")
def card_cleaning(spark, sf):
    """Front matter, badges, comments, markup, file inventories, blank runs, placeholders and quality."""
    c = clean(spark, sf)
    return c.select(
        "repo_id", "clean_text", "raw_sha256", "clean_sha256", F.col("front_matter")["license"].alias("license"), F.replace(F.col("front_matter")["language"], F.lit("\n"), F.lit(",")).alias("language"), "front_matter_error",
        F.col("dropped")["badge"].alias("badges"), F.col("dropped")["inventory"].alias("inventories"), F.col("dropped")["citation"].alias("citations"), "placeholders", "raw_chars", "quality", X.usable_card(F.col("clean_text")).alias("usable"),
    )


@query(f"""WITH c AS ({duck(CARD)}), s AS (SELECT id, 0 AS place, 1 AS level, 'Title ' || k AS heading, 'other' AS role, 'Title ' || k AS path, 0 AS clean_start, length(first_part)::INT AS clean_end FROM c
  UNION ALL SELECT id, 1, 2, 'Limitations', 'limitations', 'Title ' || k || ' > Limitations', length(first_part)::INT, length(clean)::INT FROM c)
SELECT id AS repo_id, place, level, heading, role, path, clean_start, clean_end FROM s""")
def card_sections(spark, sf):
    """Sections with their paths, roles and offsets."""
    return clean(spark, sf).select("repo_id", F.posexplode("sections").alias("place", "s")).select("repo_id", "place", "s.level", "s.heading", "s.role", joined(F.col("s.path"), " > ").alias("path"), "s.clean_start", "s.clean_end")


@query(f"WITH c AS ({duck(CARD)}) SELECT id AS repo_id, rtrim(substr(clean, length(first_part) + 1), chr(10)) AS short, clean AS whole FROM c")
def card_packing(spark, sf):
    """Sections by value within a budget."""
    c = clean(spark, sf)
    pack = lambda n: cards.pack_sections(F.col("clean_text"), F.col("sections"), n)
    return c.select("repo_id", pack(70).alias("short"), pack(5000).alias("whole"))


HAS = "k % 2 = 0"
TAGS = "list_concat(CASE WHEN k % 3 = 0 THEN ['conversational'] ELSE []::VARCHAR[] END, ['long-context'], CASE WHEN k % 5 = 0 THEN ['onnx'] ELSE []::VARCHAR[] END, CASE WHEN k % 7 = 0 THEN ['gguf'] ELSE []::VARCHAR[] END)"
FACTS_SQL = f"""m AS ({duck(MODELS)}), c AS (SELECT k AS ck, prose, clean FROM ({duck(CARD)})), f AS (SELECT m.*, prose, clean, CASE WHEN {HAS} THEN 'mit' ELSE licence END AS said FROM m LEFT JOIN c ON k = ck), facts AS (
  SELECT k, id AS repo_id, 'https://huggingface.co/' || id AS url, shown AS name, CASE WHEN k % 6 < 2 THEN org ELSE author END AS creator, coalesce(sha, '') AS revision,
  CASE WHEN {HAS} THEN prose ELSE shown || ' is a ' || replace(coalesce(task, 'model'), '-', ' ') || ' repository published on the Hugging Face Hub.' END AS description, CASE WHEN {HAS} THEN 'model_card_prose' ELSE 'metadata_only' END AS description_source,
  CASE lower(trim(said)) WHEN 'mit' THEN 'https://opensource.org/license/mit' WHEN 'apache-2.0' THEN 'https://www.apache.org/licenses/LICENSE-2.0' WHEN 'other' THEN link ELSE said END AS license,
  CASE WHEN lower(trim(said)) IN ('mit', 'apache-2.0') THEN 'recognized_identifier' WHEN link IS NOT NULL THEN 'declared_link' WHEN said IS NOT NULL THEN 'declared_text' ELSE 'unknown' END AS license_status,
  CASE WHEN {HAS} THEN 'en|no' ELSE CASE k % 4 WHEN 1 THEN 'de' ELSE '' END END AS in_language, task, array_to_string(list_distinct(list_concat(
    CASE task WHEN 'text-generation' THEN ['Text Generation'] WHEN 'sentence-similarity' THEN ['Sentence Embedding'] ELSE []::VARCHAR[] END, [])), '|') AS one_category,
  CASE task WHEN 'text-generation' THEN 'Text Generation' WHEN 'sentence-similarity' THEN 'Sentence Embedding|Semantic Similarity' ELSE '' END || CASE WHEN k % 3 = 0 THEN CASE WHEN k % 4 < 2 THEN '|' ELSE '' END || 'Conversational AI' ELSE '' END AS category,
  array_to_string(list_transform(CASE WHEN task IS NULL THEN {TAGS} ELSE list_prepend(task, {TAGS}) END, lambda t: replace(t, '-', ' ')), '|') AS keywords,
  array_to_string(list_concat(CASE WHEN measured IS NOT NULL THEN ['safetensors'] ELSE []::VARCHAR[] END, CASE WHEN k % 5 = 0 THEN ['onnx'] ELSE []::VARCHAR[] END, CASE WHEN k % 7 = 0 THEN ['gguf'] ELSE []::VARCHAR[] END), '|') AS format,
  coalesce(measured, named)::BIGINT AS parameters, CASE WHEN measured IS NOT NULL THEN 'safetensors' WHEN named IS NOT NULL THEN 'repository_name' ELSE 'none' END AS parameter_source,
  array_to_string(list_concat(CASE WHEN {HAS} AND licence IS NOT NULL AND lower(licence) <> 'mit' THEN ['license'] ELSE []::VARCHAR[] END, CASE WHEN measured <> named THEN ['parameter_count'] ELSE []::VARCHAR[] END), '|') AS conflicts,
  CASE WHEN k % 3 > 0 THEN 'Arch' || (k % 3) END AS architecture, CASE k % 4 WHEN 0 THEN 4096 WHEN 1 THEN 2048 WHEN 2 THEN 1024 END::BIGINT AS context_length, k % 8 = 0 AS mixture_of_experts, coalesce(downloads, 0)::BIGINT AS downloads,
  CASE k % 5 WHEN 2 THEN 'auto' WHEN 3 THEN 'manual' ELSE 'open' END AS gated, library,
  array_to_string(CASE k % 12 WHEN 0 THEN ['up/Base'] WHEN 1 THEN ['up/Api', 'up/Two', 'up/Base'] WHEN 2 THEN []::VARCHAR[] WHEN 3 THEN ['up/Base'] WHEN 4 THEN ['up/Api', 'up/Base'] WHEN 5 THEN ['up/Two', 'up/Base']
    WHEN 6 THEN ['up/Base'] WHEN 7 THEN ['up/Api'] WHEN 8 THEN ['up/Base'] WHEN 9 THEN ['up/Base', 'up/Two'] WHEN 10 THEN ['up/Api'] ELSE []::VARCHAR[] END, '|') AS base_models,
  CASE k % 3 WHEN 0 THEN 'wiki' WHEN 1 THEN 'a|b' ELSE '' END AS datasets, '2401.' || lpad(k::VARCHAR, 5, '0') AS arxiv_ids, CASE WHEN {HAS} THEN 'ok' ELSE 'missing_readme' END AS card_status, coalesce(sha256(clean), '') AS card_sha FROM f)"""
FACT_COLUMNS = ("repo_id", "url", "name", "revision", "description", "description_source", "license", "license_status", "task", "parameters", "parameter_source", "architecture", "context_length", "mixture_of_experts", "downloads", "gated", "card_status", "card_sha")
FACT_LISTS = ("in_language", "category", "keywords", "format", "conflicts", "base_models", "datasets", "arxiv_ids")


def facts(spark, sf):
    return records.normalise(raw_models(spark, sf), clean(spark, sf).withColumn("card_status", F.lit("ok")))


@query(f"WITH {FACTS_SQL} SELECT {', '.join(FACT_COLUMNS)}, creator, {', '.join(FACT_LISTS)} FROM facts")
def record_facts(spark, sf):
    """Normalised facts: description, licence, languages, keywords, formats, parents, conflicts."""
    return facts(spark, sf).select(*FACT_COLUMNS[:9], F.col("parameters").cast("long").alias("parameters"), *FACT_COLUMNS[10:], F.col("creator.name").alias("creator"), *[joined(c).alias(c) for c in FACT_LISTS])


# --- claims -------------------------------------------------------------------------------------------

CLAIMS = f"""SELECT k, id AS repo_id, clean, first_part, prose, CASE WHEN k % 4 = 0 THEN 'subject_area' ELSE 'capability' END AS kind, CASE k % 3 WHEN 0 THEN ' Medical ' WHEN 1 THEN 'Whales' ELSE 'Law' END AS label,
  CASE k % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'high' END AS confidence, CASE k % 7 WHEN 0 THEN 'trained_on' WHEN 1 THEN 'evaluated_on' WHEN 2 THEN 'merely_mentioned' WHEN 3 THEN 'intended_for' WHEN 4 THEN 'architecture' WHEN 5 THEN 'fine_tuned_on' END AS evidence_type,
  CASE k % 10 WHEN 0 THEN 'It may be wrong.' WHEN 2 THEN ' it  MAY be *wrong*' WHEN 4 THEN 'nowhere to be found in it' WHEN 6 THEN substr(prose, 1, 30) WHEN 8 THEN 'wrong.' END AS evidence_quote FROM ({CARD})"""
CHECKED_SQL = f"""q AS ({duck(CLAIMS)}), a AS (SELECT *, coalesce(evidence_type, 'merely_mentioned') AS et, coalesce(confidence, 'low') AS stated, k % 10 IN (0, 2, 6) AS there FROM q),
  b AS (SELECT *, CASE WHEN et IN ('evaluated_on', 'intended_for') THEN 'medium' WHEN et = 'merely_mentioned' THEN 'low' ELSE 'high' END AS cap,
    CASE WHEN k % 10 = 6 THEN strpos(clean, prose) - 1 ELSE strpos(clean, 'It may be wrong') - 1 END AS s FROM a),
  d AS (SELECT *, CASE stated WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END > CASE cap WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS lowered, s + CASE k % 10 WHEN 0 THEN 16 WHEN 2 THEN 15 ELSE length(rtrim(substr(prose, 1, 30))) END AS e FROM b),
  checked AS (SELECT k, repo_id, kind, trim(label) AS label, CASE WHEN lowered THEN cap ELSE stated END AS confidence, et AS evidence_type, CASE WHEN there THEN substr(clean, s::INT + 1, (e - s)::INT) END AS evidence_quote,
    CASE WHEN there THEN CASE WHEN k % 10 = 6 THEN 'Title ' || k ELSE 'Title ' || k || ' > Limitations' END END AS source_section, CASE WHEN there THEN s END::INT AS start_at, CASE WHEN there THEN e END::INT AS end_at,
    CASE WHEN kind = 'subject_area' AND k % 3 = 0 THEN 'biomedicine' END AS taxonomy_term, CASE WHEN kind = 'subject_area' THEN CASE WHEN k % 3 = 0 THEN 'mapped' ELSE 'proposed' END END AS taxonomy_status,
    CASE WHEN NOT there THEN 'quote_not_found_in_source' WHEN kind = 'subject_area' AND et = 'merely_mentioned' THEN 'evidence_type_merely_mentioned_does_not_establish_specialty' END AS dropped,
    CASE WHEN there AND NOT (kind = 'subject_area' AND et = 'merely_mentioned') AND lowered THEN kind || ':' || label || ' confidence lowered ' || stated || '->' || cap || ' by evidence type ' || et END AS warning FROM d)"""


def checked(spark, sf):
    claims = shared(spark, sf, CLAIMS).select("repo_id", "kind", "label", "confidence", "evidence_type", "evidence_quote")
    return evidence.check_claims(claims, clean(spark, sf), {"medical": "biomedicine"})


@query(f"WITH {CHECKED_SQL} SELECT repo_id, kind, label, confidence, evidence_type, evidence_quote, source_section, start_at, end_at, taxonomy_term, taxonomy_status, dropped, warning FROM checked")
def claims_checked(spark, sf):
    """Claims against their cards: offsets, sections, ceilings, taxonomy, reasons."""
    c = checked(spark, sf)
    return c.select("repo_id", "kind", "label", "confidence", "evidence_type", "evidence_quote", "source_section", F.col("clean_offsets")[0].alias("start_at"), F.col("clean_offsets")[1].alias("end_at"), "taxonomy_term", "taxonomy_status", "dropped", "warning")


@query(f"WITH {CHECKED_SQL} SELECT dropped AS reason, count(*) AS n FROM checked WHERE dropped IS NOT NULL GROUP BY 1")
def dropped_claim_reasons(spark, sf):
    return reports.dropped_reasons(checked(spark, sf), "dropped")


@query(f"""WITH q AS ({duck(CLAIMS)}) SELECT repo_id, 'evidence quote not found in source: ' || left(evidence_quote, 80) AS error FROM q WHERE k % 6 > 0 AND k % 10 IN (4, 8)
UNION ALL SELECT repo_id, '1 evidence quotes but no cleaned card to verify them' FROM q WHERE k % 6 = 0""")
def evidence_errors(spark, sf):
    """Published quotes against cards; cards of every third record are missing."""
    q = shared(spark, sf, CLAIMS).select("k", "repo_id", F.col("evidence_quote").alias("quote"))
    there = clean(spark, sf).join(q.filter("k % 6 > 0").select("repo_id"), "repo_id", "left_semi")
    return evidence.verify_items(q.select("repo_id", "quote"), there)


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'de' ELSE '' END || CASE WHEN contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'the') THEN CASE WHEN lang IN ('en', 'de') THEN '|The' ELSE 'The' END ELSE '' END AS languages,
  CASE WHEN lang = 'en' THEN 'de' WHEN lang = 'de' THEN 'English' ELSE 'English|de' END || CASE WHEN contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'the') THEN '' ELSE '|The' END AS dropped_languages
FROM documents WHERE NOT contains(lower(text), 'english') AND NOT regexp_matches(lower(text), 'de')""")
def claimed_languages(spark, sf):
    """Languages that a card's front matter or text bears out, of texts that name none."""
    d = table(spark, sf, "documents").filter(~F.contains(F.lower("text"), F.lit("english")) & ~F.contains(F.lower("text"), F.lit("de")))
    claimed = d.select("doc_id", F.array(F.lit("English"), F.lit("de"), F.lit(" The "), F.lit("")).alias("claimed_languages"), F.array("lang").alias("in_language"), F.col("text").alias("clean_text"))
    got = evidence.check_languages(claimed)
    return got.select("doc_id", joined("languages").alias("languages"), joined("dropped_languages").alias("dropped_languages"))


# --- published items ----------------------------------------------------------------------------------

ENRICHED = """SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'Short ' || CAST(p_partkey AS STRING) ELSE '' END AS short FROM {part} WHERE p_partkey % 2 = 0"""


def enrichment(spark, sf):
    k, none = F.col("k"), F.array().cast("array<string>")
    e = shared(spark, sf, f"SELECT e.k, e.short, m.id AS repo_id FROM ({ENRICHED}) e JOIN ({MODELS}) m ON e.k = m.k")
    return e.select("repo_id", F.col("short").alias("short_description"), F.when(k % 3 == 0, F.array(F.lit("chat"))).otherwise(none).alias("intended_uses"), F.when(k % 5 == 0, F.array(F.lit("slow"), F.lit("big"))).otherwise(none).alias("limitations"), none.alias("deployment_notes"), F.array(F.lit("Norwegian"), F.lit("Python"), F.lit(" welsh ")).alias("languages"))


def assigned(spark, sf):
    k = F.col("k")
    relation = F.when(k % 3 == 0, "canonical").when(k % 4 == 3, "mirror_of").otherwise("derived_from")
    return shared(spark, sf, MODELS).select(F.col("id").alias("repo_id"), F.concat(F.lit("org--fam-"), (F.floor(k / 7)).cast("string")).alias("family_id"), relation.alias("relation"), F.when(k % 4 == 3, "variant").otherwise("primary").alias("discovery_scope"), F.when(k % 5 > 0, F.lit("org0/main")).otherwise("").alias("canonical_repo_id"))


#: Five digits don't tell more than 100,000 papers apart, so what was fetched is told by record too.
ABSTRACTS = f"""SELECT {MODEL_ID} AS repo_id, '2401.' || lpad(CAST(p_partkey AS STRING), 5, '0') AS arxiv_id, 'Paper ' || CAST(p_partkey AS STRING) AS title, 'About ' || p_name AS abstract FROM {{part}} WHERE p_partkey % 2 = 0"""


def abstracts(spark, sf):
    return shared(spark, sf, ABSTRACTS)


def items(spark, sf):
    return records.emit(facts(spark, sf), checked(spark, sf), enrichment(spark, sf), assigned(spark, sf), abstracts(spark, sf))


HUB_ = "'https://huggingface.co/'"
ITEMS_SQL = f"""{FACTS_SQL}, {CHECKED_SQL}, kept AS (SELECT k AS kk, kind AS ckind, CASE WHEN kind = 'subject_area' THEN coalesce(taxonomy_term, lower(label)) ELSE label END AS term, evidence_type AS et, evidence_quote AS quote FROM checked WHERE dropped IS NULL),
  fam AS (SELECT k // 7 AS f, list(id ORDER BY id) AS vs FROM m WHERE k % 4 = 3 GROUP BY 1),
  items AS (SELECT k, repo_id, url AS id, name, creator, nullif(revision, '') AS revision, CASE WHEN k % 4 = 0 THEN 'Short ' || k ELSE description END AS description,
    CASE WHEN k % 2 = 0 THEN 'en|no|welsh' WHEN k % 4 = 1 THEN 'de' END AS languages, keywords, nullif(category, '') AS category, CASE WHEN ckind = 'subject_area' THEN term END AS subject, CASE WHEN ckind = 'capability' THEN term END AS capability,
    CASE WHEN k % 6 = 0 THEN 'chat' END AS intended_use, CASE WHEN k % 10 = 0 THEN 'slow|big' END AS limitation, 'org--fam-' || (k // 7) AS family,
    CASE WHEN k % 3 = 0 THEN 'canonical' WHEN k % 4 = 3 THEN 'mirror_of' ELSE 'derived_from' END AS family_relation, CASE WHEN k % 4 = 3 THEN 'variant' ELSE 'primary' END AS discovery_scope,
    CASE WHEN k % 5 > 0 AND k % 3 > 0 THEN {HUB_} || 'org0/main' END AS canonical,
    nullif(array_to_string(list_transform(list_filter(coalesce(vs, []), lambda v: v <> repo_id), lambda v: {HUB_} || v), '|'), '') AS variant,
    CASE WHEN base_models <> '' THEN {HUB_} || replace(base_models, '|', '|' || {HUB_}) END AS base_model, CASE WHEN datasets <> '' THEN {HUB_} || 'datasets/' || replace(datasets, '|', '|' || {HUB_} || 'datasets/') END AS trained_on_dataset,
    CASE WHEN k % 2 = 0 THEN url || '/blob/' || coalesce(nullif(revision, ''), 'main') || '/README.md' END AS model_card,
    CASE WHEN et = 'trained_on' THEN quote END AS trained_on, CASE WHEN et = 'fine_tuned_on' THEN quote END AS fine_tuned_on, CASE WHEN et = 'evaluated_on' THEN quote END AS evaluated_on, CASE WHEN et = 'intended_for' THEN quote END AS intended_for, CASE WHEN et = 'architecture' THEN quote END AS architecture_for,
    nullif(format, '') AS format, task, library, architecture, parameters, context_length, mixture_of_experts, downloads, gated, license, license_status,
    'https://arxiv.org/abs/' || arxiv_ids || CASE WHEN k % 2 = 0 THEN '|Paper ' || k ELSE '|' END AS citation FROM facts LEFT JOIN kept ON k = kk LEFT JOIN fam ON k // 7 = f)"""
ITEM_COLUMNS = ("repo_id", "id", "name", "revision", "description", "family", "family_relation", "discovery_scope", "canonical", "model_card", "task", "library", "architecture", "parameters", "context_length", "mixture_of_experts", "downloads", "gated", "license", "license_status")
ITEM_LISTS = ("languages", "keywords", "category", "subject", "capability", "intended_use", "limitation", "variant", "base_model", "trained_on_dataset", "format", *V.EVIDENCE_COLUMNS.values())


@query(f"WITH {ITEMS_SQL} SELECT {', '.join((*ITEM_COLUMNS, *ITEM_LISTS))}, creator, citation FROM items")
def emitted_items(spark, sf):
    """Published items: languages, subjects, capabilities, quotes by relation, family, variants minus itself, addresses, citations."""
    i = items(spark, sf)
    cited = F.concat(F.col("citation")[0]["url"], F.lit("|"), F.coalesce(F.col("citation")[0]["name"], F.lit("")))
    return i.select(*[F.col(c).cast("long").alias(c) if c == "parameters" else F.col(c) for c in ITEM_COLUMNS], *[joined(c).alias(c) for c in ITEM_LISTS], F.col("creator.name").alias("creator"), cited.alias("citation"))


@query(f"""WITH {ITEMS_SQL} SELECT repo_id, '' AS errors, 'https://schema.org/' AS vocab, 'SoftwareApplication' AS first_type, id, name, description, creator, parameters, subject, canonical, base_model, trained_on,
  21 + (revision IS NOT NULL)::INT + (languages IS NOT NULL)::INT + (category IS NOT NULL)::INT + (subject IS NOT NULL)::INT + (capability IS NOT NULL)::INT + (intended_use IS NOT NULL)::INT + (limitation IS NOT NULL)::INT
  + (canonical IS NOT NULL)::INT + (variant IS NOT NULL)::INT + (base_model IS NOT NULL)::INT + (trained_on_dataset IS NOT NULL)::INT + (model_card IS NOT NULL)::INT + (trained_on IS NOT NULL)::INT + (fine_tuned_on IS NOT NULL)::INT
  + (evaluated_on IS NOT NULL)::INT + (intended_for IS NOT NULL)::INT + (architecture_for IS NOT NULL)::INT + (format IS NOT NULL)::INT + (task IS NOT NULL)::INT + (library IS NOT NULL)::INT + (architecture IS NOT NULL)::INT
  + (parameters IS NOT NULL)::INT + (context_length IS NOT NULL)::INT + (license IS NOT NULL)::INT + (CASE WHEN k % 2 = 0 THEN 'mit' WHEN k % 5 <> 3 THEN 'x' END IS NOT NULL)::INT AS members FROM items WHERE revision IS NOT NULL
UNION ALL SELECT repo_id, 'hf:revision is required for provenance', 'https://schema.org/', 'SoftwareApplication', id, name, description, creator, parameters, subject, canonical, base_model, trained_on, NULL FROM items WHERE revision IS NULL""")
def json_ld_records(spark, sf):
    """Published records as JSON, validated, and read back member by member."""
    published = items(spark, sf)
    i = records.validate_json(published.select("repo_id", records.json_ld(published).alias("body"))).withColumn("parsed", F.parse_json("body"))
    v = F.col("parsed")
    got = lambda k, kind="string": F.try_variant_get(v, f"$['{k}']", kind)
    many = lambda k: joined(got(k, "array<string>"))
    return i.select(
        "repo_id", joined("errors").alias("errors"), F.try_variant_get(v, "$['@context']['@vocab']", "string").alias("vocab"), F.try_variant_get(v, "$['@type'][0]", "string").alias("first_type"), got("@id").alias("id"), got("name").alias("name"), got("description").alias("description"),
        F.try_variant_get(v, "$.creator.name", "string").alias("creator"), got("hf:parameters", "long").alias("parameters"), many("hf:subject").alias("subject"), got("hf:canonical").alias("canonical"), many("hf:baseModel").alias("base_model"), many("hf:trainedOn").alias("trained_on"),
        F.when(F.size("errors") == 0, F.size(F.json_object_keys("body"))).alias("members"),
    )


SIZE_SQL = "CASE parameters WHEN 7000000000 THEN '7B parameters mid-sized single GPU local laptop on-device' WHEN 3000000000 THEN '3B parameters mid-sized single GPU local laptop on-device' WHEN 350000000 THEN '350M parameters small tiny lightweight local laptop on-device' END"


@query(f"""WITH {ITEMS_SQL} SELECT id, concat_ws(' ', name, repo_id, creator) AS name, concat_ws(' ', description, replace(category, '|', ' '), capability, 'task ' || task) AS description,
  concat_ws(' ', replace(subject, '-', ' '), replace(keywords, '|', ' '), replace(languages, '|', ' '), intended_use, replace(limitation, '|', ' '), 'trained on ' || trained_on, 'fine-tuned on ' || fine_tuned_on, 'evaluated on ' || evaluated_on, 'intended for ' || intended_for,
    'architecture for ' || architecture_for, 'library ' || library, 'architecture ' || architecture, {SIZE_SQL}) AS body FROM items""")
def retrieval_texts(spark, sf):
    """The text that search weighs, by field."""
    return records.retrieval_fields(items(spark, sf))


@query(f"""WITH {ITEMS_SQL} SELECT repo_id, '{{"name":"' || left(name, 20) || '","description":"' || left(description, 20) || '","keywords":["' || array_to_string(string_split(keywords, '|')[1:2], '","') || '"]' || CASE WHEN task IS NOT NULL THEN ',"task":"' || task || '"' ELSE '' END || '}}' AS digest FROM items""")
def ranking_digests(spark, sf):
    """Allowed members in JSON, lists and strings cut."""
    i = items(spark, sf)
    return i.select("repo_id", records.ranking_projection(i, ["name", "description", "keywords", "task", "absent"], 2, 20).alias("digest"))


@query(f"""WITH {FACTS_SQL}, d AS (SELECT *, '{{"repo_id":"' || repo_id || '"' || CASE WHEN task IS NOT NULL THEN ',"task":"' || task || '"' ELSE '' END || CASE WHEN library IS NOT NULL THEN ',"library":"' || library || '"' ELSE '' END || ',"license_status":"' || license_status || '"'
    || ',"in_language":[' || CASE WHEN in_language = '' THEN '' ELSE '"' || replace(in_language, '|', '","') || '"' END || ']' || CASE WHEN parameters IS NOT NULL THEN ',"parameters":' || parameters ELSE '' END || CASE WHEN architecture IS NOT NULL THEN ',"architecture":"' || architecture || '"' ELSE '' END
    || ',"base_models":[' || CASE WHEN base_models = '' THEN '' ELSE '"' || replace(base_models, '|', '","') || '"' END || '],"datasets":[' || CASE WHEN datasets = '' THEN '' ELSE '"' || replace(datasets, '|', '","') || '"' END || ']}}' AS digest FROM facts)
SELECT repo_id, digest, 'v1-' || left(sha256('a' || chr(10) || 'b'), 8) AS prompt, sha256('m' || chr(0) || 'v1-' || left(sha256('a' || chr(10) || 'b'), 8) || chr(0) || card_sha || chr(0) || digest) AS enrichment_key FROM d""")
def enrichment_keys(spark, sf):
    """What an enrichment gets, and its content address."""
    f = facts(spark, sf)
    digest, prompt = records.metadata_digest(f), records.prompt_version("v1", ["a", "b"])
    return f.select("repo_id", F.to_json(digest).alias("digest"), prompt.alias("prompt"), records.enrichment_key(F.lit("m"), prompt, F.col("card_sha"), digest).alias("enrichment_key"))


@query(f"WITH {FACTS_SQL} SELECT repo_id, 'https://arxiv.org/abs/' || arxiv_ids AS url, CASE WHEN k % 2 = 0 THEN 'Paper ' || k END AS title FROM facts")
def citations(spark, sf):
    """Citations with what was fetched of their papers."""
    return records.cite(facts(spark, sf), abstracts(spark, sf)).select("repo_id", F.col("citations")[0]["url"].alias("url"), F.col("citations")[0]["name"].alias("title"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2401.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') WHEN 1 THEN 'cs.LG/0102003' ELSE '' END AS ids FROM part")
def arxiv_ids_of_urls(spark, sf):
    p = shared(spark, sf, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' https://arXiv.org/abs/2401.' || lpad(CAST(p_partkey % 100000 AS STRING), 5, '0') || 'v3' WHEN 1 THEN 'http://arxiv.org/abs/cs.LG/0102003' WHEN 2 THEN 'https://arxiv.org/pdf/2401.00001' ELSE 'https://arxiv.org/abs/nonsense' END AS url FROM {part}")
    return p.select("p_partkey", joined(records.arxiv_ids(F.array("url", "url"))).alias("ids"))


@query("SELECT o_custkey, sum(l_linenumber)::INT AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def evaluation_counts(spark, sf):
    """Metrics in nested results."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    result = F.struct(F.array_repeat(F.lit("m"), F.col("l_linenumber")).alias("metrics"))
    per_order = li.groupBy("o_custkey", "o_orderkey").agg(F.collect_list(result).alias("results"))
    nested = per_order.groupBy("o_custkey").agg(F.collect_list(F.struct("results")).alias("entries"))
    return nested.select("o_custkey", records.evaluation_count(F.col("entries")).alias("n"))


BAD = """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'SoftwareApplication' ELSE 'Thing' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'https://' ELSE 'ftp://' END AS scheme, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS name FROM {part}"""


@query(f"""WITH b AS ({duck(BAD)}) SELECT k, array_to_string(list_concat(CASE WHEN kind = 'Thing' THEN ['@type must be [SoftwareApplication, hf:Model]'] ELSE []::VARCHAR[] END, CASE WHEN scheme = 'ftp://' THEN ['@id must be an absolute https URL'] ELSE []::VARCHAR[] END,
  CASE WHEN name = '' THEN ['name is required'] ELSE []::VARCHAR[] END, ['hf:revision is required for provenance', 'inLanguage holds YAML-coerced booleans: No'], CASE WHEN k % 7 = 0 THEN ['unexpected top-level keys: score', 'internal fields leaked into the published item: score'] ELSE []::VARCHAR[] END,
  ['creator must be an Organization or Person', 'hf:subject must be a list', 'hf:limitation must hold strings'], CASE WHEN scheme = 'ftp://' THEN ['hf:baseModel must hold absolute https URLs'] ELSE []::VARCHAR[] END), '|') AS errors FROM b""".replace(": No'", ": false'"))
def record_errors(spark, sf):
    """What is wrong with records, in the order of checks."""
    b = shared(spark, sf, BAD)
    body = F.concat(
        F.lit('{"@context":{"@vocab":"https://schema.org/","hf":"x"},"@type":["'), "kind", F.lit('","hf:Model"],"@id":"'), "scheme", F.lit('a/b","url":"u","description":"d","dateModified":"2024","hf:repository":"r","creator":{"@type":"Robot","name":"n"},"inLanguage":["en","false"],"hf:subject":"a","hf:limitation":[1],"hf:baseModel":["'),
        "scheme", F.lit('c"],"name":"'), "name", F.lit('"'), F.when(F.col("k") % 7 == 0, ',"score":1').otherwise(""), F.lit("}"),
    )
    return records.validate_json(b.withColumn("body", body)).select("k", joined("errors").alias("errors"))


# --- families -----------------------------------------------------------------------------------------


def member_id(k: str) -> str:
    """The name of record number ``k``, in SQL."""
    return f"'own' || CAST(({k}) % 3 AS STRING) || '/M' || CAST({k} AS STRING) || CASE ({k}) % 7 WHEN 1 THEN '-GGUF' WHEN 2 THEN '-mirror' ELSE '' END"


MEMBERS = f"""SELECT p_partkey AS k, {member_id('p_partkey')} AS repo_id, CASE WHEN p_partkey >= 8 THEN {member_id('CAST(floor(p_partkey / 8) AS BIGINT)')} END AS base,
  CASE WHEN p_partkey % 10 = 9 THEN NULL WHEN p_partkey % 10 = 1 THEN 'sha' || CAST(p_partkey - 1 AS STRING) ELSE 'sha' || CAST(p_partkey AS STRING) END AS card_sha, CASE WHEN p_partkey % 4 > 0 THEN 'arch' END AS architecture,
  p_partkey * 37 % 100 AS downloads, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '20' || CAST(10 + p_partkey % 5 AS STRING) END AS created FROM {{part}}"""


def members(spark, sf):
    m = shared(spark, sf, MEMBERS)
    # Of each pair with one card the settings are alike where both have none or both have one.
    return m.select("k", "repo_id", F.when(F.col("base").isNotNull(), F.array("base")).alias("base_models"), "card_sha", "architecture", F.lit(None).cast("long").alias("parameters"), F.lit("t").alias("model_type"), "downloads", "created")


SUPPRESSED = f"SELECT p_partkey AS k, {member_id('p_partkey')} || '-AWQ' AS repo_id FROM {{part}} WHERE p_partkey % 5 = 0"
PLACE = "-downloads, CASE WHEN created = '' THEN '9999' ELSE created END, length(split_part(repo_id, '/', 2)), repo_id"
STEM = "regexp_replace(split_part({0}, '/', 2), '(-GGUF|-AWQ)+$', '')"
FAMILY = "split_part({0}, '/', 1) || '--' || lower(regexp_replace(split_part({0}, '/', 2), '(-GGUF|-AWQ)+$', ''))"
FAMILIES_SQL = f"""m AS ({duck(MEMBERS)}), d AS (SELECT *, first_value(repo_id) OVER w AS best_copy, first_value(k) OVER w AS best_k, count(*) OVER (PARTITION BY card_sha, architecture) AS n FROM m WHERE card_sha IS NOT NULL WINDOW w AS (PARTITION BY card_sha, architecture ORDER BY {PLACE})),
  dup AS (SELECT repo_id AS dup_id, best_copy AS dup_of, best_k FROM d WHERE n > 1 AND repo_id <> best_copy),
  up AS (SELECT m.*, dup_of, coalesce(best_k, k) AS start_k FROM m LEFT JOIN dup ON repo_id = dup_id),
  climb AS (SELECT k, start_k AS s0 FROM up), r7 AS (SELECT k, list_min(list_filter([s0, s0 // 8, s0 // 64, s0 // 512, s0 // 4096, s0 // 32768, s0 // 262144, s0 // 2097152], lambda x: x >= 1 OR s0 = 0)) AS root_k FROM climb),
  placed AS (SELECT up.*, {FAMILY.format('(' + member_id('root_k') + ')')} AS family_id FROM up JOIN r7 USING (k)),
  best AS (SELECT family_id, first(repo_id ORDER BY {PLACE}) AS best_ FROM placed GROUP BY 1),
  fam AS (SELECT *, CASE WHEN dup_of IS NOT NULL THEN 'exact_duplicate_of' WHEN repo_id = best_ THEN 'canonical' WHEN k % 7 = 1 THEN 'format_or_quantization_variant' WHEN k % 7 = 2 THEN 'mirror_of' ELSE 'derived_from' END AS relation FROM placed JOIN best USING (family_id)),
  resolved AS (SELECT repo_id, family_id, coalesce(dup_of, best_) AS canonical_repo_id, relation, CASE relation WHEN 'exact_duplicate_of' THEN 'identical cleaned model card and config' WHEN 'format_or_quantization_variant' THEN 'repository name matches quantization pattern'
      WHEN 'mirror_of' THEN 'repository name matches mirror pattern' WHEN 'derived_from' THEN coalesce('declared base model ' || base, '') ELSE '' END AS evidence, CASE WHEN relation IN ('canonical', 'derived_from') THEN 'primary' ELSE 'variant' END AS discovery_scope FROM fam
    UNION ALL SELECT s.repo_id, {FAMILY.format('s.repo_id')}, coalesce(best_, ''), 'format_or_quantization_variant', 'suppressed at selection as a packaging variant' || CASE WHEN best_ IS NULL THEN '|canonical parent ' || split_part(s.repo_id, '/', 1) || '/' || {STEM.format('s.repo_id')} || ' not represented in this corpus' ELSE '' END, 'variant'
    FROM ({duck(SUPPRESSED)}) s LEFT JOIN best ON best.family_id = {FAMILY.format('s.repo_id')})"""


def resolved(spark, sf):
    return families.resolve(members(spark, sf), shared(spark, sf, SUPPRESSED).select("repo_id"))


@query(f"WITH {FAMILIES_SQL} SELECT * FROM resolved")
def families_resolved(spark, sf):
    """Family, canonical record, relation, evidence and scope, of suppressed variants too."""
    return resolved(spark, sf).withColumn("evidence", joined("evidence"))


@query(f"WITH {FAMILIES_SQL} SELECT family_id, string_agg(repo_id, '|' ORDER BY repo_id) AS variants FROM resolved WHERE discovery_scope = 'variant' GROUP BY 1")
def family_variants(spark, sf):
    return families.variants_by_family(resolved(spark, sf)).select("family_id", joined("variants").alias("variants"))


@query(f"WITH {FAMILIES_SQL} SELECT dup_id AS repo_id, dup_of AS canonical FROM dup")
def exact_duplicate_records(spark, sf):
    """Records with the card and settings of a better one; null settings match, null cards don't."""
    return families.exact_duplicates(members(spark, sf))


@query(f"WITH m AS ({duck(MEMBERS)}) SELECT k % 9 AS bucket, first(repo_id ORDER BY {PLACE}) AS canonical, count(*) AS n_members FROM m GROUP BY 1")
def canonical_records(spark, sf):
    """The canonical record: downloads, creation, length of the name, id."""
    return families.canonical(members(spark, sf).withColumn("bucket", F.col("k") % 9), ["bucket"])


@query(f"WITH m AS ({duck(MEMBERS)}) SELECT repo_id, lower({STEM.format('repo_id')}) AS own, lower({STEM.format('coalesce(base, repo_id)')}) AS of_base FROM m")
def family_keys(spark, sf):
    """Provisional families by name, and by first base."""
    r = F.col("repo_id")
    return members(spark, sf).select("repo_id", naming.family_key(r).alias("own"), naming.family_key(r, F.col("base_models")).alias("of_base"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a|b|c' WHEN 1 THEN 'b|c' ELSE 'a' END AS bases FROM part")
def declared_parents(spark, sf):
    """Parents of the API, then of the card, each once."""
    k = F.col("p_partkey") % 3
    api, card = F.when(k != 1, F.array(F.lit("a"))), F.when(k == 0, F.array(F.lit("b"), F.lit("a"), F.lit("c"))).when(k == 1, F.array(F.lit("b"), F.lit("c"), F.lit("b")))
    return table(spark, sf, "part").select("p_partkey", joined(naming.base_models(api, card)).alias("bases"))


# --- selection ----------------------------------------------------------------------------------------

POOL = """SELECT p_partkey AS k, 'own' || CAST(p_partkey % 40 AS STRING) AS author, 'own' || CAST(p_partkey % 40 AS STRING) || '/' || replace(p_name, ' ', '-') || CASE p_partkey % 8 WHEN 1 THEN '-checkpoint-12' WHEN 2 THEN '-onnx' WHEN 3 THEN '-GPTQ' WHEN 4 THEN '-reupload' ELSE '' END AS repo_id,
  CASE WHEN p_partkey % 2 = 0 THEN 'text-generation' END AS pipeline_tag, CASE WHEN p_partkey % 3 = 0 THEN 'mit' END AS license, p_partkey % 4 AS lang, p_partkey % 5 AS ds, CASE WHEN p_partkey % 3 = 0 THEN CAST(1000000000 AS BIGINT) * p_size END AS parameters,
  '2023-0' || CAST(1 + p_partkey % 9 AS STRING) || '-15T00:00:00.000Z' AS last_modified, p_partkey % 13 = 0 AS private, p_partkey % 17 = 0 AS disabled, CASE p_partkey % 5 WHEN 1 THEN 'auto' WHEN 2 THEN 'manual' WHEN 3 THEN 'false' ELSE '' END AS gated FROM {part}"""


def candidate_features(spark, sf):
    p = shared(spark, sf, POOL)
    none = F.array().cast("array<string>")
    languages = F.when(F.col("lang") == 0, F.array(F.lit("en"))).when(F.col("lang") == 1, F.array(F.lit("EN"), F.lit("de"))).when(F.col("lang") == 2, none)
    author = F.when(F.col("k") % 40 < 39, F.col("author")).otherwise(F.concat("author", (F.col("k") % 7).cast("string"), F.floor(F.col("k") / 560).cast("string")))
    ready = p.select("k", "repo_id", author.alias("author"), "pipeline_tag", "license", languages.alias("languages"), F.when(F.col("ds") == 0, F.array(F.lit("d"))).otherwise(none).alias("datasets"), "parameters", "last_modified", "private", "disabled", "gated", F.lit(True).alias("eval_results"))
    return selection.features(ready, F.lit(AS_OF).cast("timestamp"))


@query(f"""WITH p AS ({duck(POOL)}), a AS (SELECT *, CASE WHEN k % 40 < 39 THEN author ELSE author || (k % 7) || (k // 560) END AS who FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY who) AS own FROM a), f AS (SELECT *, lang = 1 AS non_english, coalesce(parameters <= 3000000000, false) AS small_model, own <= 3 AS rare_publisher FROM n)
SELECT k, non_english, small_model, rare_publisher, round_even((pipeline_tag IS NOT NULL)::INT * 0.15 + (license IS NOT NULL)::INT * 0.15 + (lang < 2)::INT * 0.15 + (ds = 0)::INT * 0.15 + 0.2, 4)::DOUBLE AS documentation_quality,
  round_even((non_english::INT + small_model::INT + rare_publisher::INT + (ds = 0)::INT) / 4.0, 4)::DOUBLE AS diversity_bonus, round_even(pow(0.5, date_diff('day', left(last_modified, 10)::DATE, DATE '{AS_OF[:10]}') / 365.0), 4) AS recency_score,
  CASE k % 8 WHEN 1 THEN 'checkpoint' WHEN 2 THEN 'format_conversion' WHEN 3 THEN 'quantization' WHEN 4 THEN 'mirror' END AS variant_kind FROM f""")
def selection_features(spark, sf):
    """Documentation proxy, owner counts, diversity, recency and kinds of variants."""
    return candidate_features(spark, sf).select("k", "non_english", "small_model", "rare_publisher", "documentation_quality", "diversity_bonus", "recency_score", "variant_kind")


@query(f"""WITH p AS ({duck(POOL)}) SELECT k, CASE WHEN private OR disabled OR k % 5 = 2 THEN 'excluded_inaccessible' WHEN k % 8 = 1 THEN 'excluded_checkpoint' WHEN k % 8 IN (2, 3, 4) THEN 'suppressed_variant' END AS reason FROM p""")
def eligibility_reasons(spark, sf):
    """Why a candidate is out before ranking."""
    return candidate_features(spark, sf).select("k", selection.eligibility(None).alias("reason"))


@query("""WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT *, greatest(1, floor(n / sum(n) OVER () * 1000))::BIGINT AS q FROM s), b AS (SELECT *, row_number() OVER (ORDER BY q DESC, stratum) AS place FROM t)
SELECT stratum, (q + CASE WHEN place = 1 THEN 1000 - sum(q) OVER () ELSE 0 END)::BIGINT AS quota, greatest(10, ceil((q + CASE WHEN place = 1 THEN 1000 - sum(q) OVER () ELSE 0 END) * 3.0 / 4))::BIGINT AS per_query FROM b""")
def quotas(spark, sf):
    """Quotas in proportion to shares, and how many rows each of a stratum's four queries asks for."""
    shares = {r[0]: r[1] for r in table(spark, sf, "customer").groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()}  # a row for each stratum
    got = selection.scaled_quotas(shares, 1000)
    return spark.createDataFrame([(k, v, selection.query_limit(v, 3.0, 4)) for k, v in got.items()], "stratum string, quota long, per_query long")


@query("""WITH l AS (SELECT user_id AS repo_id, arg_max(event_type, event_id) AS decision, arg_max(event_id % 3, event_id) AS kind FROM events GROUP BY 1)
SELECT repo_id, kind = 0 AS final FROM l WHERE decision = 'click' OR decision = 'view' AND kind > 0""")
def still_included(spark, sf):
    """Repositories whose last decision includes them or may be tried again."""
    e = table(spark, sf, "events")
    kind = F.col("event_id") % 3
    decision = F.when(F.col("event_type") == "click", "included").when(F.col("event_type") == "view", "quarantined").otherwise("excluded")
    log = e.select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("seq"), decision.alias("decision"), F.when(kind > 0, "quarantined_fetch").otherwise("quarantined_parse").alias("reason"), (kind == 0).alias("final"))
    return selection.still_included(log).select("repo_id", "final")


# --- predicates ---------------------------------------------------------------------------------------

ITEM = """SELECT p_partkey AS k, 'own/' || replace(p_name, ' ', '-') || CAST(p_partkey AS STRING) AS repository, p_name AS name, p_type AS description, CASE p_partkey % 3 WHEN 0 THEN 'Text-Generation' WHEN 1 THEN 'odd' END AS task, CASE WHEN p_partkey % 2 = 0 THEN 'Transformers' END AS library,
  CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'declared_text' END AS license_status, CASE p_partkey % 5 WHEN 0 THEN 'variant' ELSE 'primary' END AS discovery_scope, CASE WHEN p_partkey % 6 > 0 THEN p_size * CAST(1000000000 AS BIGINT) END AS parameters FROM {part}"""


def typed_items(spark, sf):
    i = shared(spark, sf, ITEM)
    k, some = F.col("k"), lambda c, *v: F.when(c, F.array(*map(F.lit, v)))
    return i.withColumns({
        "category": some(k % 7 == 0, "Embedding", "X"), "subject": some(k % 8 == 0, "machine-learning", "law"), "languages": some(k % 4 == 0, "en", "DE"), "keywords": some(k % 9 == 0, "Fast tokens"), "capability": some(k % 10 == 0, "Reasoning"),
        "limitation": some(k % 3 == 0, "slow"), "trained_on": some(k % 6 == 0, "a quote on cells"), "evaluated_on": some(k % 5 == 0, "bench"),
    })


KEY_SPECS = (
    {"id": "task", "requires": {"task_any": ["text-generation", "EMBEDDING"]}}, {"id": "subject", "requires": {"subject_any": ["LAW", "art"]}}, {"id": "language", "requires": {"language_any": ["de"]}}, {"id": "library", "requires": {"library_any": ["TRANSFORMERS"]}},
    {"id": "license", "requires": {"license_status_any": ["unknown", "x"]}}, {"id": "most", "requires": {"max_parameters": 20_000_000_000}}, {"id": "least", "requires": {"min_parameters": 20_000_000_000}}, {"id": "scope", "requires": {"discovery_scope": "variant"}},
    {"id": "evidence", "requires": {"evidence_type_any": ["trained_on", "nonsense"]}}, {"id": "confidence", "requires": {"min_confidence": "high"}}, {"id": "keyword", "requires": {"keyword_any": ["FAST", "machine learning", "cells"]}}, {"id": "spelt", "requires": {"keyword_any": ["machine-learning"]}},
    {"id": "repo", "requires": {"repo_any": ["OWN/SMALL-RING0", "own/none"]}}, {"id": "limits", "requires": {"has_limitations": True}}, {"id": "unlimited", "requires": {"has_limitations": False}, "avoid": {"discovery_scope": "variant"}}, {"id": "both", "requires": {"task_any": ["odd"], "language_any": ["en"]}, "avoid": {"evidence_type_any": ["evaluated_on"]}},
)


def key_sql(flavour: str) -> str:
    bench = flavour == "benchmark"
    yes = {
        "task": "task = 'Text-Generation' OR k % 7 = 0", "subject": "k % 8 = 0", "language": "k % 4 = 0", "library": "k % 2 = 0", "license": "k % 4 = 0", "most": "parameters <= 20000000000", "least": "parameters >= 20000000000", "scope": "k % 5 = 0", "evidence": "k % 6 = 0", "confidence": "k % 5 = 0 OR k % 6 = 0",
        "keyword": "k % 9 = 0 OR k % 6 = 0" + ("" if bench else " OR k % 8 = 0"), "spelt": "k % 8 = 0" if bench else "false", "repo": "lower(repository) = 'own/small-ring0'" if bench else "true", "limits": "k % 3 = 0" if bench else "true",
        "unlimited": "k % 3 > 0 AND k % 5 > 0" if bench else "true", "both": "task = 'odd' AND k % 4 = 0" + (" AND k % 5 > 0" if bench else ""),
    }
    trap = {"unlimited": "k % 5 = 0", "both": "k % 5 = 0"}
    union = " UNION ALL ".join(f"SELECT '{q}' AS query_id, k, coalesce({c}, false) AS is_gold, {trap.get(q, 'false')} AS is_trap FROM i" for q, c in yes.items())
    return f"WITH i AS ({duck(ITEM)}), u AS ({union}) SELECT * FROM u WHERE is_gold OR is_trap"


@query(key_sql("benchmark"))
def predicate_keys(spark, sf):
    """Each key of the predicate language, with what is to be avoided."""
    return predicates.judged_pairs(typed_items(spark, sf), KEY_SPECS, "k")


@query(key_sql("builder"))
def predicate_keys_builder(spark, sf):
    """The builder's flavour: subjects with spaces, two keys unknown, nothing avoided."""
    return predicates.judged_pairs(typed_items(spark, sf), KEY_SPECS, "k", "builder")
