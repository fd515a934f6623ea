"""Building a catalog: select, clean, normalise, enrich, group, emit, validate and report, as frames that build on one another."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import naming, text
from quarry.functions import values as V
from quarry.operators import cards, evidence, families, records, reports, selection
from quarry.sources.tables import materialise, united


@dataclass(frozen=True)
class Policy:
    """Strata with their shares, how many records are wanted, and the time as of which ages count."""

    shares: Mapping[str, int]
    target: int
    as_of: str
    caps: Mapping[str, float] | None = None
    taxonomy: Mapping[str, str] | None = None

    def quotas(self) -> dict[str, int]:
        return selection.scaled_quotas(dict(self.shares), self.target)


def keep(df: DataFrame, name: str) -> DataFrame:
    """A stage's table, written and read again, so that plans don't grow from stage to stage."""
    return materialise(df, name)


def decide(found: DataFrame, policy: Policy) -> DataFrame:
    """Decisions about discovered candidates (``records.candidates`` with ``found_by``)."""
    strata = selection.assign_strata(found, policy.quotas())
    placed = keep(found.drop("stratum").join(strata, "repo_id"), "strata")
    rated = selection.score(keep(selection.features(placed, F.lit(policy.as_of).cast("timestamp")), "features"))
    roots = families.lineage_roots(families.parents(placed)).select(F.col("node").alias("repo_id"), naming.family_key(F.col("root")).alias("family_key"))
    return selection.select(rated.join(roots, "repo_id"), policy.quotas(), policy.target, policy.caps or V.CAPS)


def usable(clean: DataFrame) -> DataFrame:
    """Cards with a status: ok, or empty_card where there is too little or too much of the template."""
    return clean.withColumn("card_status", F.when(text.usable_card(F.col("clean_text")), "ok").otherwise("empty_card"))


def build(raw: DataFrame, found: DataFrame, card_texts: DataFrame, policy: Policy, enrich: Callable[[DataFrame], tuple[DataFrame, DataFrame]], abstracts: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a build by name.

    ``raw``: metadata; ``found`` (repo_id, found_by); ``card_texts`` (repo_id, raw).  ``enrich`` gets cards and gives claims and
    enrichment rows; it stands for the extracting model.
    """
    pool = keep(records.candidates(raw).join(found, "repo_id"), "pool")
    decisions = keep(decide(pool, policy), "decisions")
    taken = decisions.filter("decision = 'included'").select("repo_id")
    clean = keep(usable(cards.clean_cards(card_texts.join(taken, "repo_id", "left_semi"))), "cards")
    kept = taken.join(clean.filter("card_status = 'ok'").select("repo_id"), "repo_id", "left_semi")
    facts = keep(records.normalise(raw.join(kept, raw["id"] == kept["repo_id"], "left_semi"), clean), "facts")
    variants = decisions.filter("reason = 'suppressed_variant'").select("repo_id")
    assigned = families.resolve(facts.select("repo_id", "base_models", "card_sha", "architecture", F.col("parameters"), "model_type", "downloads", F.col("date_created").alias("created")), variants)
    assigned = keep(assigned, "families")
    claims, enrichment = enrich(clean)
    checked = keep(evidence.check_claims(claims, clean, policy.taxonomy), "claims")
    items = keep(records.emit(facts, checked, enrichment, assigned, abstracts), "items")
    dropped = decisions.filter("decision = 'included'").join(kept, "repo_id", "left_anti").select("repo_id", "stratum", F.lit("excluded").alias("decision"), F.lit("excluded_empty_card").alias("reason"), "score")
    log = united(decisions.join(dropped.select("repo_id"), "repo_id", "left_anti"), dropped)
    return {"decisions": log, "cards": clean, "facts": facts, "families": assigned, "claims": checked, "items": items, "composition": report(items)}


def report(items: DataFrame) -> DataFrame:
    dims: dict[str, Column] = {
        "task": F.col("task"),
        "library": F.col("library"),
        "license_status": F.col("license_status"),
        "publisher": F.col("creator.name"),
        "parameter_band": text.parameter_band(F.col("parameters")),
        "language": F.col("languages"),
        "subject": F.col("subject"),
        "scope": F.col("discovery_scope"),
        "relation": F.col("family_relation"),
    }
    return reports.composition(items, dims)


def snapshot(items: DataFrame, name: str, created: str) -> DataFrame:
    """One row that identifies a build: its number of records and a digest that doesn't depend on their order."""
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(items.columns))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return items.agg(F.count("*").alias("records"), F.sum(each).cast("string").alias("content_sum")).select(F.lit(name).alias("snapshot"), F.lit(created).alias("created"), "records", "content_sum")
