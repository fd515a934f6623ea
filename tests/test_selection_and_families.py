import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import families, greedy, selection
from quarry.plans.queries import QUERIES, scored


def test_quotas():
    assert selection.scaled_quotas({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert selection.scaled_quotas({"a": 1000, "b": 1}, 10) == {"a": 9, "b": 1}
    assert selection.query_limit(100, 2.0, 3) == 67 and selection.query_limit(1, 1.0, 5) == 10


def test_percentiles_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 5.0), ("d", 9.0)], "k string, v double")
    assert {r.k: round(r.percentile, 4) for r in selection.tie_percentiles(df, "v").collect()} == {"a": 0.1667, "b": 0.1667, "c": 0.6667, "d": 1.0}
    assert {r.k: round(r.p, 4) for r in df.withColumn("p", selection.average_tie_percentile("v")).collect()} == {"a": 0.1667, "b": 0.1667, "c": 0.6667, "d": 1.0}
    assert selection.tie_percentiles(df.limit(1), "v").first().percentile == 1.0


def plain_selection(rows, quotas, target, caps):
    """The rule, written once more in plain loops."""
    chosen, by_author, by_family = {}, {}, {}
    author_cap, family_cap = max(1, int(caps["publisher_max_fraction"] * target)), caps["family_max_records"]

    def attempt(r, reason):
        if by_author.get(r.author, 0) >= author_cap or by_family.get(r.family_key, 0) >= family_cap:
            return False
        chosen[r.repo_id] = reason
        by_author[r.author] = by_author.get(r.author, 0) + 1
        by_family[r.family_key] = by_family.get(r.family_key, 0) + 1
        return True

    best = sorted(rows, key=lambda r: (-r.score, r.repo_id))
    for s, quota in quotas.items():
        pool = [r for r in best if r.stratum == s]
        n, room = 0, max(1, round(quota * (1 - caps["diversity_reserve_fraction"])))
        for r in pool:
            n += n < room and attempt(r, "included_ranked")
        left = quota - n
        flags = lambda r: r.non_english + r.small_model + r.rare_publisher
        for r in sorted((r for r in pool if r.repo_id not in chosen), key=lambda r: (-flags(r), -r.score, r.repo_id)):
            if left > 0 and attempt(r, "included_diversity" if flags(r) else "included_ranked"):
                left -= 1
    for r in best:
        if len(chosen) < target and r.repo_id not in chosen:
            attempt(r, "included_diversity")
    return chosen


def test_greedy_selection(spark, tiny):
    got = {r.repo_id: (r.decision, r.reason) for r in QUERIES["greedy_selection"](spark, tiny).collect()}
    c = scored(spark, tiny).withColumn("repo_id", F.lpad(F.col("repo_id").cast("string"), 8, "0"))
    c = c.withColumn("family_key", F.concat("author", F.lit("-"), (F.col("repo_id").cast("long") % 9).cast("string")))
    rows = c.collect()
    assert len(got) == len(rows)
    eligible = [r for r in rows if r.variant_kind is None]
    strata = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    want = plain_selection(eligible, selection.scaled_quotas(dict.fromkeys(strata, 100), 100), 100, {"publisher_max_fraction": 0.10, "family_max_records": 4, "diversity_reserve_fraction": 0.15})
    assert {k for k, v in got.items() if v[0] == "included"} == set(want)
    assert all(got[k] == ("included", v) for k, v in want.items())
    assert all(got[r.repo_id] == ("suppressed", "suppressed_variant") for r in rows if r.variant_kind)


def test_strata_fill_evenly(spark):
    rows = [("r1", ["a:x"]), ("r2", ["a:x", "b:y"]), ("r3", ["a:x", "b:y"]), ("r4", ["b:z", "c:q"])]
    got = {r.repo_id: r.stratum for r in selection.assign_strata(spark.createDataFrame(rows, "repo_id string, found_by array<string>"), {"a": 1, "b": 2}).collect()}
    assert got == {"r1": "a", "r2": "b", "r3": "a", "r4": "b"}


def test_eligibility(spark):
    rows = [("a", "internal-testing", False, False, "false", None), ("b", "me", True, False, None, None), ("c", "me", False, False, "auto", "checkpoint"), ("d", "me", False, False, "manual", None), ("e", "me", False, False, "auto", None), ("f", "me", False, False, "", "mirror")]
    df = spark.createDataFrame(rows, "repo_id string, author string, private boolean, disabled boolean, gated string, variant_kind string")
    assert {r.repo_id: r.e for r in df.withColumn("e", selection.eligibility(df)).collect()} == {"a": "excluded_checkpoint", "b": "excluded_inaccessible", "c": "excluded_checkpoint", "d": "excluded_inaccessible", "e": None, "f": "suppressed_variant"}


def test_features(spark):
    rows = [("o/m-GGUF", "o", "t", ["en", "hi"], ["d"], 10**9, "2023-01-01T00:00:00Z"), ("p/n", "p", None, None, None, None, "bad")]
    df = spark.createDataFrame(rows, "repo_id string, author string, pipeline_tag string, languages array<string>, datasets array<string>, parameters long, last_modified string")
    got = {r.repo_id: r for r in selection.features(df, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert (got["o/m-GGUF"].documentation_quality, got["o/m-GGUF"].recency_score, got["o/m-GGUF"].diversity_bonus, got["o/m-GGUF"].variant_kind) == (0.45, 0.5, 1.0, "quantization")
    assert (got["p/n"].documentation_quality, got["p/n"].recency_score, got["p/n"].diversity_bonus) == (0.0, 0.0, 0.25)


def test_log(spark):
    log = spark.createDataFrame([("a", 1, "included", "x"), ("a", 2, "excluded", "y"), ("b", 1, "quarantined", "quarantined_fetch"), ("c", 1, "quarantined", "quarantined_enrichment")], "repo_id string, seq long, decision string, reason string")
    assert {r.repo_id for r in selection.still_included(log).collect()} == {"b"}
    assert selection.still_included(log, quarantine_is_final=True).count() == 0


def plain_root(start, parent):
    seen, at = {start}, start
    while parent.get(at) is not None:
        up = parent[at]
        if up in seen:
            return at
        if up not in parent:
            return up
        seen.add(up)
        at = up
    return at


def test_lineage(spark):
    rng = random.Random(4)
    parent = {f"n{i:02}": f"n{rng.randrange(60):02}" if i % 5 else None for i in range(50)}
    parent |= {f"c{i:02}": f"c{i + 1:02}" for i in range(21)} | {"c21": None, "s": "s", "x": "outside"}
    edges = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = {r.node: r.root for r in families.lineage_roots(edges).collect()}
    assert got == {k: plain_root(k, parent) for k in parent}
    seven = {r.node: r.root for r in families.lineage_roots(edges, hops=7).collect()}
    assert seven["c00"] == "c07" and seven["s"] == "s" and seven["x"] == "outside"


def test_lineage_of_long_cycles(spark):
    parent = {f"a{i:03}": f"a{(i + 1) % 300:03}" for i in range(300)}  # a cycle of 300
    parent |= {f"t{i:03}": f"t{i + 1:03}" if i < 299 else "u0" for i in range(300)} | {"u0": "u1", "u1": "u2", "u2": "u0", "v": "u1", "w": "t150"}  # a long way into one of three
    parent |= {f"p{i}": f"p{i ^ 1}" for i in range(4)}
    got = {r.node: r.root for r in families.lineage_roots(spark.createDataFrame(list(parent.items()), "node string, parent string")).collect()}
    assert got == {k: plain_root(k, parent) for k in parent}


def test_resolve(spark):
    rows = [
        ("base/Model-7B", [], "s1", "A", 7, "t", 100, "2020"),
        ("copy/Model-7B", [], "s1", "A", 7, "t", 5, "2021"),
        ("ft/Model-7B-chat", ["base/Model-7B"], "s2", "A", 7, "t", 50, "2022"),
        ("q/Model-7B-GGUF", ["base/Model-7B"], "s3", "A", 7, "t", 900, "2023"),
        ("solo/Other", [], None, None, None, None, 1, None),
    ]
    df = spark.createDataFrame(rows, "repo_id string, base_models array<string>, card_sha string, architecture string, parameters long, model_type string, downloads long, created string")
    variants = spark.createDataFrame([("base/Model-7B-awq",), ("no/Thing-int4",)], "repo_id string")
    got = {r.repo_id: r for r in families.resolve(df, variants).collect()}
    assert got["copy/Model-7B"].relation == "exact_duplicate_of" and got["copy/Model-7B"].canonical_repo_id == "base/Model-7B"
    assert got["q/Model-7B-GGUF"].relation == "canonical" and got["ft/Model-7B-chat"].relation == "derived_from"
    assert got["ft/Model-7B-chat"].evidence == ["declared base model base/Model-7B"] and got["base/Model-7B"].family_id == "base--model-7b"
    assert got["base/Model-7B-awq"].canonical_repo_id == "q/Model-7B-GGUF" and got["no/Thing-int4"].canonical_repo_id == "" and len(got["no/Thing-int4"].evidence) == 2
    assert {r.family_id: r.variants for r in families.variants_by_family(families.resolve(df, variants)).collect()}["base--model-7b"] == ["base/Model-7B-awq", "copy/Model-7B"]


NARROW_SCHEMA = "repo_id string, stratum string, author string, family_key string, score double, non_english boolean, small_model boolean, rare_publisher boolean, private boolean, disabled boolean, gated string, variant_kind string"


@pytest.mark.parametrize(("seed", "authors", "families", "caps"), [(1, 3, 40, (0.2, 2)), (2, 12, 6, (0.05, 3)), (3, 2, 3, (0.5, 50))])
def test_rounds_take_what_the_walk_takes(spark, seed, authors, families, caps):
    """Ties in scores, tight caps, an author with a third of all rows, null authors, strata that can't be filled."""
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        author = None if rng.random() < 0.1 else "hot" if rng.random() < 0.33 else f"a{rng.randrange(authors)}"
        rows.append((f"r{i:03}", rng.choice("xxxyz"), author, f"f{rng.randrange(families)}", rng.randrange(8) / 8, *(rng.random() < 0.2 for _ in range(3)), False, False, "auto", None))
    df = spark.createDataFrame(rows, NARROW_SCHEMA)
    quotas, limits = {"x": 40, "y": 30, "z": 60}, {"publisher_max_fraction": caps[0], "family_max_records": caps[1], "diversity_reserve_fraction": 0.25}
    want = plain_selection(df.collect(), quotas, 120, limits)
    got = {r.repo_id: r.reason for r in selection.select(df.repartition(5), quotas, 120, limits).collect()}
    assert len(got) == 400 and {k: v for k, v in got.items() if v != "excluded_over_quota"} == want


def test_selection_of_nothing(spark):
    none = spark.createDataFrame([], NARROW_SCHEMA)
    assert selection.select(none, {"x": 3}, 5).collect() == []


def test_no_task_of_a_walk_has_all_rows(spark):
    """The number of rows of a group is limited before rows are dealt out."""
    df = spark.range(10_000).select(F.col("id").alias("row_"), F.concat(F.lit("one"), F.col("id") % 1).alias("author"), F.lit(3).alias("room_author"), F.lit(0).alias("major_"), F.rand(1).alias("minor_"), F.col("id").cast("string").alias("repo_id"))
    plan = greedy.first_of_groups(df.repartition(8), "author", 3)._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("hashpartitioning(author")
    assert "WindowGroupLimit" in plan[shuffle:] and plan.count("WindowGroupLimit") == 2
    taken = greedy.greedy(df.repartition(8), {"author": 3}, 2)
    assert [r.row_ for r in taken.orderBy("minor_").collect()] == [r.row_ for r in df.orderBy("minor_").limit(2).collect()]


def test_segments_hand_the_fill_over(spark):
    rng = random.Random(9)
    rows = [(f"r{i:04}", [f"{s}:q" for s in rng.sample("abcd", rng.randint(1, 3))]) for i in range(600)]
    quotas = {"a": 5, "b": 50, "c": 100, "d": 7}
    df = spark.createDataFrame(rows, "repo_id string, found_by array<string>").repartition(7)
    filled = dict.fromkeys(quotas, 0)
    want = {}
    for k, shared in ((k, s) for s in (False, True) for k, s in [(r, s) for r in sorted(rows)] if (len(k[1]) > 1) == s):
        best = min(sorted(x[0] for x in k[1]), key=lambda s: (filled[s] / quotas[s], s))
        want[k[0]] = best
        filled[best] += 1
    for n in (50, 10_000):
        assert {r.repo_id: r.stratum for r in selection.assign_strata(df, quotas, n).collect()} == want


def shingle_sets(rows, size=5):
    out = {}
    for key, words in rows:
        w = words.split()
        out[key] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize("crowd,block", [(2_000, 1_000), (1, 3), (0, 1)])
def test_near_duplicates_by_all_pairs(spark, crowd, block):
    rng = random.Random(crowd)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(rng.randint(20, 70))] for _ in range(6)]
    rows = []
    for i in range(220):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 5)}"
        if rng.random() < 0.3:
            words = words[rng.randint(0, 2) :] + ["end"] * rng.randint(0, 2)
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice([1, None])))
    sets = shingle_sets((i, t) for i, t, *_ in rows)
    of = {i: (a, b) for i, _, a, b in rows}
    classes = {}
    for i in sets:
        classes.setdefault((frozenset(sets[i]), of[i]), []).append(i)
    for least in (0.9, 0.6):
        want = {}
        heads = [min(m) for k, m in classes.items() if k[1] != (None, None)]
        for a in heads:
            for b in heads:
                both = len(sets[a] & sets[b])
                if a < b and of[a] == of[b] and both >= least * (len(sets[a]) + len(sets[b]) - both):
                    want[a, b] = round(both / (len(sets[a]) + len(sets[b]) - both), 9)
        for k, m in classes.items():
            want |= {(min(m), i): 1.0 for i in m if i != min(m)} if k[1] != (None, None) else {}
        df = spark.createDataFrame(rows, "id long, t string, lang string, kind int")
        got = families.near_duplicates(df, "id", "t", ["lang", "kind"], least=least, crowd=crowd, block=block).collect()
        assert len(want) > 10 and {(r.a, r.b): round(r.jaccard, 9) for r in got} == want and len(got) == len(want)


def test_near_duplicates_of_records_that_share_a_template(spark):
    """Twenty thousand records of one template, each with words of its own, and some that differ from another by a last word."""
    template = " ".join(f"t{i}" for i in range(100))
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} {template}") for i in range(20_000)]
    rows += [(20_000 + i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} {template} end") for i in range(0, 60, 3)]
    got = families.near_duplicates(spark.createDataFrame(rows, "id long, t string").repartition(8), "id", "t").collect()
    assert {(r.a, r.b): round(r.jaccard, 6) for r in got} == {(i, 20_000 + i): round(104 / 105, 6) for i in range(0, 60, 3)}
