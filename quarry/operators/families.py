"""Lineage roots, families, exact copies and near copies of catalog records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import naming, text
from quarry.functions import values as V
from quarry.sources.tables import ensure_checkpoints, materialise, united

NEAR_JACCARD = 0.90
#: Classes that share a shingle from which on they meet by cells and parts, and classes of a part.
CROWD, BLOCK = 2_000, 1_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, which grows with the records: a join with it shuffles both sides.

    Sizes are guessed from compressed files, so Spark would broadcast millions of names, and build each such table in the driver.
    """
    return df.hint("merge")


def parents(df: DataFrame, id_col: str = "repo_id", bases: str = "base_models") -> DataFrame:
    """(node, parent): the first declared base in order of name."""
    return df.select(F.col(id_col).alias("node"), F.try_element_at(F.array_sort(bases), F.lit(1)).alias("parent"))


def lineage_roots(edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, root) along the chain of parents.

    Without ``hops`` chains of any length are followed by doubling jumps (a chain of d needs log2 d joins); a parent that isn't
    a node ends a chain; a cycle ends at the node before the first repeated one.  With ``hops`` at
    most so many steps are made and only a node that is its own parent stops early, so a cycle spins to the end.
    """
    nodes = edges.select("node", F.when(F.col("parent") == F.col("node"), None).otherwise(F.col("parent")).alias("parent")).dropDuplicates(["node"])
    if hops is not None:
        step = nodes.select(F.col("node").alias("at"), F.col("parent").alias("up"))
        out = nodes.select("node", F.col("node").alias("root"))
        for _ in range(hops):
            out = out.join(shuffled(step), out["root"] == step["at"], "left").select("node", F.coalesce("up", "root").alias("root"))
        return out
    ensure_checkpoints(edges.sparkSession)
    nodes = nodes.checkpoint()
    known, running = ended(nodes)
    if running is None:
        return known
    step = nodes.join(shuffled(running), "node", "left_semi").select(F.col("node").alias("at"), F.col("parent").alias("up")).checkpoint()
    return united(known, cycle_roots(doubled(step.select(F.col("at").alias("node"), F.col("up").alias("root"))), step))


def ended(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, root) of chains of (node, parent) that end, and the nodes (node) whose chains run into a cycle, if there are any.

    Lengths of jumps double.  After k rounds the root is known of all nodes up to 2^k from their chain's end, so while any such
    chain is open each round closes some; a round that closes none leaves cycles alone.  Nodes whose root is known aren't joined again.
    """
    known = [nodes.filter("parent is null").select("node", F.col("node").alias("root"))]
    going = nodes.filter("parent is not null").select("node", F.col("parent").alias("root"))
    left = going.count()
    while left:
        far = united(*[k.select(F.col("node").alias("at"), F.col("root").alias("up"), F.lit(False).alias("on")) for k in known], going.select(F.col("node").alias("at"), F.col("root").alias("up"), F.lit(True).alias("on")))
        moved = going.join(shuffled(far), going["root"] == far["at"], "left").select("node", F.coalesce("up", "root").alias("root"), F.coalesce("on", F.lit(False)).alias("on")).checkpoint()
        known.append(moved.filter("not on").select("node", "root"))
        going = moved.filter("on").select("node", "root")
        before, left = left, going.count()
        if left == before:
            return united(*known), going.select("node")
    return united(*known), None


def doubled(jump: DataFrame) -> DataFrame:
    """Steps (node, root) repeated at least as often as there are nodes: lengths double, so a chain ends within log2 of their number."""
    jump = jump.checkpoint()
    for _ in range(jump.count().bit_length() + 1):
        far = jump.select(F.col("node").alias("at"), F.col("root").alias("up"))
        after = jump.join(shuffled(far), jump["root"] == far["at"], "left").select("node", F.col("root").alias("was"), F.coalesce("up", "root").alias("root")).checkpoint()
        jump = after.select("node", "root")
        if not after.filter("was != root").limit(1).count():
            break
    return jump


def cycle_roots(nodes: DataFrame, step: DataFrame) -> DataFrame:
    """Roots of chains that run into a cycle, whatever their lengths: ``nodes`` (node, root) stand on their cycle after doubling.

    Nodes of a cycle go round by equal numbers of steps, so together they stand on all of it.  The first node that a chain
    repeats is the one where it enters, and the node before that one, in the cycle, is the root.
    """
    on = nodes.select(F.col("root").alias("on_")).distinct().checkpoint()
    first = nodes.select("node").join(shuffled(step), F.col("node") == step["at"]).join(shuffled(on), F.col("node") == on["on_"], "left")
    enters = doubled(first.select("node", F.when(F.col("on_").isNotNull(), F.col("node")).otherwise(F.col("up")).alias("root"))).select("node", F.col("root").alias("enter_"))
    before = step.join(shuffled(on), step["at"] == on["on_"], "left_semi").select(F.col("up").alias("next_"), F.col("at").alias("root"))
    return enters.join(shuffled(before), enters["enter_"] == before["next_"]).select("node", "root")


def canonical_order() -> list[Column]:
    """Most downloads, then the earliest creation, the shortest name, and the id."""
    return [F.desc(F.coalesce("downloads", F.lit(0))), F.coalesce(F.nullif(F.col("created"), F.lit("")), F.lit("9999")), F.length(naming.name(F.col("repo_id"))), F.col("repo_id")]


def canonical(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The canonical repository of each group, by partial minima."""
    key = F.struct((-F.coalesce("downloads", F.lit(0))).alias("d"), F.coalesce(F.nullif(F.col("created"), F.lit("")), F.lit("9999")).alias("c"), F.length(naming.name(F.col("repo_id"))).alias("n"), F.col("repo_id").alias("r"))
    return df.groupBy(*by).agg(F.min(key).alias("k"), F.count("*").alias("n_members")).select(*by, F.col("k.r").alias("canonical"), "n_members")


CONFIG = ("architecture", "parameters", "model_type")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(repo_id, canonical) of records that share card and configuration with a better one; null cards never match, null settings do."""
    keys = ["card_sha", *CONFIG]
    best = canonical(df.filter("card_sha is not null and card_sha != ''"), keys).filter("n_members > 1")
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(best[k]) for k in keys])
    return df.join(shuffled(best), same).filter(F.col("repo_id") != F.col("canonical")).select("repo_id", "canonical")


def duplicate_groups(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """Digest, members and smallest id of each content that comes twice or more."""
    return df.groupBy(F.sha2(F.col(content), 256).alias("content_sha")).agg(F.count("*").alias("n_members"), F.min(id_col).alias("first_id")).filter("n_members > 1")


def fits(n: Column, at: Column, other_n: Column, other_at: Column, least: float) -> Column:
    """Whether two sets of these sizes, which share a shingle at these places of the order, can still be ``least`` alike if it is their first one.

    Of the order's rest each set has what its size leaves, so the shared part is one and the smaller rest at most.
    """
    sizes = F.least(n, other_n) >= F.lit(least) * F.greatest(n, other_n)
    return sizes & (1 + F.least(n - at, other_n - other_at) >= F.lit(least / (1 + least)) * (n + other_n) - F.lit(1e-6))


def crowded_pairs(crowd: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b) of sets that share a crowded shingle and can be alike; ``crowd`` (h, g, rep, n, place).

    Sets with one shingle, group, size and place are a cell.  Whether two cells can hold alike sets is decided once for the cells, so a
    template that all sets share gives no pair if what they don't share is enough.  The other cells are cut to parts of some ``block`` sets,
    and a pair of parts is a join key of its own: no task gets a whole crowd, and a set is copied once a part that it meets.
    """
    cell = ["h", "g", "n", "place"]
    cells = crowd.groupBy(*cell).agg(F.count("*").alias("sets")).withColumn("parts", F.ceil(F.col("sets") / block))
    u, v = (cells.select("h", "g", *[F.col(c).alias(f"{c}_{side}") for c in ("n", "place", "parts")]) for side in "uv")
    ordered = F.struct("n_u", "place_u") <= F.struct("n_v", "place_v")
    both = u.join(v, ["h", "g"]).filter(ordered & fits(F.col("n_u"), F.col("place_u"), F.col("n_v"), F.col("place_v"), least))
    one = (F.col("n_u") == F.col("n_v")) & (F.col("place_u") == F.col("place_v"))
    part = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{side}") - 1)).alias(f"part_{side}")
    meeting = both.select("*", part("u")).select("*", part("v")).filter(~one | (F.col("part_u") <= F.col("part_v")))
    key = ["h", "g", "n_u", "place_u", "part_u", "n_v", "place_v", "part_v"]
    meeting = materialise(meeting.select(*key), "parts")
    placed = crowd.join(cells.drop("sets"), cell).select(*cell, "rep", F.pmod(F.xxhash64("rep"), "parts").alias("part"))
    x, y = (placed.select("h", "g", F.col("rep").alias(name), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "place", "part")]) for side, name in (("u", "x"), ("v", "y")))
    left = meeting.join(x, ["h", "g", "n_u", "place_u", "part_u"])
    right = meeting.join(y, ["h", "g", "n_v", "place_v", "part_v"])
    inside = one & (F.col("part_u") == F.col("part_v"))
    return left.join(right, key).filter(~inside | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(df: DataFrame, id_col: str, content: str, buckets: Sequence[str] = (), least: float = NEAR_JACCARD, size: int = 5, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(a, b, jaccard) of pairs, a before b, with shingle sets at least ``least`` alike, inside equal buckets that aren't all null.

    Prefix filter: ordered by rarity, two sets that alike share one of their first n - ceil(least * n) + 1
    shingles, so only these are joined; sizes and places must fit too.  A shingle of over ``crowd`` classes goes by cells and
    parts of some ``block`` classes.  Equal sets are one class first and cost a link to its
    smallest member, not all pairs.  Candidates are verified on whole sets.
    """
    base = df.select(F.col(id_col).alias("id"), *buckets, text.shingles(F.col(content), size).alias("s")).filter("size(s) > 0")
    if buckets:
        base = base.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in buckets]))
    prints = base.withColumn("s", F.array_sort(F.transform("s", lambda x: F.xxhash64(x)))).withColumn("k", F.sha2(F.concat_ws(",", F.transform("s", lambda x: x.cast("string"))), 256))
    # Written, as several branches read it.
    classes = materialise(prints.groupBy("k", *buckets).agg(F.min("id").alias("rep"), F.first("s").alias("s")), "classes")
    named = classes.select(F.col("k").alias("k_of"), "rep", *[F.col(c).alias(f"{c}_of") for c in buckets])
    member = prints.drop("s").join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in ("k", *buckets)]))
    same = member.filter(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    exploded = classes.select("rep", *buckets, F.size("s").alias("n"), F.explode("s").alias("h"))
    # A shingle of one class is the rarest and meets nothing, so only the others are moved; their places come after those.
    shared = exploded.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("rep", *buckets)
    ranked = exploded.join(shared, "h").withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "h")))
    group = F.to_json(F.struct(*buckets)) if buckets else F.lit("")  # null buckets are equal
    short = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    prefix = materialise(short.select("h", group.alias("g"), "rep", "n", "place", "df"), "prefixes")  # read by several branches
    few = prefix.filter(F.col("df") <= crowd)
    x, y = few.alias("x"), few.alias("y")
    meets = (F.col("x.h") == F.col("y.h")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.rep") < F.col("y.rep"))
    meets = meets & fits(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), least)
    pairs = x.join(y, meets).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    many = prefix.filter(F.col("df") > crowd)
    pairs = (pairs if many.isEmpty() else united(pairs, crowded_pairs(many, least, block))).distinct()
    sets = classes.select("rep", "s")
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    jaccard = inter / (F.size("sa") + F.size("sb") - inter)
    return united(both.withColumn("jaccard", jaccard).filter(F.col("jaccard") >= least).select("a", "b", "jaccard"), same)


def resolve(df: DataFrame, variants: DataFrame | None = None, patterns: naming.Patterns = V.NAME_PATTERNS) -> DataFrame:
    """Family, canonical record, relation, evidence and scope of every record, and of suppressed variants.

    ``df``: repo_id, base_models, card_sha, architecture, parameters, model_type, downloads, created.
    ``variants``: repo_id and an optional relation.
    """
    dups = exact_duplicates(df).select(F.col("repo_id").alias("dup_id"), F.col("canonical").alias("dup_of"))
    roots = lineage_roots(parents(df)).select(F.col("node").alias("start"), "root")
    with_dup = df.join(shuffled(dups), df["repo_id"] == F.col("dup_id"), "left").withColumn("start_", F.coalesce("dup_of", "repo_id"))
    placed = with_dup.join(shuffled(roots), F.col("start_") == F.col("start"), "left").withColumn("family_id", naming.family_id(F.coalesce("root", "start_"), patterns))
    # Written, as several branches read it.
    placed = materialise(placed.select("repo_id", "family_id", "dup_of", "base_models", "downloads", "created"), "placed")
    best = canonical(placed, ["family_id"]).select(F.col("family_id").alias("fam_"), F.col("canonical").alias("best_"))
    joined = placed.join(shuffled(best), placed["family_id"] == F.col("fam_"))
    kind = naming.variant_kind(F.col("repo_id"), patterns)
    packaged = F.coalesce(kind.isin("quantization", "format_conversion"), F.lit(False))
    relation = (
        F.when(F.col("dup_of").isNotNull(), "exact_duplicate_of")
        .when(F.col("repo_id") == F.col("best_"), "canonical")
        .when(packaged, "format_or_quantization_variant")
        .when(kind == "mirror", "mirror_of")
        .otherwise("derived_from")
    )
    r = F.col("relation")
    evidence = (
        F.when(r == "exact_duplicate_of", F.array(F.lit("identical cleaned model card and config")))
        .when(r == "format_or_quantization_variant", F.array(F.concat(F.lit("repository name matches "), kind, F.lit(" pattern"))))
        .when(r == "mirror_of", F.array(F.lit("repository name matches mirror pattern")))
        .when(r == "derived_from", F.transform(F.coalesce("base_models", F.array().cast("array<string>")), lambda b: F.concat(F.lit("declared base model "), b)))
        .otherwise(F.array().cast("array<string>"))
    )
    scope = F.when(r.isin("exact_duplicate_of", "format_or_quantization_variant", "mirror_of"), "variant").otherwise("primary")
    out = joined.withColumn("relation", relation).select(
        "repo_id", "family_id", F.coalesce("dup_of", "best_").alias("canonical_repo_id"), "relation", evidence.alias("evidence"), scope.alias("discovery_scope")
    )
    if variants is None:
        return out
    own = variants if "relation" in variants.columns else variants.withColumn("relation", F.lit("format_or_quantization_variant"))
    parent = F.concat(naming.owner(F.col("repo_id")), F.lit("/"), naming.stem(F.col("repo_id"), patterns))
    new = own.join(shuffled(placed.select("repo_id")), "repo_id", "left_anti").withColumn("parent_", parent).withColumn("family_id", naming.family_id(F.col("parent_"), patterns))
    held = new.join(shuffled(best), new["family_id"] == F.col("fam_"), "left")
    said = F.array(F.lit("suppressed at selection as a packaging variant"))
    missing = F.array_append(said, F.concat(F.lit("canonical parent "), F.col("parent_"), F.lit(" not represented in this corpus")))
    attached = held.select("repo_id", "family_id", F.coalesce("best_", F.lit("")).alias("canonical_repo_id"), "relation", F.when(F.col("best_").isNull(), missing).otherwise(said).alias("evidence"), F.lit("variant").alias("discovery_scope"))
    return united(out, attached)


def variants_by_family(assigned: DataFrame) -> DataFrame:
    return assigned.filter("discovery_scope = 'variant'").groupBy("family_id").agg(F.array_sort(F.collect_list("repo_id")).alias("variants"))
