"""SimHash near-duplicate groups by pigeonhole blocks.

A text's fingerprint has a bit where over half of its shingles' hashes have it.  Fingerprints are cut to
blocks; two that differ in few bits agree on all but a few blocks, so they meet in a bucket named by some
of their blocks.  Inside a bucket the Hamming distance is verified, and links are joined to components.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bound_batches, fresh, release
from quarry.sources.tables import materialise, remove

#: Words of a shingle, seed of its hash, bits at which fingerprints still link.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Blocks of a fingerprint; two that link agree on at least BLOCKS - DISTANCE of them.
BLOCKS = 6
#: Fingerprints of a bucket up to which it is compared as it is; the bits of larger ones are cut to blocks once more.
BUCKET = 2048
#: Crowded buckets, or rows that go, up to which they are broadcast (16 to 32 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 1 << 19


def shingle_hashes(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> bytes:
    """XXH64 of each shingle, eight bytes each, high byte first."""
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_digest(joined, seed)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[s : e - 1], seed) for s, e in zip(starts, starts[size:], strict=False)])


def fingerprint(hashes: bytes) -> int:
    """Majority bits; 0 for no hashes."""
    n = len(hashes) // 8
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 << 16):  # very long texts by parts
        bits = np.unpackbits(np.frombuffer(hashes[at : at + (8 << 16)], np.uint8)).reshape(-1, 64)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def text_fingerprint(data: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    return fingerprint(shingle_hashes((data or b"").lower().split(), size, seed))  # bytes.lower changes A-Z alone


def add_fingerprint(df: DataFrame, text: str = "text", to: str = "fp", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``df`` with the fingerprint as a signed long."""

    bound_batches(df.sparkSession)
    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        prints = np.array([text_fingerprint(d, size, seed) for d in as_bytes(texts)], np.uint64)
        release()
        return pa.array(prints.view(np.int64))

    return df.withColumn(to, fp(F.col(text)))


def masks(bits: list[int], blocks: int, distance: int) -> list[int]:
    """For each choice of ``blocks - distance`` of the blocks that the bit numbers are cut to, the mask of the chosen bits."""
    at = [len(bits) * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(own, blocks - distance)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucketed(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(k, c, f): each fingerprint f in the bucket of each choice c of blocks; k is a hash of the choice and the bits."""
    every = F.array(*[F.lit(signed(m)).cast("long") for m in masks(list(range(64)), blocks, distance)])
    return fps.select("f", F.posexplode(every).alias("c", "m")).select(F.xxhash64("c", F.col("f").bitwiseAND(F.col("m"))).alias("k"), "c", "f")


def refined(crowded: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(k, f): rows of crowded buckets in buckets that agree on more bits.

    What two fingerprints of a bucket differ in lies in the blocks that were not chosen; these bits are cut to twice
    ``distance`` blocks, of which two that link agree on ``distance``.  With 6 blocks and 3 bits 47 bits at least are then
    equal, so a bucket has at most 2**17 distinct fingerprints, however many there are in all.
    """
    rest = []
    for m in masks(list(range(64)), blocks, distance):
        free = [b for b in range(64) if not m >> b & 1]
        rest.append([signed(m | x) for x in masks(free, 2 * distance, distance)])
    finer = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rest])
    return crowded.select("c", "f", F.posexplode(F.element_at(finer, F.col("c") + 1)).alias("d", "m")).select(F.xxhash64("c", "d", F.col("f").bitwiseAND(F.col("m"))).alias("k"), "f")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what is within ``distance`` among ``fps``: a link to each fingerprint from the smallest that reaches it here.

    Search by layers: each fingerprint is compared with those not reached yet, a row at a time, so no pair is kept.
    """
    values = np.sort(fps)
    todo = np.ones(len(values), bool)
    links = []
    for root in range(len(values)):
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(todo)
            near = rest[popcount(values[rest] ^ values[at]) <= distance]
            todo[near] = False
            queue.extend(near)
            links += [(int(values[root]), int(values[x])) for x in near]
    return links


def links_of(distinct: DataFrame, fp: str, distance: int = DISTANCE, blocks: int = BLOCKS, n: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose closure is that of all pairs within ``distance``.

    Every fingerprint goes to C(blocks, distance) buckets; buckets are counted by partial sums, and those of one are left out.
    Buckets of more than BUCKET are refined, so that no group of a size that grows with the data meets in a task, and no
    pair is left out.  A group gives fewer links than it has rows.  ``n``: the number of fingerprints, if it is known.
    """
    choices = comb(blocks, distance)
    keyed = bucketed(distinct.select(F.col(fp).alias("f")), blocks, distance)
    sizes = materialise(keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("k").alias("k_"), "n"), "buckets", n and n * choices // 2)
    few = sizes.count() <= BROADCAST_ROWS
    met = keyed.join(F.broadcast(sizes) if few else sizes, F.col("k") == F.col("k_")).select("k", "c", "f", "n")
    small = met.filter(F.col("n") <= BUCKET).select("k", "f")
    dealt = small.unionByName(refined(met.filter(F.col("n") > BUCKET), blocks, distance)) if sizes.filter(F.col("n") > BUCKET).limit(1).count() else small

    def linked(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the rows of the group that the last batch may not have ended
        for batch in batches:
            k, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held:
                k, f = np.concatenate([*[h[0] for h in held], k]), np.concatenate([*[h[1] for h in held], f])
            borders = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
            got = [x for s, e in zip(borders, borders[1:], strict=False) for x in group_links(f[s:e].view(np.uint64), distance)]
            held = [(k[borders[-1] :], f[borders[-1] :])] if len(k) else []
            yield link_batch(got)
        if held:
            yield link_batch(group_links(held[0][1].view(np.uint64), distance))

    return dealt.repartition("k").sortWithinPartitions("k").mapInArrow(linked, "a long, b long").distinct()


def group_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(a, b)] if (a ^ b).bit_count() <= distance else []
    return forest(fps, distance) if len(fps) > 1 else []


def link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    got = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])


def components(links: DataFrame, label: str = "links", rounds: int = 100, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is the smallest node of its component.

    Large-star and small-star in turn (MapReduce connected components, 2014): each is a minimum per node, made by partial
    sums, and an equi-join, which adaptive execution can split at a hub.  Each round is a written table; rounds end when the
    links are stars.  ``rounds`` only stops a run that doesn't converge, with an error.  ``rows``: about how many links there are at most.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), label, rows)
    most = 2 * edges.count()  # rows that any step has at most; from the files' footers
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written before they are joined, so that both sides are plain exchanges and a hub's rows can be split.
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "low", most)
        # Large star: a larger neighbour of u goes to the smallest of u's neighbourhood.
        large = materialise(edges.join(low, edges["v"] == low["n"]).select("u", F.col("m").alias("v")).filter("u != v").distinct(), "large", most)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "least", most)
        # Small star: u and its smaller neighbours go to the smallest of them.
        small = large.join(least, large["u"] == least["n"])
        star = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        after = materialise(star, label, most)
        roots = after.select(F.col("v").alias("u")).distinct()
        n = after.groupBy("u").agg(F.count("*").alias("k")).join(roots.withColumn("r", F.lit(1)), "u", "left").agg(F.sum((F.col("k") > 1).cast("int")), F.count("r")).first()
        remove(edges, low, large, least)
        edges = after
        if not (n[0] or 0) and not n[1]:  # every node has one link and no root has any: stars
            own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)
    raise RuntimeError("links don't converge")


def placed_nodes(nodes: DataFrame, n: int, distance: int, blocks: int) -> DataFrame:
    """``nodes`` (at most ``n`` rows; node: distinct fingerprints) with the ``root`` of their component, written."""
    found = components(links_of(nodes, "node", distance, blocks, n), rows=n * comb(blocks, distance))
    return materialise(nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed", n)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS, fp: str = "fp", component: str = "component_id", root: str | None = None, size: int = SHINGLE, seed: int = SEED, keep_text: bool = False
) -> DataFrame:
    """One row for each row of ``df``: its columns (without the text unless ``keep_text``), the fingerprint as a signed long and the component.

    The component is the smallest id that links reach, its own included.  Null, empty and word-less texts
    have fingerprint 0 and link like others.  A text is read whole, however long.  Equal fingerprints are one node, so copies
    cost a count and no pairs; repeated rows are copies.  A null id takes part, but names no component unless all ids of its
    component are null (then null).  An empty table gives no rows; columns named like the outputs are replaced, others are kept.
    """
    replaced = {c.lower() for c in (fp, component, root) if c}
    out = [c for c in df.columns if (c != text or keep_text) and c.lower() not in replaced]
    printed = materialise(add_fingerprint(df.drop(*replaced), text, fp, size, seed).select(*out, fp), "prints")
    n = printed.count()  # from the files' footers
    nodes = materialise(printed.groupBy(F.col(fp).alias("node")).agg(F.min(id_col).alias("least")), "nodes", n)
    placed = placed_nodes(nodes, n, distance, blocks)
    # A root's smallest id, from partial sums; written, so that a large component's rows can be split in the join.
    least = materialise(placed.groupBy("root").agg(F.min("least").alias("first")), "roots", n)
    at, of, to = (fresh(printed, c) for c in ("node_", "root_", "first_"))
    named = materialise(placed.join(least, "root").select(F.col("node").alias(at), F.col("root").alias(of), F.col("first").alias(to)), "named", n)
    return printed.join(named, printed[fp] == named[at]).select(*out, fp, F.col(to).alias(component), *([F.col(of).alias(root)] if root else []))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``df`` with one row of each near-duplicate group: that with the smallest id, a null one last; of rows with that id one stays, by the text's hash.

    Null, empty and word-less texts are one group.  An empty table gives no rows; no column is changed or added.  Rows of a
    group never meet in one task: the smallest (id, hash, row number) comes from partial sums by fingerprint, and then by component.
    """
    mark, tie, fp, lost = (fresh(df, c) for c in ("row_", "tie_", "fp_", "gone_"))
    # Numbered rows are written, as another run of a plan may number them in another way.
    numbered = df.withColumn(mark, F.monotonically_increasing_id()).withColumn(tie, F.xxhash64(text))
    rows = materialise(add_fingerprint(numbered, text, fp, size, seed), "numbered")
    n = rows.count()  # from the files' footers
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(tie).alias("tie"), F.col(mark).alias("row"))
    nodes = materialise(rows.groupBy(F.col(fp).alias("node")).agg(F.min(order).alias("first")), "nodes", n)
    kept = placed_nodes(nodes, n, distance, blocks).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    kept = materialise(kept, "kept", n)
    gone = rows.select(F.col(mark).alias(lost)).join(kept, F.col(lost) == F.col("row"), "left_anti")
    few = n - kept.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, F.col(mark) == F.col(lost), "left_anti").select(*df.columns)


def hex_of(fp: str):
    """The fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
