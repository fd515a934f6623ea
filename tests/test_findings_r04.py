"""The finding of the fourth round."""

from quarry.operators import families

RECORD = "repo_id string, base_models array<string>, card_sha string, architecture string, parameters long, model_type string, downloads long, created string"


def record(name, base=None, sha=None, downloads=0):
    return (name, [base] if base else None, sha, "arch", 1, "t", downloads, "")


def test_families_of_long_chains(spark):
    """a family goes down to its last descendant, however many bases lie between; it failed before, as chains fell apart after seven steps."""
    rows = [record("o/n000", sha="s000", downloads=9)] + [record(f"o/n{i:03}", f"o/n{i - 1:03}", f"s{i:03}") for i in range(1, 40)]
    rows += [record("o/copy", sha="s039", downloads=-1)]  # of the last one: it goes where that goes
    rows += [record("p/e00", "away/root")] + [record(f"p/e{i:02}", f"p/e{i - 1:02}") for i in range(1, 12)]  # the base of the first isn't there
    rows += [record(f"q/c{i}", f"q/c{(i + 1) % 3}") for i in range(3)] + [record("q/t00", "q/c1")] + [record(f"q/t{i:02}", f"q/t{i - 1:02}") for i in range(1, 10)]  # a long way into a cycle
    got = {r.repo_id: r for r in families.resolve(spark.createDataFrame(rows, RECORD)).collect()}
    assert len(got) == len(rows)
    assert {r.family_id for k, r in got.items() if k.startswith("o/")} == {"o--n000"}
    assert {r.canonical_repo_id for k, r in got.items() if k.startswith("o/n")} == {"o/n000"} and got["o/copy"].canonical_repo_id == "o/n039"
    assert {r.family_id for k, r in got.items() if k.startswith("p/")} == {"away--root"}
    assert {k: got[k].family_id for k in ("q/c0", "q/c1", "q/c2")} == {"q/c0": "q--c2", "q/c1": "q--c0", "q/c2": "q--c1"}
    assert {r.family_id for k, r in got.items() if k.startswith("q/t")} == {"q--c0"}


def test_lineage_of_a_cycle_and_a_hub(spark):
    """A cycle beside chains, a root of many nodes and a node without a name: each node is in the answer once, as it was before."""
    parent = {f"x{i}": f"x{(i + 1) % 3}" for i in range(3)} | {f"f{i:03}": "hub" for i in range(300)} | {"hub": None, "g": "f000", None: "hub"}
    edges = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = [(r.node, r.root) for r in families.lineage_roots(edges).collect()]
    assert len(got) == len(parent)
    assert dict(got) == {"x0": "x2", "x1": "x0", "x2": "x1", "hub": "hub", "g": "hub", None: "hub"} | {f"f{i:03}": "hub" for i in range(300)}
