"""Distances of modules in tasks against the joins that larger graphs get."""

import random

import pytest

from pathloom.operators import compact, distances, nearest


def graph_and_modules(spark, n=60, seed=1):
    """A graph of two parts and some far ends, modules in one part or both, and what is no gene or no name."""
    rng = random.Random(seed)
    pairs = {(f"g{rng.randrange(max(0, i - 6), i):03d}", f"g{i:03d}") for i in range(1, n)} | {(f"h{i}", f"h{i + 1}") for i in range(5)}
    nodes = sorted({x for p in pairs for x in p})
    m = [(f"m{i:03d}", g) for i in range(130) for g in rng.sample(nodes, 1 + i % 5)]
    m += [("far", "h0"), ("far", "h5"), ("lost", "NOWHERE"), ("m003", None), (None, "g001")]
    return spark.createDataFrame(sorted(pairs), "gene_a string, gene_b string"), spark.createDataFrame(m, "module string, gene string")


@pytest.mark.parametrize("cells", [4_000_000, 7])
def test_separations_in_tasks(spark, monkeypatch, cells):
    monkeypatch.setattr(nearest, "CELLS", cells)
    e, m = graph_and_modules(spark)
    names = [r[0] for r in m.where("module is not null").select("module").distinct().orderBy("module").collect()]
    pairs = spark.createDataFrame([(a, b) for a in ("far", "lost", "m003", "m119") for b in [*names, "none"]], "module_a string, module_b string")
    rows = lambda d: {(r["module_a"], r["module_b"]): r["s_ab"] for r in d.collect()}
    with monkeypatch.context() as c:
        c.setattr(distances, "search", None)  # nothing is joined
        got = rows(distances.separations(e, m, pairs))
    monkeypatch.setattr(nearest, "MOST_CELLS", 0)
    assert got == pytest.approx(rows(distances.separations(e, m, pairs))) and len(got) == 4 * (len(names) + 1)


@pytest.mark.parametrize("cells", [4_000_000, 7])
def test_both_ways_in_tasks(spark, monkeypatch, cells):
    monkeypatch.setattr(nearest, "CELLS", cells)
    e, m = graph_and_modules(spark, 30, 2)
    q, x = m.withColumnRenamed("module", "disease"), m.where("module > 'm100' or module is null or module = 'far'").withColumnRenamed("module", "drug")
    one = lambda d: {(r["source"], r["target"]): r["d"] for r in d.collect()}
    source, target = q.withColumnRenamed("disease", "source"), x.withColumnRenamed("drug", "target")
    with monkeypatch.context() as c:
        c.setattr(distances, "search", None)  # nothing is joined
        got = {(r["disease"], r["drug"]): (r["d_qx"], r["d_xq"]) for r in distances.both_ways(e, q, x, 6).collect()}
        there = one(distances.module_distances(e, source, target, digits=6))
        back = one(distances.module_distances(e, x.withColumnRenamed("drug", "source"), q.withColumnRenamed("disease", "target"), digits=6))
    assert got == {(a, b): (there[a, b], back[b, a]) for a, b in there}
    monkeypatch.setattr(compact, "MOST_EDGES", -1)
    assert there == pytest.approx(one(distances.module_distances(e, source, target, digits=6))) and ("far", "far") in there


def test_search_in_tasks(spark, monkeypatch):
    e, m = graph_and_modules(spark, 30, 3)
    rows = lambda d: {(r["module"], r["node"], r["hops"]) for r in d.collect()}
    with monkeypatch.context() as c:
        c.setattr(distances, "search", None)
        found = distances.bfs(e, m)
        got = rows(found)
    monkeypatch.setattr(compact, "MOST_EDGES", -1)
    want = distances.bfs(e, m)
    assert got == rows(want) and [c for c, t in found.dtypes] == ["module", "node", "hops"]


def test_rows_of_a_node_come_together(spark):
    e, m = graph_and_modules(spark, 60, 4)
    got = distances.bfs(e, m).collect()
    runs = 1 + sum(a["node"] != b["node"] for a, b in zip(got, got[1:]))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert runs <= tasks * (len({r["node"] for r in got}) + 1) < len(got) / 10
