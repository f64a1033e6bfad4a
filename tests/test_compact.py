"""Graphs that a task holds against the joins that larger graphs get."""

import random

import numpy as np
import pytest
from conftest import hops

from pathloom.operators import compact, distances, graph, propagation


def frame(spark, pairs):
    return spark.createDataFrame(sorted({(min(p), max(p)) for p in pairs}), "gene_a string, gene_b string")


def tree(n, back, seed):
    rng = random.Random(seed)
    return {(f"g{i:03d}", f"g{rng.randrange(max(0, i - back), i):03d}") for i in range(1, n)}


@pytest.mark.parametrize("pairs, cells", [(tree(90, 40, 1), 3_000_000), (tree(80, 1, 2), 10), (tree(40, 3, 3) | {("x", "y"), ("y", "z")}, 200), ({("a", "b")}, 1)])
def test_eccentricity_of_a_graph_in_a_task(spark, monkeypatch, pairs, cells):
    monkeypatch.setattr(compact, "CELLS", cells)
    monkeypatch.setattr(distances, "search", None)  # nothing is joined
    want = {}
    for (a, _), d in hops(pairs).items():
        want[a] = max(want.get(a, 0), d)
    assert {r["gene"]: r["eccentricity"] for r in distances.eccentricity(frame(spark, pairs)).collect()} == want


@pytest.mark.parametrize("pairs", [tree(90, 40, 1), tree(200, 1, 2), tree(150, 3, 3), {("a", "b")}, {(f"c{i:03d}", f"c{(i + 1) % 151:03d}") for i in range(151)}])
def test_diameter_without_every_eccentricity(spark, monkeypatch, pairs):
    monkeypatch.setattr(distances, "eccentricity", None)
    assert graph.graph_stats(frame(spark, pairs)).first()["diameter"] == max(hops(pairs).values())


def test_largest_component_is_told_apart_in_a_task(spark, monkeypatch):
    rng = random.Random(5)
    cases = [{tuple(sorted((f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}"))) for _ in range(n)} for n in (15, 30, 45)]
    cases += [tree(80, 1, 2) | {("x", "y")}, {("b", "c"), ("x", "y")}, {("a", None), ("x", "y"), (None, "y")}, {("a", "a"), ("b", "b")}, set()]
    cases = [spark.createDataFrame(sorted(c, key=str), "gene_a string, gene_b string").coalesce(1) for c in cases]
    rows = lambda d: {(r["gene_a"], r["gene_b"]) for r in d.collect() if r["gene_b"]}
    with monkeypatch.context() as m:
        m.setattr(graph, "reach_from_hub", None)  # nothing is joined
        got = [rows(graph.largest_component(c)) for c in cases]
    kept = graph.largest_component(cases[1].selectExpr("1 as n", "gene_b", "gene_a"))
    assert kept.columns == ["n", "gene_b", "gene_a"] and rows(kept) == got[1]
    monkeypatch.setattr(compact, "MOST_EDGES", -1)
    # A row that lacks an end joins nothing, so the join has nothing to say on that case.
    assert got[5] == {("x", "y")} and [g for i, g in enumerate(got) if i != 5] == [rows(graph.largest_component(c)) for i, c in enumerate(cases) if i != 5]


@pytest.mark.parametrize("few, step", [(64, 2048), (1, 3)])
def test_sweep(tmp_path, monkeypatch, few, step):
    import pyarrow as pa

    from pathloom.storage import write_shared

    monkeypatch.setattr(compact, "FEW", few)
    monkeypatch.setattr(compact, "STEP", step)
    a = np.triu(np.random.default_rng(3).random((90, 90)) < 0.1, 1)
    a[0, 1:] = True
    a = a | a.T
    order = np.argsort(-a.sum(0), kind="stable")
    a = a[order][:, order]
    write_shared(f"{tmp_path}/g/nodes", pa.table({"gene": [f"g{i}" for i in range(90)], "degree": a.sum(0)}))
    write_shared(f"{tmp_path}/g/near", pa.table({"near": np.nonzero(a)[1].astype(np.int32)}))
    g = compact.Graph(f"{tmp_path}/g")
    f = np.random.default_rng(4).random((90, 5))
    assert g.sweep(f, np.add, np.empty_like(f)) == pytest.approx(a.astype(float) @ f)
    triangles = np.diag(np.linalg.matrix_power(a.astype(np.int64), 3)) // 2
    assert (sum(g.triangles(p, 3) for p in range(3)) == triangles).all()


@pytest.mark.parametrize("ways", [1, 50])
def test_stats_equal_those_of_the_joins(spark, monkeypatch, ways):
    rng = random.Random(ways)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(250 if ways > 1 else 30)}
    e = frame(spark, {(f"g{a:02d}", f"g{b:02d}") for a, b in pairs})
    monkeypatch.setattr(compact, "WAYS", ways)
    got = graph.graph_stats(e)
    empty = graph.graph_stats(e.limit(0))
    monkeypatch.setattr(compact, "MOST_EDGES", -1)
    want = graph.graph_stats(e)
    assert got.dtypes == want.dtypes and got.first().asDict() == pytest.approx(want.first().asDict())
    assert empty.fillna(0).first() == graph.graph_stats(e.limit(0)).fillna(0).first()  # an empty sum is NULL there


@pytest.mark.parametrize("mode", propagation.MODES)
def test_walks_over_a_graph_in_a_task(spark, monkeypatch, park, mode):
    genes = sorted({g for e in park.collect() for g in e})
    seeds = [(f"m{i:02d}", genes[(i * k) % len(genes)], float(k)) for i in range(41) for k in (1, 2, 5)] + [("none", "nowhere", 1.0), ("m03", None, 1.0)]
    seeds = spark.createDataFrame(seeds, "module string, gene string, weight double")
    rows = lambda d: {tuple(r)[:-1]: r["score"] for r in d.collect()}
    monkeypatch.setattr(compact, "CELLS", 7 * len(genes))
    monkeypatch.setattr(propagation, "SENT_EDGES", 0)  # the joins would split the graph
    got, first, mass = rows(propagation.walk(park, seeds, mode)), propagation.walk_best(park, seeds, 5, 9, mode), propagation.walk_mass(park, seeds, mode)
    first = {(r["module"], r["gene"], r["rank"]) for r in propagation.top_genes(first, 5).collect()}
    mass = {r["module"]: (r["n_genes"], r["mass"]) for r in mass.collect()}
    assert propagation.walk(park, seeds.limit(0), mode).count() == 0 == propagation.walk(park.limit(0), seeds, mode).count()
    monkeypatch.setattr(propagation, "SENT_EDGES", 1_000_000)
    monkeypatch.setattr(compact, "MOST_EDGES", -1)
    whole = propagation.walk(park, seeds, mode).localCheckpoint()
    want = rows(whole)
    assert got.keys() == want.keys() and len({m for m, _ in got}) == 41
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    at = lambda m: [s for (k, _), s in want.items() if k == m]
    assert mass == {m: (len(at(m)), pytest.approx(sum(at(m)))) for m in {m for m, _ in want}}
    assert len(first) == 41 * 5 and all(sorted(at(m))[-r] == pytest.approx(want[m, g], rel=1e-9) for m, g, r in first)


def test_keys_spread_over_tasks(spark, park):
    """Also when the rows come from a join on the key, whose few partitions Spark would merge."""
    import pyarrow as pa

    def where(graph, t):
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()] * len(t), "module": t["module"].to_pylist()})

    seeds = spark.createDataFrame([(f"m{i % 40}", e["gene_a"]) for i, e in enumerate(park.collect() * 20)], "module string, gene string")
    got = compact.compact(park).keyed(propagation.seed_vectors(park, seeds), "module", 4, where, "task long, module string").distinct().collect()
    assert len(got) == 40 and len({r["task"] for r in got}) == 4
