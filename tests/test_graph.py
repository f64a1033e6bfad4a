import random

import pytest
from conftest import DRUGS, ILL, PARK, hops, to_nearest
from pyspark.sql import functions as F

from pathloom.operators import components, distances, graph
from pathloom.operators.components import reach_from_hub
from pathloom.storage import Scratch


def frame(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "gene_a string, gene_b string")


def groups(rows):
    out = {}
    for g, m in rows:
        out.setdefault(g, set()).add(m)
    return out


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("max_levels, few", [(24, 50_000), (2, 50_000), (24, 3)])
def test_components_against_union_find(spark, monkeypatch, max_levels, few):
    """Peeled whole, contracted after two levels, and with every frontier joined by shuffle."""
    monkeypatch.setattr(components, "BROADCAST_ROWS", few)
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(80)]
    pairs = [p for p in pairs if p[0] != p[1]] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    e = frame(spark, set((min(p), max(p)) for p in pairs)).toDF("lo", "hi")
    got = {r["member"]: r["group"] for r in components.connected(e, Scratch(spark, "test"), max_levels).collect()}
    assert got == union_find(pairs)
    assert {r["gene"]: r["component"] for r in graph.components(e.toDF("gene_a", "gene_b")).collect()} == got


def test_reach_from_hub_stops_at_max_levels(spark):
    chain = frame(spark, [(f"c{i}", f"c{i + 1}") for i in range(6)]).toDF("lo", "hi")
    scratch = Scratch(spark, "test")
    nodes, complete = reach_from_hub(chain, scratch, max_levels=2)
    assert not complete and {r["node"] for r in nodes.collect()} == {"c1", "c0", "c2", "c3"}
    nodes, complete = reach_from_hub(chain, scratch)
    assert complete and nodes.count() == 7


def test_largest_component_and_ties(spark):
    e = frame(spark, [("b", "c"), ("x", "y"), ("d", "e"), ("e", "f")])
    assert {tuple(r) for r in graph.largest_component(e).collect()} == {("d", "e"), ("e", "f")}
    e = frame(spark, [("b", "c"), ("x", "y")])
    assert {tuple(r) for r in graph.largest_component(e).collect()} == {("b", "c")}
    assert graph.largest_component(frame(spark, []) if False else e.where("false")).count() == 0
    assert not graph.is_connected(e) and graph.is_connected(frame(spark, [("a", "b")]))
    with pytest.raises(ValueError):
        graph.is_connected(e.where("false"))


def test_merge_edges(spark):
    rows = [(0, "A", "B", "s1", "PPI"), (1, "B", "A", "s2", "complex"), (2, "A", "B", "s1", "PPI"), (3, "C", "C", "s1", "PPI"), (4, None, "A", "s1", "PPI"), (5, "A", "B", None, "x")]
    df = spark.createDataFrame(rows, "seq long, protein_a string, protein_b string, source string, interaction_type string")
    got = graph.merge_edges(graph.harmonize_ends(df)).collect()
    assert [tuple(r) for r in got] == [("A", "B", ["s1", "s2"], 4, "PPI")]


def test_union_needs_sources():
    with pytest.raises(ValueError):
        graph.union_sources({})


def test_sources_of_edges(spark):
    rows = [(0, "A", "B", "s1"), (1, "B", "A", "s2"), (2, "A", "B", "s1"), (3, "C", "C", "s1"), (4, "B", "A", None), (5, "A", "C", "s9")]
    df = spark.createDataFrame(rows, "seq long, protein_a string, protein_b string, source string")
    got = sorted(map(tuple, graph.edge_sources(df).collect()))
    assert got == [("A", "B", 0, "s1"), ("A", "B", 1, "s2"), ("A", "B", 2, "s1"), ("A", "B", 3, None), ("A", "C", 0, "s9")]


def test_union_keeps_order_over_many_partitions(spark):
    one = spark.range(0, 300, numPartitions=150).select(F.lit("A").alias("protein_a"), F.lit("B").alias("protein_b"), F.lit("first").alias("source"), F.concat(F.lit("t"), "id").alias("interaction_type"))
    two = one.withColumn("source", F.lit("second"))
    u = graph.union_sources({"one": one, "two": two})
    assert u.where("source = 'first'").agg(F.max("seq")).first()[0] < u.where("source = 'second'").agg(F.min("seq")).first()[0]
    e = graph.merge_edges(u).first()
    assert (e["sources"], e["n_rows"], e["interaction_type"]) == (["first", "second"], 600, "t0")


def test_build_graph(spark):
    t = spark.createDataFrame([("672", "7157", "s", "PPI"), ("7157", "1956", "s", "PPI"), ("x", "y", "s", "PPI"), ("nowhere", "672", "s", "PPI")], "protein_a string, protein_b string, source string, interaction_type string")
    ids = spark.createDataFrame([("672", "BRCA1"), ("7157", "TP53"), ("1956", "EGFR"), ("x", "X"), ("y", "Y"), ("nowhere", None)], "id string, symbol string")
    got = {(r["gene_a"], r["gene_b"]) for r in graph.build_graph({"s": t}, ids).collect()}
    assert got == {("BRCA1", "TP53"), ("EGFR", "TP53")}


def test_stats(spark, park):
    r = graph.graph_stats(park).first()
    nodes = {g for p in PARK for g in p}
    near = {g: {a if b == g else b for a, b in PARK if g in (a, b)} for g in nodes}
    local = [2 * sum(b in near[a] for a in near[g] for b in near[g] if a < b) / (len(near[g]) * (len(near[g]) - 1)) if len(near[g]) > 1 else 0 for g in nodes]
    assert (r["n_nodes"], r["n_edges"], r["n_components"]) == (len(nodes), len(PARK), 1)
    assert r["avg_degree"] == pytest.approx(2 * len(PARK) / len(nodes)) and r["density"] == pytest.approx(2 * len(PARK) / (len(nodes) * (len(nodes) - 1)))
    assert r["avg_clustering"] == pytest.approx(sum(local) / len(nodes)) and r["diameter"] == max(hops(PARK).values())
    split = graph.graph_stats(park.union(frame(spark, [("Y", "Z")]))).first()
    assert split["n_components"] == 2 and split["diameter"] is None
    assert graph.graph_stats(park.where("false")).first()["n_nodes"] == 0


def test_complex_pairs_by_position(spark):
    m = spark.createDataFrame([("c", 0, "A"), ("c", 1, "B"), ("c", 2, "A")], "complex_id string, pos int, gene string")
    assert sorted(tuple(r) for r in graph.complex_pairs(m).collect()) == [("c", "A", "A"), ("c", "A", "B"), ("c", "B", "A")]


def members(rows):
    out = {}
    for k, g, *_ in rows:
        out.setdefault(k, []).append(g)
    return out


def test_module_distances(spark, park, ill, drugs):
    hop, m = hops(PARK), members(DRUGS)
    want = {d: to_nearest(hop, [g for _, g in ILL], m[d]) for d in m}
    d = distances.module_distances(park, ill.withColumnRenamed("disease", "source"), drugs.selectExpr("drug as target", "gene"))
    assert {r["target"]: r["d"] for r in d.collect()} == pytest.approx(want)
    own = {d: to_nearest(hop, m[d], m[d], itself=False) for d in m}
    modules = drugs.selectExpr("drug as module", "gene")
    pairs = [("amber", "birch"), ("amber", "cedar"), ("amber", "dune"), ("birch", "cedar"), ("amber", "none"), ("none", "nil")]
    s = distances.separations(park, modules, spark.createDataFrame(pairs, "module_a string, module_b string"))
    s = {(r["module_a"], r["module_b"]): r["s_ab"] for r in s.collect()}
    for a, b in pairs[:4]:
        assert s[a, b] == pytest.approx((to_nearest(hop, m[a], m[b]) + to_nearest(hop, m[b], m[a])) / 2 - (own[a] + own[b]) / 2)
    assert s["amber", "none"] == pytest.approx(1000 - (1000 + own["amber"]) / 2) and s["none", "nil"] == 0.0


def test_no_way_counts_infinity(spark):
    e = frame(spark, [("P", "Q"), ("R", "S"), ("X", "Y"), ("Y", "Z")])
    m = spark.createDataFrame([("near", "X"), ("near", "Z"), ("apart", "P"), ("apart", "R")], "module string, gene string")
    assert {r["module"]: r["d"] for r in distances.self_distances(e, m).collect()} == {"near": 2.0, "apart": 1000.0}


def test_search_of_many_modules(spark, park, monkeypatch):
    """More modules than a word has bits, joined by broadcast and by shuffle."""
    rng, nodes = random.Random(3), sorted({g for p in PARK for g in p})
    m = {f"m{i:03d}": rng.sample(nodes, 1 + i % 4) for i in range(150)}
    want = {(k, n): min(hops(PARK)[g, n] for g in gs) for k, gs in m.items() for n in nodes}
    src = spark.createDataFrame([(k, g) for k, gs in m.items() for g in gs] + [("m000", None), (None, "K0"), ("lost", "NOWHERE")], "module string, gene string")
    for few in (50_000, 3):
        monkeypatch.setattr(distances, "BROADCAST_ROWS", few)
        assert {(r["module"], r["node"]): r["hops"] for r in distances.bfs(park, src).collect()} == want


def test_self_distance_against_all_pairs(spark):
    rng = random.Random(5)
    nodes = [f"g{i:02d}" for i in range(40)]
    pairs = {(nodes[i], nodes[rng.randrange(i)]) for i in range(1, 40)} | {tuple(rng.sample(nodes, 2)) for _ in range(15)}
    e = frame(spark, {(min(p), max(p)) for p in pairs})
    mods = [(f"m{k}", g) for k in range(12) for g in rng.sample(nodes, 1 + k % 6)]
    hop = {(r["gene_a"], r["gene_b"]): r["hops"] for r in distances.pairwise_distances(e, spark.createDataFrame([(n,) for n in nodes], "gene string")).collect()}
    want = {}
    for k in range(12):
        gs = [g for m, g in mods if m == f"m{k}"]
        want[f"m{k}"] = sum(min(hop[a, b] for b in gs if b != a) for a in gs) / len(gs) if len(gs) > 1 else 0.0
    got = {r["module"]: r["d"] for r in distances.self_distances(e, spark.createDataFrame(mods, "module string, gene string")).collect()}
    assert got == pytest.approx(want)
