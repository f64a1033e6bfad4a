import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import CHANGES, DRUGS, PARK

from pathloom.functions.columns import exact_mean, zscore
from pathloom.operators import correlation, evaluation, figures, idmap, nulls, profiles, propagation, scoring, similarity


@pytest.mark.parametrize(
    "a, b, s, want",
    [
        (-1.0, -1.0, -0.1, "overlapping_exposure"),
        (-1.0, -1.0, 0.0, "complementary_exposure"),
        (-1.0, 1.0, -0.1, "indirect_exposure"),
        (1.0, -1.0, 0.1, "single_exposure"),
        (1.0, 0.0, -0.1, "non_exposure"),
        (0.0, 1.0, 0.1, "independent_action"),
        (float("nan"), -1.0, float("nan"), "indirect_exposure"),
        (None, None, None, "non_exposure"),
    ],
)
def test_classes(spark, a, b, s, want):
    df = spark.createDataFrame([(a, b, s)], "a double, b double, s double")
    r = df.select(scoring.classify(F.col("a"), F.col("b"), F.col("s")).alias("c")).select("c", scoring.t_score(F.col("c")).alias("t")).first()
    assert r["c"] == want and r["t"] == (2.0 if want == "complementary_exposure" else 0.0)


def test_zscore_without_spread(spark):
    df = spark.createDataFrame([(5.0, 10.0, 0.0), (5.0, None, None), (5.0, 10.0, 2.5)], "o double, m double, s double")
    assert [r[0] for r in df.select(zscore(F.col("o"), F.col("m"), F.col("s"))).collect()] == [0.0, 0.0, -2.0]


def test_mean_is_exact(spark):
    df = spark.createDataFrame([("a", 0.868), ("a", 0.869125), ("b", -0.0000005), ("b", -0.0000025), ("c", None)], "k string, v double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(exact_mean(F.col("v")).alias("m")).collect()}
    assert got == {"a": 0.868563, "b": -0.000001, "c": None}


def test_degree_bins(park):
    degree = {}
    for p in PARK:
        for g in p:
            degree[g] = degree.get(g, 0) + 1
    cuts = np.percentile(list(degree.values()), np.linspace(0, 100, 21))
    want = {d: next((i for i in range(20) if cuts[i] <= d < cuts[i + 1]), 19) for d in set(degree.values())}
    assert {r["degree"]: r["bin"] for r in nulls.degree_bins(park).collect()} == want


def test_null_modules(spark, park, drugs):
    m = drugs.selectExpr("drug as module", "gene").union(spark.createDataFrame([("amber", "NOT_IN_NETWORK")], "module string, gene string"))
    got = nulls.null_modules(park, m, 50)
    again = nulls.null_modules(park.repartition(7), m.repartition(5), 50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    sizes = got.groupBy("module", "draw").count().collect()
    assert len(sizes) == 4 * 50 and all(1 <= r["count"] <= 3 for r in sizes)
    assert nulls.null_modules(park, m, 0).count() == 0


def predictor(park, ill, drugs, changes, draws=20):
    return scoring.Predictor(park, draws).set_disease_modules(ill).set_drug_modules(drugs).set_disease_signatures(changes)


def test_predict(spark, park, ill, drugs, changes):
    p = predictor(park, ill, drugs, changes)
    rows = p.predict().collect()
    assert len(rows) == 6 and len({(r["drug_a"], r["drug_b"]) for r in rows}) == 6
    for r in rows:
        assert all(r[c] is not None and not math.isnan(r[c]) for c in ("tqab", "pqab", "cqab", "prediction_score"))
        assert r["prediction_score"] == pytest.approx(r["tqab"] + r["pqab"] + r["cqab"], abs=1e-12)
        assert r["tqab"] == (2.0 if r["topology_class"] == "complementary_exposure" else 0.0)
    extra = drugs.union(spark.createDataFrame([("amber", "NOT_IN_NETWORK", "up")], drugs.schema))
    t = {(r["drug_a"], r["drug_b"]): r["prediction_score"] for r in rows}
    again = predictor(park, ill, extra.repartition(3), changes).predict().collect()
    assert {(r["drug_a"], r["drug_b"]): r["prediction_score"] for r in again} == pytest.approx(t)
    with pytest.raises(ValueError):
        p.predict(["nothing"])
    with pytest.raises(ValueError):
        scoring.Predictor(park).predict()


def test_pairs_of_asked_drugs(spark, park, ill, drugs, changes):
    p = predictor(park, ill, drugs, changes)
    whole = {(r["drug_a"], r["drug_b"]): r["prediction_score"] for r in p.predict().collect()}
    asked = spark.createDataFrame([("cedar",), ("birch",), ("unknown",)], "drug string")
    got = {(r["drug_a"], r["drug_b"]): r["prediction_score"] for r in p.predict(asked=asked).collect()}
    assert got == pytest.approx({k: v for k, v in whole.items() if {"cedar", "birch"} & set(k)}) and len(got) == 5


def test_reversal(changes, drugs):
    import pandas as pd

    fold = {g: v for _, g, v in CHANGES}
    want = {}
    for d in {d for d, *_ in DRUGS}:
        own = [(fold[g], 1.0 if way == "up" else -1.0) for n, g, way in DRUGS if n == d]
        r = pd.DataFrame(own).rank()
        want[d] = -float(r[0].corr(r[1])) if len(own) > 2 else 0.0
    assert {r["drug"]: r["c"] for r in correlation.reversal(changes, drugs).collect()} == pytest.approx(want)


def test_correlation_edges(spark):
    df = spark.createDataFrame([("two", 1.0, 2.0), ("two", 2.0, 3.0), ("flat", 1.0, 1.0), ("flat", 2.0, 1.0), ("flat", 3.0, 1.0), ("tie", 1.0, 1.0), ("tie", 1.0, 2.0), ("tie", 2.0, 3.0)], "k string, a double, b double")
    got = {r["k"]: r["correlation"] for r in correlation.correlate(df, ["k"], "a", "b").collect()}
    assert got["two"] == 0.0 and got["flat"] == 0.0 and got["tie"] == pytest.approx(0.8660254)
    with pytest.raises(ValueError):
        correlation.correlate(df, ["k"], "a", "b", "kendall")


def test_top_fraction(spark):
    p = spark.createDataFrame([("c", f"g{i}", float(9 - i)) for i in range(10)] + [("one", "x", 1.0), ("c", "bad", float("nan"))], "compound string, gene string, fold_change double")
    got = profiles.top_fraction(p, top_pct=0.2).collect()
    by = {(r["compound"], r["direction"]): set() for r in got}
    for r in got:
        by[r["compound"], r["direction"]].add(r["gene"])
    assert by == {("c", "up"): {"g0", "g1"}, ("c", "down"): {"g8", "g9"}, ("one", "up"): {"x"}, ("one", "down"): {"x"}}
    for bad in (0.0, -0.1, 1.5):
        with pytest.raises(ValueError):
            profiles.top_fraction(p, top_pct=bad)


def test_metadata_keeps_last(spark):
    v = spark.createDataFrame([("s", "g", 1.0), ("orphan", "g", 2.0)], "sig_id string, gene string, fold_change double")
    m = spark.createDataFrame([(1, "s", "old"), (2, "s", "new"), (3, None, "x")], "row_id int, sig_id string, pert_iname string")
    assert [r["compound"] for r in profiles.join_metadata(v, m).collect()] == ["new"]
    assert [tuple(r) for r in profiles.unmatched(v, m).collect()] == [("orphan", 1)]


def test_areas_against_definition(spark):
    rng = np.random.default_rng(2)
    rows = [("d" if i % 3 else "e", float(rng.integers(0, 12)), int(rng.integers(0, 2))) for i in range(120)] + [("one", 1.0, 1), ("one", 2.0, 1), ("d", float("nan"), 1), ("d", None, 0)]
    got = {r["k"]: r for r in evaluation.areas(spark.createDataFrame(rows, "k string, score double, label int"), ["k"]).collect()}
    for k in ("d", "e"):
        s = [(x, y) for kk, x, y in rows if kk == k and x is not None and x == x]
        pos, neg = [x for x, y in s if y], [x for x, y in s if not y]
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
        ap = sum(sum(1 for x, y in s if y and x == t) * sum(1 for x, y in s if y and x >= t) / sum(1 for x, _ in s if x >= t) for t in {x for x, _ in s}) / len(pos)
        assert got[k]["auc_roc"] == pytest.approx(auc) and got[k]["auc_pr"] == pytest.approx(ap)
    assert got["one"]["auc_roc"] is None and got["one"]["auc_pr"] is None


def test_sets_and_vectors(spark):
    m = spark.createDataFrame([("z", "A"), ("z", "B"), ("a", "B"), ("a", "C"), ("m", "X"), ("o", None), ("p", None)], "module string, gene string")
    j = {(r[0], r[1]): r[2] for r in similarity.set_similarity(m, "jaccard").collect()}
    assert j["a", "z"] == pytest.approx(1 / 3) and j["a", "m"] == 0.0 and j["o", "p"] == 1.0 and j["a", "o"] == 0.0
    o = {(r[0], r[1]): r[2] for r in similarity.set_similarity(m, "overlap").collect()}
    assert o["a", "z"] == 0.5 and o["o", "p"] == 1.0 and o["a", "o"] == 0.0
    with pytest.raises(ValueError):
        similarity.set_similarity(m, "dice")
    f = spark.createDataFrame([("a", [1, 1, 0, 0]), ("b", [1, 0, 1, 0]), ("c", [0, 0, 1, 1]), ("x", [0] * 4), ("y", [0] * 4)], "mol string, bits array<int>")
    t = {(r["i"], r["j"]): r["sim"] for r in similarity.drug_similarity(f).collect()}
    assert t["a", "b"] == pytest.approx(1 / 3) and t["a", "c"] == 0.0 and t["x", "y"] == 0.0
    c = {(r["i"], r["j"]): r["sim"] for r in similarity.drug_similarity(f, "cosine").collect()}
    assert c["a", "b"] == pytest.approx(0.5) and c["a", "x"] == 0.0
    for bad in ([("a", [1, 2])], [("a", [1]), ("b", [1, 0])]):
        with pytest.raises(ValueError):
            similarity.drug_similarity(spark.createDataFrame(bad, "mol string, bits array<int>"))


def test_walk_on_path(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(4)], "gene_a string, gene_b string")
    seeds = spark.createDataFrame([("m", "0", 1.0), ("m", "4", 0.5), ("m", "nowhere", 9.0)], "module string, gene string, weight double")
    got = {r["gene"]: r["score"] for r in propagation.walk(e, seeds).collect()}
    assert [got[str(i)] for i in range(5)] == pytest.approx([0.3869046, 0.2142860, 0.0833330, 0.1190479, 0.1964284], abs=1e-6)
    with pytest.raises(ValueError):
        propagation.operator(e, "diagonal")


def test_both_ways_of_walking_agree(spark, monkeypatch, park):
    fixed = 3
    genes = sorted({g for p in PARK for g in p})
    seeds = [(f"m{i:02d}", genes[(i * k) % len(genes)], float(k)) for i in range(41) for k in (1, 2, 5)] + [(None, "K0", 1.0), ("none", "nowhere", 1.0), ("m03", None, 1.0)]
    seeds = spark.createDataFrame(seeds, "module string, gene string, weight double")
    e = park.withColumn("weight", F.length("gene_a") * 0.5).union(spark.createDataFrame([("K0", None, 3.0), (None, "K1", 1.0), ("Q1", "Q2", None)], "gene_a string, gene_b string, weight double"))
    got = []
    for sent in (1_000_000, 0):
        monkeypatch.setattr(propagation, "SENT_EDGES", sent)
        got.append({(r["module"], r["gene"]): r["score"] for r in propagation.walk(e, seeds, fixed=fixed).collect()})
    assert got[0].keys() == got[1].keys() and len({m for m, _ in got[0]}) == 41
    assert all(got[0][k] == pytest.approx(got[1][k], rel=1e-9) for k in got[0])
    empty = propagation.walk(e, seeds.limit(0), fixed=fixed)
    assert empty.columns == ["module", "gene", "score"] and empty.count() == 0
    monkeypatch.setattr(propagation, "SENT_EDGES", 1_000_000)
    assert propagation.walk(e.limit(0), seeds, fixed=fixed).count() == 0


def test_histogram_and_stack(spark):
    d = spark.createDataFrame([(float(i),) for i in (0, 1, 2, 10)] + [(float("nan"),), (None,)], "v double")
    h = {r["bin"]: r["n"] for r in figures.histogram(d, "v", 5).collect()}
    assert h == {0: 2, 1: 1, 4: 1}
    p = spark.createDataFrame([("a", "b", 2.0, -1.0, 0.5, 1.5), ("a", "c", 0.0, -1.0, -0.5, -1.5)], "drug_a string, drug_b string, tqab double, pqab double, cqab double, prediction_score double")
    s = figures.stacked_top(p, 5).collect()
    assert [(r["rank"], r["component"], r["base"], r["width"]) for r in s][:3] == [(1, "tqab", 0.0, 2.0), (1, "pqab", 0.0, -1.0), (1, "cqab", 2.0, 0.5)]
    assert [(r["component"], r["base"]) for r in s][3:] == [("tqab", 0.0), ("pqab", 0.0), ("cqab", -1.0)]
    with pytest.raises(KeyError):
        figures.stacked_top(p.drop("tqab"))


def test_curves_have_ends_and_corners(spark):
    rows = [("a", 5.0, 1), ("a", 4.0, 1), ("a", 3.0, 1), ("a", 2.0, 0), ("a", 1.0, 0), ("a", 0.5, 1), ("one", 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, score double, label int")
    r = sorted((x["threshold"], x["fpr"], x["tpr"]) for x in evaluation.roc_curve(df, ["k"]).where("k = 'a'").collect())
    assert r == [(0.5, 1.0, 1.0), (1.0, 1.0, 0.75), (3.0, 0.0, 0.75), (float("inf"), 0.0, 0.0)]
    p = [(x["threshold"], x["precision"], x["recall"]) for x in evaluation.pr_curve(df, ["k"]).where("k = 'a'").orderBy("threshold").collect()]
    assert p[0] == (None, 1.0, 0.0) and p[-1] == (5.0, 1.0, 0.25) and len(p) == 7


def test_degree_histogram_and_comparison(spark):
    d = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 100)], "gene string, degree long")
    log = sorted(map(tuple, figures.degree_histogram(d).collect()))
    assert [(r[0], r[3]) for r in log] == [(0, 2), (48, 1)] and log[0][1] == pytest.approx(1.0)
    assert sum(r["n"] for r in figures.degree_histogram(d, log=False).collect()) == 4
    with pytest.raises(ValueError):
        figures.degree_histogram(d.where("false"), log=False)
    with pytest.raises(ValueError):
        figures.degree_histogram(d.where("degree = 0"))
    e = spark.createDataFrame([("asthma", 0.5)], "disease string, auc_roc double")
    with pytest.raises(KeyError, match="auc_pr.*asthma"):
        figures.auc_comparison(e)
    with pytest.raises(ValueError):
        figures.auc_comparison(e.withColumn("auc_pr", F.lit(1.0)).where("false"))


def test_entrez_and_shortcut(spark):
    s = spark.createDataFrame([(0, "TP53"), (1, "NEW"), (2, "LOST"), (3, None)], "pos int, symbol string")
    h = spark.createDataFrame([(0, "TP53", 1), (1, "TP53", 7157)], "row int, symbol string, entrez_id long")
    hits = spark.createDataFrame([("NEW", 0, None), ("NEW", 1, 9), ("NEW", 2, 8)], "symbol string, hit_rank int, entrez_id long")
    got = {r["pos"]: r["entrez_id"] for r in idmap.to_entrez(s, h, lambda m: m.join(hits, "symbol")).collect()}
    assert got == {0: 7157, 1: 9, 2: None, 3: None}
    ids, m = s.withColumnRenamed("symbol", "id"), spark.createDataFrame([("NEW", "auto", None)], "id string, from_type string, symbol string")
    got = {r["pos"]: r["symbol"] for r in idmap.to_symbols(ids, m, hgnc=h).collect()}
    assert got == {0: "TP53", 1: None, 2: None, 3: None}


def test_idmap(spark):
    m = spark.createDataFrame([("672", "auto", "BRCA1"), ("X", "auto", None)], "id string, from_type string, symbol string")
    ids = spark.createDataFrame([(0, "672"), (1, "X"), (2, "AMBIG"), (3, "672")], "pos int, id string")
    asked = []

    def lookup(missing):
        asked.append([r["id"] for r in missing.collect()])
        return spark.createDataFrame([("AMBIG", "auto", 0, None), ("AMBIG", "auto", 1, "BEST"), ("AMBIG", "auto", 2, "WORSE")], "id string, from_type string, hit_rank int, symbol string")

    full = idmap.resolve(ids, m, lookup)
    assert asked == [["AMBIG"]]
    assert [r["symbol"] for r in idmap.to_symbols(ids, full).orderBy("pos").collect()] == ["BRCA1", None, "BEST", "BRCA1"]
    assert [tuple(r) for r in idmap.harmonize(ids, full).orderBy("pos").collect()] == [(0, "BRCA1"), (2, "BEST")]
    with pytest.raises(ValueError):
        idmap.to_symbols(ids, m, "other")
