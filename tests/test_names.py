import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from pathloom.operators import distances, evaluation, nulls, numbering, scoring


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Tables of a ring of 24 genes with chords; every other name is in no reference list."""
    d = tmp_path_factory.mktemp("small")
    genes = [f"G{i:02d}" for i in range(24)]
    ends = [(genes[i], genes[(i + 1) % 24]) for i in range(24)] + [(genes[0], genes[i]) for i in (5, 9, 14)]
    tables = {
        "interactions": [(i, a, b, "s", "t", None) for i, (a, b) in enumerate(ends)],
        "creeds_signatures": [(i, n, x, g) for i, (n, x, g) in enumerate([("Asthma ", "up", "G01"), ("asthma", "down", "G03"), ("astma", "up", "G05"), ("wheezing", "down", "G08"), ("wheezing", "up", "G09"), ("wheezing", "up", "G01"), (" ", "up", "G02"), (None, "up", "G02")])],
        "disease_ref": [(1, "asthma", "wheezing")],
        "compound_ref": [(1, "aspirin", "asa")],
        "lincs_metadata": [(0, "s1", "Aspirin"), (2, "s2", "asa"), (3, "s3", "aspirn hcl"), (4, "s4", "  "), (5, "s5", None)],
        "lincs_values": [(i, f"s{1 + i % 5}", genes[(7 * i) % 24], float(i % 11) - 5) for i in range(60)],
    }
    columns = {"interactions": "interaction_id protein_a protein_b source interaction_type complex_id", "creeds_signatures": "record_id disease_name direction gene_symbol", "disease_ref": "disease_id disease synonyms", "compound_ref": "compound_id compound synonyms", "lincs_metadata": "row_id sig_id pert_iname", "lincs_values": "value_id sig_id gene fold_change"}
    for t, rows in tables.items():
        df = pd.DataFrame(rows, columns=columns[t].split())
        (df.astype({"complex_id": "string"}) if t == "interactions" else df).to_parquet(d / f"{t}.parquet")
    return str(d)


def run(spark, name, sf):
    return entry.queries()[name](spark, sf).toPandas()


def test_every_name_counts(spark, small):
    got = {(r.disease, r.gene) for r in run(spark, "disease_modules", small).itertuples()}
    assert got == {("asthma", "G01"), ("asthma", "G03"), ("astma", "G05"), ("wheezing", "G08"), ("wheezing", "G09"), ("wheezing", "G01")}
    v = pd.read_parquet(f"{small}/lincs_values.parquet").merge(pd.DataFrame({"sig_id": ["s1", "s2", "s3"], "compound": ["aspirin", "asa", "aspirn hcl"]}))
    want = v.groupby(["compound", "gene"]).fold_change.median().to_dict()
    assert {(r.compound, r.gene): r.fold_change for r in run(spark, "median_profile", small).itertuples()} == want
    assert set(run(spark, "drug_modules", small).drug) == {"aspirin", "asa", "aspirn hcl"}
    assert set(run(spark, "jaccard", small).module_j) == {"astma", "wheezing"}  # "asthma" is asked for, as record 0


def test_all_draws(spark, small):
    n = run(spark, "null_modules", small)
    assert set(n.draw) == set(range(1000)) and n.module.nunique() == 3
    z = run(spark, "null_zscore", small)
    assert len(z) == 3 * 3 and all(abs(p * 1000 - round(p * 1000)) < 1e-6 for p in z.p_value) and any(round(p * 1000) % 100 for p in z.p_value)
    assert len(run(spark, "predict_all", small)) == 3 * 2  # "aspirin" is asked for, as row 0


def test_ensemble_equals_draw_rows(spark, park, ill, drugs, monkeypatch):
    monkeypatch.setattr(nulls, "CELLS", 50)
    apart = park.union(spark.createDataFrame([("ALONE0", "ALONE1")], park.schema))
    q = ill.union(spark.createDataFrame([("r", "K6"), ("r", "ALONE0"), ("s", "NOWHERE"), ("t", "ALONE1")], ill.schema))
    x = drugs.select("drug", "gene")
    obs = distances.module_distances(apart, q.withColumnRenamed("disease", "source"), x.withColumnRenamed("drug", "target")).withColumnsRenamed({"source": "disease", "target": "drug"})
    drawn = nulls.null_modules(apart, x.withColumnRenamed("drug", "module"), 40).withColumnRenamed("module", "drug")
    want = {(r["disease"], r["drug"]): r for r in nulls.zscores(obs, nulls.null_distances(apart, q, drawn)).collect()}
    got = {(r["disease"], r["drug"]): r for r in scoring.proximity(apart, q, x, 40).collect()}
    assert set(got) == set(want) and len(got) >= 8
    for k, r in want.items():
        assert [got[k][c] for c in ("observed", "null_mean", "null_std", "z", "p_value")] == pytest.approx([r[c] for c in ("observed", "null_mean", "null_std", "z", "p_value")])


@pytest.mark.parametrize("mode", ["column", "row", "symmetric"])
def test_walks_converge(spark, small, mode):
    i = pd.read_parquet(f"{small}/interactions.parquet")
    genes = sorted({*i.protein_a, *i.protein_b})
    a = np.zeros((24, 24))
    for x, y in zip(i.protein_a, i.protein_b):
        a[genes.index(x), genes.index(y)] = a[genes.index(y), genes.index(x)] = 1
    d = a.sum(0)
    w = {"column": a / d, "row": a / d[:, None], "symmetric": a / np.sqrt(d * d[:, None])}[mode]
    f = np.zeros(24)
    f[genes.index("G05")] = 1
    want = np.linalg.solve(np.eye(24) - 0.5 * w, 0.5 * f)
    s = run(spark, f"rwr_{mode}", small).query("module == 'astma'").set_index("gene").score
    assert len(s) == 24 and s[genes].to_numpy() == pytest.approx(want, abs=4e-6)
    if mode == "column":
        t = run(spark, "rwr_topk", small).query("module == 'astma'").set_index("gene")["rank"]
        assert len(t) == 24 and [t[g] for g in genes] == list(s[genes].rank(ascending=False, method="first").astype(int))


def test_median_in_one_task_per_range(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(x)) for k, n in (("a", 301), ("b", 40), (None, 7), ("one", 1)) for x in rng.integers(-9, 60, n)] + [("a", float("nan")), ("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    m = evaluation.medians(df, ["k"], "v")
    want = {k: float(np.median([v for kk, v in rows if kk == k and v is not None and v == v])) for k in ("a", "b", None, "one")}
    assert {r["k"]: r["median"] for r in m.collect()} == want
    assert "median(" not in m._jdf.queryExecution().optimizedPlan().toString() and "percentile(" not in m._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [50_000, 10])
def test_stratum_is_numbered(spark, monkeypatch, few):
    monkeypatch.setattr(numbering, "BROADCAST_ROWS", few)
    genes = [f"G{i:04d}" for i in range(900)]
    b = spark.createDataFrame([(g, 1, 0 if i % 9 else 3) for i, g in enumerate(genes)], "gene string, degree int, bin int").repartition(5)
    got = nulls.numbered(b).toPandas()
    for k in (0, 3):
        want = [g for i, g in enumerate(genes) if (0 if i % 9 else 3) == k]
        assert list(got[got.bin == k].sort_values("idx").pick) == want and sorted(got[got.bin == k].idx) == list(range(len(want)))
