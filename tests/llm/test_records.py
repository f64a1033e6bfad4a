import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.llm import canonical, components, merkle, quantiles, top_n
from pathloom.storage import Scratch

INTER = "interaction_id long, protein_a string, protein_b string, source string, digest string, record string"


def test_merkle_copies(spark):
    rows = [
        (1, "Abc-1", "X Y", "Hu RI"), (2, "x.y", "ABC1", "huri"), (3, "abc1", "xy", "HURI "), (4, "abc1", "xy", "corum"), (5, None, "xy", "huri"),
        (6, "--", "xy", "huri"), (7, "a", "b", ""), (8, "q" * 100_000, "b", "s"), (9, "B", "Q" * 100_000, "S"), (10, "Ünï", "b", "s"), (11, "b", "üNÏ", "s"), (None, "abc1", "xy", "huri"),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], INTER)
    got = sorted(map(tuple, merkle.copies(df, merkle.interaction_tree(), "interaction_id").collect()))
    assert got == [(1, 2), (1, 3), (8, 9), (10, 11)]
    kept = {r["kept_id"]: r["n_copies"] for r in merkle.collapse(df, merkle.interaction_tree(), "interaction_id").collect()}
    assert kept == {1: 3, 4: 1, 8: 2, 10: 2}
    assert merkle.copies(df.where("false"), merkle.interaction_tree(), "interaction_id").count() == 0


def test_merkle_hot_group_and_nested_trees(spark):
    df = spark.range(3000).select(F.col("id").alias("interaction_id"), F.lit("A").alias("protein_a"), F.when(F.col("id") % 3 == 0, F.lit("B")).otherwise(F.col("id").cast("string")).alias("protein_b"), F.lit("s").alias("source"))
    assert merkle.copies(df, merkle.interaction_tree(), "interaction_id").count() == 999
    tree = merkle.unordered(merkle.leaf("a"), merkle.ordered(merkle.leaf("b"), merkle.leaf("c")), merkle.leaf("d"))
    t = spark.createDataFrame([(1, "x", "y", "z", "w"), (2, "w", "y", "z", "x"), (3, "x", "z", "y", "w")], "id long, a string, b string, c string, d string")
    digests = {r["id"]: r["g"] for r in t.select("id", merkle.digest(tree).alias("g")).collect()}
    assert digests[1] == digests[2] != digests[3]
    assert [tuple(r) for r in merkle.copies(t, tree, "id").collect()] == [(1, 2)]
    assert sorted((r["kept_id"], r["n_copies"], r["record"]) for r in merkle.collapse(t, tree, "id").collect()) == [(1, 2, "{(y,z),w,x}"), (3, 1, "{(z,y),w,x}")]
    pair = merkle.ordered(merkle.unordered(merkle.leaf("a"), merkle.unordered(merkle.leaf("b"), merkle.leaf("c"))), merkle.leaf("d"))
    u = spark.createDataFrame([(1, "x", "y", "z", "w"), (2, "X", "Z", "Y", "w!"), (3, "y", "x", "z", "w")], "id long, a string, b string, c string, d string")
    assert [tuple(r) for r in merkle.copies(u, pair, "id").collect()] == [(1, 2)]


def test_merkle_collision_never_merges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "digest", lambda node: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1, "a", "b", "s"), (2, "b", "a", "S"), (3, "c", "d", "s")], "interaction_id long, protein_a string, protein_b string, source string")
    assert [tuple(r) for r in merkle.copies(df, merkle.interaction_tree(), "interaction_id").collect()] == [(1, 2)]


def brute_top(rows, n):
    best = {}
    for run, dis, a, b, s in rows:
        if dis is not None and s is not None and s == s and a is not None and b is not None and a != b:
            best.setdefault((run, dis), {}).setdefault((min(a, b), max(a, b)), []).append(s)
    return {(*k, *p) for k, v in best.items() for p in sorted(v, key=lambda p: (-max(v[p]), p))[:n]}


def test_top_pairs(spark):
    rng = random.Random(3)
    rows = [("r1", "hot", f"d{rng.randrange(60):02d}", f"d{rng.randrange(60):02d}", float(rng.randrange(30))) for _ in range(4000)]
    score = {}
    rows = [(r, d, a, b, score.setdefault((min(a, b), max(a, b)), s)) for r, d, a, b, s in rows]
    rows += [(f"r{i}", "x", "b", "a", 1.0) for i in range(50)] + [("r1", None, "a", "b", 9.0), ("r1", "x", "a", "c", float("nan")), ("r1", "x", "a", "d", None), ("r2", "x", None, "b", 5.0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "run_id string, disease string, drug_a string, drug_b string, prediction_score double, score int")
    got = {tuple(r)[:4] for r in top_n.top_pairs(df).select("run_id", "disease", "drug_lo", "drug_hi").collect()}
    assert got == brute_top(rows, 10)
    assert top_n.top_pairs(df.where("false")).count() == 0


def test_top_skips_row_groups(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("item"), F.hash("id").cast("double").alias("s"))
    path = Scratch(spark, "t").path()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    top_n.cluster_scores(df, ["g"], ["item"], "s", path, rows_per_group=500)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    r = top_n.skip_report(spark, path, ["g"], ["item"], 10).first()
    assert (r["n_row_groups"], r["n_read"]) == (40, 1) and r["skipped_by_footer"] + r["skipped_in_file"] == 39
    got = [r["item"] for r in top_n.top_n(spark, path, ["g"], ["item"], 10).orderBy("rank").collect()]
    assert got == [r["item"] for r in df.orderBy(F.desc("s"), "item").limit(10).collect()]


def test_top_skips_among_many_groups(spark):
    """Groups of all sizes in one file: what is read must hold each group's best, and hot groups are mostly skipped."""
    rng = random.Random(9)
    rows = [(g, f"i{k:05d}", float(rng.randrange(40))) for g, n in (("a", 1500), ("b", 3), ("c", 900), ("d", 1), ("e", 700)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, item string, s double")
    path = Scratch(spark, "t").path()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    top_n.cluster_scores(df, ["g"], ["item"], "s", path, rows_per_group=100)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r["g"], r["item"]) for r in top_n.top_n(spark, path, ["g"], ["item"], 10).collect()}
    want = {(g, i) for g in "abcde" for _, i in sorted((-s, i) for h, i, s in rows if h == g)[:10]}
    r = top_n.skip_report(spark, path, ["g"], ["item"], 10).first()
    assert got == want and r["n_read"] + r["skipped_by_footer"] + r["skipped_in_file"] == r["n_row_groups"] and r["n_read"] < 12


def rank_gap(values, answer, p):
    """Distance of p from the ranks that ``answer`` covers in ``values``."""
    v = np.sort(values)
    lo, hi = np.searchsorted(v, answer, "left") / len(v), np.searchsorted(v, answer, "right") / len(v)
    return max(0.0, lo - p, p - hi)


def test_sketch_bounds_and_merges():
    rng = np.random.default_rng(1)
    v = rng.standard_t(2, 300_000)
    parts = []
    for chunk in np.array_split(v, 37):
        s = quantiles.Sketch(k=128)
        s.update(chunk)
        parts.append(s.state())
    whole = quantiles.Sketch(k=128)
    for p in parts:
        whole.merge(*p)
    assert whole.n == len(v) and sum(len(a) * 2**h for h, lv in enumerate(whole.levels) for a in lv) == len(v)
    assert max(sum(map(len, lv)) for lv in whole.levels) <= 2 * 128
    ps = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    assert 0 < whole.rank_error() < 0.1
    assert all(rank_gap(v, q, p) <= whole.rank_error() for p, q in zip(ps, whole.quantiles(ps)))
    small = quantiles.Sketch()
    small.update(np.array([3.0, 1.0, 2.0]))
    assert small.quantiles([0.0, 0.5, 1.0]) == [1.0, 2.0, 3.0] and small.rank_error() == 0.0
    assert quantiles.Sketch().quantiles([0.5]) == [None]


def test_equal_partitions_draw_their_own_coins():
    v = np.arange(5_000.0)
    states = []
    for part in range(8):
        s = quantiles.Sketch(k=64, seed=(0, part, 1))
        s.update(v)
        states.append(s.state()[3])
    assert len(set(states)) > 1


@pytest.mark.parametrize("k, open_", [(1024, 20_000), (64, 20_000), (64, 2)])
def test_percentiles_against_exact(spark, monkeypatch, k, open_):
    """With sketches of all values, with small ones, and with more keys than a task may hold open."""
    monkeypatch.setattr(quantiles.day_sketches, "__defaults__", (k,))
    monkeypatch.setattr(quantiles.partial_sketches, "__defaults__", (k,))
    monkeypatch.setattr(quantiles.merge_sketches, "__defaults__", (k, quantiles.SALTS))
    monkeypatch.setattr(quantiles.percentiles, "__defaults__", (k, quantiles.DELTA))
    monkeypatch.setattr(quantiles, "OPEN", open_)
    rng = np.random.default_rng(4)
    n = 30_000
    df = pd.DataFrame({"sig_id": [f"s{i}" for i in rng.integers(0, 12, n)], "fold_change": rng.normal(size=n), "measured_at": pd.Timestamp("2023-01-01") + pd.to_timedelta(rng.integers(0, 40, n), "D")})
    df.loc[:50, "fold_change"] = np.nan
    meta = pd.DataFrame([(i, f"s{i % 12}", "hot" if i % 3 else f"c{i % 12}") for i in range(24)] + [(99, "unused", "lonely"), (100, None, "x")], columns=["row_id", "sig_id", "pert_iname"])
    m = meta.dropna().sort_values("row_id").groupby("sig_id").pert_iname.last()
    got = quantiles.compound_percentiles(spark.createDataFrame(df).repartition(5), spark.createDataFrame(meta)).collect()
    want = df.assign(p=df.sig_id.map(m)).dropna().groupby("p").fold_change.apply(np.array)
    assert {r["pert_iname"] for r in got} == set(want.index) | {"lonely"}
    for r in got:
        if r["pert_iname"] == "lonely":
            assert r["n_values"] == 0 and r["median"] is None
            continue
        v = want[r["pert_iname"]]
        assert r["n_values"] == len(v)
        for c, p in quantiles.PERCENTILES.items():
            assert rank_gap(v, r[c], p) <= r["rank_error"] + 1e-9
    empty = spark.createDataFrame(df.head(1)).where("false")
    assert all(r["n_values"] == 0 for r in quantiles.compound_percentiles(empty, spark.createDataFrame(meta)).collect())


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


@pytest.mark.parametrize("levels", [24, 2])
def test_groups_against_union_find(spark, levels):
    rng = random.Random(7)
    pairs = [("hub", f"n{rng.randrange(200):03d}") for _ in range(150)] + [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(60)]
    pairs += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(70)] + [(f"n000", "t000")] + [(f"t{i:03d}", f"t{i + 1:03d}") for i in range(9)] + [("self", "self"), ("hub", "n000")]
    pairs += [(f"a{i}", f"b{i}") for i in range(20)]
    df = spark.createDataFrame(pairs * 2 + [(None, "x"), ("", "y")], "a string, b string")
    got = {r["member"]: r["group"] for r in components.connected_groups(df, "a", "b", max_levels=levels).collect()}
    assert got == union_find(pairs)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([(None, "x"), ("", "y")], "a string, b string")
    assert components.connected_groups(df, "a", "b").count() == 0
    one = spark.createDataFrame([("z", "z")], "a string, b string")
    assert [tuple(r) for r in components.connected_groups(one, "a", "b").collect()] == [("z", "z")]


def test_distance_and_deletions():
    assert canonical.distance("carcinoma", "carcinoma") == 0 and canonical.distance("caricnoma", "carcinoma") == 1
    assert canonical.distance("lbeukegmia", "leukemia") == 2 and canonical.distance("", "ab") == 2
    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(6, 10)))
        x = list(w)
        for _ in range(rng.randrange(0, 3)):
            i = rng.randrange(len(x))
            x[i : i + 1] = rng.choice([[], [rng.choice("abcd")], [x[i], rng.choice("abcd")]])
        x = "".join(x)
        if canonical.distance(w, x) <= 2:
            assert set(canonical.deletions(w, 2)) & set(canonical.deletions(x, 2))


def test_canonical_values(spark):
    ref = spark.createDataFrame([(1, "acute tessal leukemia", "ATLM; Obrelic disorder 003"), (2, "tessal leukemia type 1", None), (3, "tessal leukemia type 2", ""), (4, "plonobbiforate", "JK-1010"), (5, "acute torpal nephritis", None), (6, None, "x")], "disease_id int, disease string, synonyms string")
    cases = {
        "acute tessal leukemia": None, "Acute  tessal, LEUKEMIA": 1, "leukemia (acute tessal)": 1, "acute tesal leukmeia": 1, "acuten tessal leukemia [case vs control]": 1, "atlm.": 1, "obrelic disorder 003": 1, "obrelic disorder 004": 0,
        "tessal leukemia type 2": None, "Tessal leukemia type II": 3, "tessalleukemia type 1": 2, "tessal leukemia": 0, "ac. torpal nephritis": 5, "torpal nephritis": 0, "PLON-obbiforate HCl": 4, "jk 1010": 4, "JK-1011": 0, "plonobb iforate 10 uM": 4,
        "???": 0, "  ": None, "": None, "fasting": 0, "acute tessal léukemia": 1, "z" * 5000: 0, " ".join(["word"] * 300): 0,
    }
    rows = [(i, v, "clash") for i, v in enumerate(cases)] + [(900, None, "clash"), (901, "atlm.", "clash")]
    df = spark.createDataFrame(rows, "record_id long, disease_name string, ref_id string")
    got = {r["record_id"]: r["ref_id"] for r in canonical.map_column(df, "record_id", "disease_name", ref, "disease_id", "disease").collect()}
    want = {i: w for i, w in enumerate(cases.values()) if w is not None} | {901: 1}
    assert got == want
    assert canonical.map_column(df.where("false"), "record_id", "disease_name", ref, "disease_id", "disease").count() == 0


def test_values_without_a_day_count(spark):
    values = spark.createDataFrame([("s", None if i % 3 else f"2024-01-0{1 + i % 2} 00:00:00", float(i)) for i in range(90)], "sig_id string, measured_at string, fold_change double")
    values = values.selectExpr("sig_id", "cast(measured_at as timestamp) measured_at", "fold_change").repartition(3)
    meta = spark.createDataFrame([(1, "s", "x")], "row_id bigint, sig_id string, pert_iname string")
    r = quantiles.compound_percentiles(values, meta).first()
    assert r["n_values"] == 90 and r["median"] == 44.0 and r["p99"] == 89.0
    days = quantiles.percentiles(quantiles.compound_sketches(values, meta), ["pert_iname", "day"], quantiles.PERCENTILES).collect()
    assert sorted((str(r["day"]), r["n_values"]) for r in days) == [("2024-01-01", 15), ("2024-01-02", 15), ("None", 60)]


def test_repairs_are_all_pairs_within_the_distance(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(60)] + ["ab1", "ab2"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "token string, vocab string").distinct()
    got = {(r["token"], r["vocab"]): r["d"] for r in canonical.repairs_within(pairs).collect()}
    digit = lambda w: any(c.isdigit() for c in w)
    want = {(a, b): d for a in words for b in words if (d := canonical.distance(a, b)) == 0 or (d <= canonical.allowed(len(b)) and not digit(a) and not digit(b))}
    assert got == want


def test_contractions_are_learnt(spark):
    """"2ry" is all that stands between a value and an entry; "zry" would do for two words as often, "sully" for none."""
    names = ["secondary orbinal tumor", "secondary halvic fever", "binary tumor", "canary tumor", "asthma", "orbinal fever"]
    ref = spark.createDataFrame([(i, n, None) for i, n in enumerate(names, 1)], "disease_id int, disease string, synonyms string")
    values = ["2ry orbinal tumor", "2ry halvic fever", "2ry halvic fever.", "zry tumor", "sully asthma", "orbinal 2ry tumor"]
    df = spark.createDataFrame(list(enumerate(values)), "record_id long, disease_name string")
    got = {r["record_id"]: r["ref_id"] for r in canonical.map_column(df, "record_id", "disease_name", ref, "disease_id", "disease").collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 0, 4: 5, 5: 1}


def test_roman_numerals_are_numbers(spark):
    t = spark.createDataFrame([("type ii, class xiv vi ix iiii mix x v",)], "t string").select(canonical.tokens(F.col("t"))).first()[0]
    assert t == ["type", "2", "class", "xiv", "6", "9", "iiii", "mix", "x", "5"]


def test_long_words_share_a_key():
    rng = np.random.default_rng(8)
    for _ in range(3_000):
        w = list(rng.choice(list("abcd"), rng.integers(60, 90)))
        x = w.copy()
        for kind in rng.integers(0, 4, rng.integers(0, 3)):
            i = int(rng.integers(0, len(x) - 1))
            if kind == 0:
                del x[i]
            elif kind == 1:
                x.insert(i, "e")
            elif kind == 2:
                x[i] = "e"
            else:
                x[i : i + 2] = x[i + 1], x[i]
        w, x = "".join(w), "".join(x)
        if max(len(w), len(x)) > canonical.LONG and canonical.distance(w, x) <= 2:
            assert set(canonical._keys(x, True)) & set(canonical._keys(w, False))


def test_long_word_is_repaired(spark):
    word = "pneumono" * 9
    ref = spark.createDataFrame([(1, f"{word} fever", None), (2, "asthma", None)], "disease_id bigint, disease string, synonyms string")
    df = spark.createDataFrame([(1, f"{word[:30]}x{word[30:50]}{word[51:]} fever")], "record_id bigint, disease_name string")
    assert [r["ref_id"] for r in canonical.map_column(df, "record_id", "disease_name", ref, "disease_id", "disease").collect()] == [1]
