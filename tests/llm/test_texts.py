import random
import re

import numpy as np
import pytest

from pathloom.llm import abuse, contamination, mixing

WORDS = [f"w{i}" for i in range(400)]


def brute(doc, item, words=12):
    w = lambda t: [x.lower() for x in re.findall(r"[^\W_]+", t)]
    d, i = w(doc), w(item)
    n = min(words, len(i))
    grams = {tuple(d[k : k + n]) for k in range(len(d) - n + 1)}
    return n > 0 and any(tuple(i[k : k + n]) in grams for k in range(len(i) - n + 1))


def test_passages(spark):
    rng = random.Random(1)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 9, 12, 30])))) for k in range(30)] + [(90, ""), (91, None), (92, "?!"), (93, "Solo")]
    docs = []
    for k in range(120):
        body = [rng.choice(WORDS) for _ in range(rng.randrange(0, 80))]
        src = items[rng.randrange(30)][1].split()
        cut = rng.randrange(len(src))
        take = src[cut : cut + rng.randrange(4, 30)]
        seps = [rng.choice([" ", "\n> ", " * ", "...", "_", "  "]) for _ in take]
        docs.append((k, " ".join(body) + " " + "".join(a.upper() + b for a, b in zip(take, seps)) + " ".join(body[:5])))
    docs += [(500, None), (501, ""), (502, "x " * 200_000 + "solo"), (503, "soloist")]
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, item_id int")
    got = contamination.leaked_passages(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(a, b) for a, t in docs if t for b, i in items if i and brute(t, i)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and (502, 93) in want and (503, 93) not in want
    texts, bodies = dict(docs), dict(items)
    for r in got:  # the offsets delimit a passage in the original text
        assert brute(texts[r["doc_id"]][r["begin"] : r["end"]], bodies[r["item_id"]])


def test_passages_in_blocks(spark):
    items = spark.createDataFrame([(k, " ".join(WORDS[k : k + 14])) for k in range(0, 200, 20)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "start " + " ".join(WORDS[k : k + 13]) + " end") for k in range(0, 200, 20)], "doc_id long, text string")
    one = contamination.leaked_passages(docs, items).select("doc_id", "item_id").collect()
    many = contamination.leaked_passages(docs, items, max_words=30).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) == [(k, k) for k in range(0, 200, 20)]
    assert contamination.leaked_passages(docs, items.where("false")).count() == 0


def test_allot():
    assert mixing.allot(100, {"a": 0.5, "b": 0.5}, {"a": 1000, "b": 1000}) == {"a": 50, "b": 50}
    got = mixing.allot(100, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 10, "c": 1000})
    assert got["b"] == 10 and got["a"] == pytest.approx(90 * 5 / 7) and sum(got.values()) == pytest.approx(100)
    assert mixing.allot(100, {"a": 0.5, "b": 0.5}, {"a": 20, "b": 0}) == {"a": 20, "b": 0}
    assert mixing.allot(0, {}, {}) == {}


def corpus(spark, n=3000):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))), rng.choice(["big"] * 8 + ["mid"] * 3 + ["small", None, "unlisted"])) for i in range(n)]
    rows += [(n, None, "big"), (n + 1, "", "big"), (n + 2, "long " * 20_000, "mid")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, slot int")


def test_mix(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 3), ("small", 0.15, 2), ("absent", 0.05, 5)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets, block_tokens=256).toPandas()
    uses = mixed.groupby(["source", "doc_id"]).size()
    limit = {"big": 1, "mid": 3, "small": 2}
    assert all(n <= limit[s] for (s, _), n in uses.items()) and set(mixed.source) == set(limit)
    for s in limit:  # nothing is used again before all else was used once
        u = uses[s]
        assert u.max() - u.min() <= 1 or u.min() > 0
    rep = {r["source"]: r for r in mixing.mix_report(docs, targets, block_tokens=256).collect()}
    assert rep["absent"]["mixed_tokens"] == 0 and sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)
    for s in ("big", "mid"):
        assert rep[s]["mixed_tokens"] == pytest.approx(rep[s]["allotted_tokens"], rel=0.1)
    assert rep["small"]["max_uses"] <= 2 and mixed.groupby("source").n_tokens.sum()["big"] == rep["big"]["mixed_tokens"]
    # any stretch of the schedule holds the sources in proportion
    slots = mixed.drop_duplicates("slot").sort_values("slot")
    half = slots[slots.slot < slots.slot.max() // 2]
    assert half.source.value_counts(normalize=True)["big"] == pytest.approx(slots.source.value_counts(normalize=True)["big"], abs=0.05)


def test_mix_of_nothing(spark):
    t = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    empty = corpus(spark, 5).where("false")
    assert mixing.mix(empty, t).count() == 0
    assert mixing.mix_report(empty, t).first()["actual_share"] == 0.0
    with pytest.raises(ValueError):
        mixing.mix(empty, spark.createDataFrame([("big", None, 1)], t.schema))


def test_blocks_are_prefix_sums(spark):
    counts = spark.createDataFrame([(i, "s", i % 7) for i in range(500)], "doc_id long, source string, n_tokens long")
    b = mixing.blocks(counts, block_tokens=50, bits=4).toPandas()
    assert len(b) == sum(1 for i in range(500) if i % 7) and b.block.max() == (b.n_tokens.sum() - 1) // 50
    assert b.groupby("block").n_tokens.sum().between(44, 56).iloc[:-1].all()


def abuse_corpus(n, seed):
    rng = random.Random(seed)
    group, bad, thing = ["vorlanders", "keshti", "women", "men"], ["vermin", "subhuman", "liars"], ["parser", "script", "driver", "loop"]
    out = []
    for _ in range(n):
        body = [f"The {rng.choice(thing)} returns {rng.randrange(99)} rows." for _ in range(rng.randrange(1, 6))]
        toxic = rng.random() < 0.3
        if toxic:
            body.insert(rng.randrange(len(body) + 1), rng.choice([f"All {rng.choice(group)} are {rng.choice(bad)}!", "You are a use.less idiot.", "I will b r e a k your neck."]))
        elif rng.random() < 0.5:
            body.append(rng.choice([f"This {rng.choice(thing)} is a useless idiot.", f"Many {rng.choice(group)} use this {rng.choice(thing)}.", "You are a great help.", "I will break the loop."]))
        out.append((" ".join(body), float(toxic)))
    return out


def test_abuse_held_out():
    train, test = abuse_corpus(500, 1), abuse_corpus(300, 2)
    rng = random.Random(3)
    y = np.array([t if rng.random() > 0.03 else 1 - t for _, t in train], np.float32)  # annotators err
    m = abuse.fit_documents([x for x, _ in train], y)
    s = np.array([abuse.score_text(m, x) >= abuse.THRESHOLD for x, _ in test])
    t = np.array([t > 0 for _, t in test])
    assert (s & t).sum() / s.sum() > 0.9 and (s & t).sum() / t.sum() > 0.9


def test_pairwise_part_matches_its_definition():
    m = abuse.Machine(bits=6, factors=3)
    m.w[:-1] = np.random.default_rng(0).normal(size=64)
    row = np.array([1, 5, 9], np.int32)
    x = 1 / np.sqrt(3)
    want = m.w[row].sum() * x + sum(m.v[i] @ m.v[j] * x * x for a, i in enumerate(row) for j in row[a + 1 :])
    assert m.raw(*m.pad([row]))[0][0] == pytest.approx(want, rel=1e-4)


def test_all_of_a_long_text_is_read():
    s = abuse.sentences("word " * 100_000 + "END")
    assert s[-1][-1] == "end" and max(map(len, s)) <= abuse.WINDOW
    assert abuse.sentences("") == [] and abuse.sentences("\n .. ") == []
    assert abuse.sentences("You s.t.u.p.i.d and i d i o t!!") == [["you", "stupid", "and", "idiot", "!", "!"]]


def test_scores_and_rates(spark):
    texts = abuse_corpus(200, 5)
    docs = spark.createDataFrame([(i, t, "a" if i % 2 else None, 0.5) for i, (t, _) in enumerate(texts)] + [(900, None, "a", 0.5), (901, "", "a", 0.5)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(texts)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    s = abuse.score_documents(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in s.collect()}
    assert len(rows) == 202 and rows[900] == rows[901] == 0.0 and all(0 <= x <= 1 for x in rows.values())
    r = {x["source"]: x for x in abuse.source_rates(s).collect()}
    assert r["a"]["n_documents"] == 102 and r[None]["n_documents"] == 100
    none = abuse.score_documents(docs, labels.where("false"))
    assert {x["score"] for x in none.collect()} == {0.0}
