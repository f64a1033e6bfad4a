"""Scores for abusive, hateful or sexual content by a factorization machine.

A text is cut into sentences (long ones into overlapping windows, so that all of
it is read), each a set of hashed terms: words, word pairs, order-free letter
signatures that survive swapped letters, and words inside quotation marks as
terms of their own. The machine scores
``w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairwise part learns
what an insult means next to a person, a group or a program. A document's score
is that of its worst sentence.

Labels belong to documents, not sentences, so training alternates: every
sentence of a clean document is clean, and of a labelled document the sentences
the current machine finds worst are taken as the abusive ones. The machine is
fitted on the driver on at most ``max_labelled`` labelled documents, drawn by a
hash of their ids; everything else runs in Arrow batches over all documents.
Documents on whose label annotators disagree evenly are not used for fitting.

NULL and empty texts score 0. Without labels of both kinds there is nothing to
learn, and every document scores 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, FACTORS, WINDOW, OVERLAP = 18, 8, 40, 12
MAX_LABELLED, THRESHOLD, SEED = 6_000, 0.5, 7

#: Sentences whose scores a task remembers; repeated ones are hashed and scored once.
CACHED = 200_000

_SPLIT = re.compile(r"(?<=[.!?…])[\"'»)\]]*\s+|\n+|</?\w+>")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
_INNER = re.compile(r"(?<=[^\W\d_])[.\-_'’](?=[^\W\d_])")
_STARS = re.compile(r"(?<=\w)\*+(?=\w)")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"[\"“”„«»`]|\w+(?:\*\w+)*|[!?]")
_DIGIT = re.compile(r"\d")
_QUOTES = set("\"“”„«»`")


def sentences(text: str) -> list[list[str]]:
    """Word lists of a text's sentences; words in quotation marks carry the prefix ``q:``."""
    out = []
    for part in _SPLIT.split(text):
        s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), part.lower())
        s = _RUN.sub(r"\1", _STARS.sub("*", _INNER.sub("", s)))
        words, quoted = [], False
        for t in _TOKEN.findall(s):
            if t in _QUOTES:
                quoted = not quoted
            else:
                t = "0" if t.isdigit() else "x0" if _DIGIT.search(t) else t
                words.append(f"q:{t}" if quoted else t)
        step = WINDOW - OVERLAP
        for i in range(0, max(len(words) - OVERLAP, 1), step):
            if chunk := words[i : i + WINDOW]:
                out.append(chunk)
    return out


def terms(words: list[str]) -> np.ndarray:
    """Hashed terms of a sentence, each once."""
    found = {f"u {w}" for w in words}
    found |= {f"b {a} {b}" for a, b in zip(["^", *words], [*words, "$"])}
    found |= {f"s {w[0]}{''.join(sorted(w[1:]))}" for w in words if len(w) > 4}
    return np.fromiter((xxhash.xxh32_intdigest(t) & ((1 << BITS) - 1) for t in sorted(found)), dtype=np.int32)


class Machine:
    """Second-order factorization machine over hashed terms, fitted by AdaGrad."""

    def __init__(self, bits: int = BITS, factors: int = FACTORS, seed: int = SEED):
        self.size = 1 << bits
        rng = np.random.default_rng(seed)
        self.w0 = np.float32(0)
        self.w = np.zeros(self.size + 1, np.float32)  # the last row is padding
        self.v = rng.normal(0, 0.05, (self.size + 1, factors)).astype(np.float32)
        self.v[-1] = 0

    def pad(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        width = max(map(len, rows), default=1) or 1
        idx = np.full((len(rows), width), self.size, np.int32)
        for i, r in enumerate(rows):
            idx[i, : len(r)] = r
        x = 1 / np.sqrt(np.maximum([len(r) for r in rows], 1)).astype(np.float32)
        return idx, x

    def raw(self, idx: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[idx] * x[:, None, None]
        s = v.sum(1)
        pair = 0.5 * ((s * s).sum(1) - (v * v).sum((1, 2)))
        return self.w0 + self.w[idx].sum(1) * x + pair, s

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(rows), np.float32)
        order = np.argsort([len(r) for r in rows], kind="stable")
        for part in np.array_split(order, max(1, len(rows) // 512)):
            if len(part):
                z, _ = self.raw(*self.pad([rows[i] for i in part]))
                out[part] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 0.15, l2: float = 2e-5, batch: int = 256, seed: int = SEED) -> None:
        gw, gv, g0 = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                idx, x = self.pad([rows[j] for j in part])
                z, s = self.raw(idx, x)
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part]).astype(np.float32) / len(part) * 32
                dw = np.broadcast_to((d * x)[:, None], idx.shape).ravel()
                dv = d[:, None, None] * x[:, None, None] * (s[:, None, :] - self.v[idx] * x[:, None, None])
                flat, at = np.unique(idx.ravel(), return_inverse=True)
                sw = np.bincount(at, dw, len(flat)).astype(np.float32) + l2 * self.w[flat]
                dv = dv.reshape(-1, dv.shape[-1])
                sv = np.stack([np.bincount(at, dv[:, k], len(flat)) for k in range(dv.shape[1])], 1).astype(np.float32) + l2 * self.v[flat]
                gw[flat] += sw * sw
                gv[flat] += sv * sv
                g0 += float(d.sum()) ** 2
                self.w[flat] -= rate * sw / np.sqrt(gw[flat])
                self.v[flat] -= rate * 0.5 * sv / np.sqrt(gv[flat])
                self.w0 -= np.float32(rate * float(d.sum()) / np.sqrt(g0))
                self.w[-1], self.v[-1] = 0, 0


def fit_documents(texts: list[str], toxic: np.ndarray, rounds: int = 3, epochs: int = 8, rate: float = 0.3, l2: float = 1e-3) -> Machine | None:
    """A machine fitted to document labels by alternating over sentences."""
    if not len(texts) or toxic.min() == toxic.max():
        return None
    docs = [[terms(s) for s in sentences(t)] for t in texts]
    seen: dict[bytes, list] = {}
    for d, t in zip(docs, toxic):
        for r in {r.tobytes(): r for r in d}.items():
            seen.setdefault(r[0], [r[1], 0, 0])[1 + int(t)] += 1
    # A sentence that clean documents have as often is not what got a document its label. Counts
    # decide, not mere presence, since annotators err.
    clean = {k: r for k, (r, n, p) in seen.items() if n >= p}
    suspect = [u for d, t in zip(docs, toxic) if t and (u := [r for r in d if r.tobytes() not in clean])]
    if not suspect or not clean:
        return None
    negatives = list(clean.values())
    often = np.log2(1 + np.asarray([seen[k][1] for k in clean], np.float32))
    machine = None
    for _ in range(rounds):
        if machine is None:
            chosen = [(r, 1 / len(d)) for d in suspect for r in d]
        else:
            chosen = []
            for d in suspect:
                p = machine.score(d)
                if p.max() < 0.3:  # nothing in it looks abusive: an annotator's error
                    continue
                chosen += [(r, 1.0) for r, q in zip(d, p) if q >= max(0.8, p.max() - 1e-6) or q == p.max()]
        bag: dict[bytes, list] = {}
        for r, w in chosen:
            bag.setdefault(r.tobytes(), [r, 0.0])[1] += w
        chosen = list(bag.values())
        rows = [r for r, _ in chosen] + negatives
        y = np.r_[np.ones(len(chosen), np.float32), np.zeros(len(negatives), np.float32)]
        some = np.log2(1 + np.asarray([w for _, w in chosen], np.float32))
        weight = np.r_[some * np.sqrt(max(1.0, often.sum() / some.sum() / 4)), often].astype(np.float32)
        if machine is not None:  # annotators err: a clean sentence that looks abusive counts less
            q = machine.score(negatives)
            weight[len(chosen) :][q > 0.8] *= 0.1
        machine = Machine()
        machine.fit(rows, y, weight, epochs, rate, l2)
    return machine


def score_text(machine: Machine, text: str | None) -> float:
    rows = [terms(s) for s in sentences(text)] if text else []
    return float(machine.score(rows).max()) if rows else 0.0


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> pd.DataFrame:
    """(doc_id, text, toxic) of at most ``max_labelled`` documents with a majority label."""
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("t")).where("t <> 0.5")
    bounded = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select("doc_id", "text").where("text is not null").join(bounded, "doc_id")
    return texts.select("doc_id", "text", (F.col("t") > 0.5).cast("int").alias("toxic")).orderBy("doc_id").toPandas()


def score_documents(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, source, score) for every document."""
    sample = labelled_sample(documents, labels, max_labelled)
    machine = fit_documents(sample["text"].tolist(), sample["toxic"].to_numpy(np.float32)) if len(sample) else None
    docs = documents.select("doc_id", "source", "text")
    if machine is None:
        return docs.select("doc_id", "source", F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # of fixed size: 2**BITS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for b in batches:
            bags = [[" ".join(s) for s in sentences(t)] if t else [] for t in b.column(2).to_pylist()]
            new = list({s for d in bags for s in d if s not in known})
            known.update(zip(new, m.score([terms(s.split(" ")) for s in new]).tolist()))
            score = [max(known[s] for s in d) if d else 0.0 for d in bags]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["doc_id", "source", "score"])
            if len(known) > CACHED:
                known.clear()

    return docs.mapInArrow(run, "doc_id bigint, source string, score double")


def source_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_documents, n_flagged, rate) per source, NULL being a source of its own."""
    g = scores.groupBy("source").agg(F.count("*").alias("n_documents"), F.count(F.when(F.col("score") >= threshold, 1)).alias("n_flagged"))
    return g.withColumn("rate", F.col("n_flagged") / F.col("n_documents"))
