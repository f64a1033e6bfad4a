"""Mixing sources to target weights with a low-discrepancy schedule.

Documents are sized in tokens of a public tokenizer. Each source's documents
are shuffled by a hash and joined to blocks of about ``block_tokens`` tokens:
a document belongs to the block in which its first token falls. Slot t of the
mix goes to the source in whose interval of cumulative weights the golden-ratio
point frac((t + 1/2) * phi) falls; the r-th slot of a source takes its block
r mod n in pass r div n, so every document of a source is used once before any
is used again, and passes beyond ``max_repeats`` are not scheduled.

Weights: the mix is to be as large as the corpus. A source with fewer tokens
than its share, even at ``max_repeats`` uses each, gives all it has, and what it
lacks goes to the others in proportion to their targets, as far as they can give
it. ``mix_report`` states target, allotted and actual shares.

Positions and ranks are prefix sums in two levels (per hash bucket, then within
it), so no source is ever ordered in one task. NULL and empty texts, documents
of sources without a target and targets without documents add nothing to the
mix, the first two still count for the size of the corpus if they have tokens.
Targets with a NULL source, share or repeat count are refused.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.storage import Scratch

BLOCK_TOKENS, BUCKET_BITS, SLOTS_PER_CHUNK, SEED = 512, 12, 1 << 16, 11

#: The golden ratio in 64 bits: multiples of it, modulo 2**64, are exact for any slot.
PHI, ONE = (math.isqrt(5 << 128) - (1 << 64)) >> 1, 1 << 64

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of whole texts; NULL texts have 0 tokens."""

    documents.sparkSession.sparkContext.addFile(tokenizer)  # each executor gets its own copy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(SparkFiles.get(os.path.basename(tokenizer))).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def allot(total: float, targets: dict[str, float], capacity: dict[str, float]) -> dict[str, float]:
    """Tokens for each source: its share of ``total``, at most its capacity, the lack shared out in proportion."""
    out = {s: 0.0 for s in targets}
    free = {s for s in targets if capacity.get(s, 0) > 0 and targets[s] > 0}
    left = min(total, sum(capacity.get(s, 0) for s in free))
    while free:
        weight = sum(targets[s] for s in free)
        full = {s for s in free if capacity[s] <= left * targets[s] / weight}
        if not full:
            for s in free:
                out[s] = left * targets[s] / weight
            break
        for s in full:
            out[s] = float(capacity[s])
        left -= sum(capacity[s] for s in full)
        free -= full
    return out


def _plan(counts: DataFrame, targets: DataFrame, block_tokens: int) -> list[dict]:
    """Per target source: tokens, blocks, allotted tokens and slots. One row per target reaches the driver."""
    wanted = {r["source"]: r for r in targets.collect()}
    for r in wanted.values():
        if r["source"] is None or r["target_share"] is None or r["max_repeats"] is None:
            raise ValueError("a target needs source, share and repeat count")
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    sums = counts.join(targets.select("source"), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    have = {r["source"]: r["n"] for r in sums.collect()}
    tokens = allot(total, {s: r["target_share"] for s, r in wanted.items()}, {s: have.get(s, 0) * r["max_repeats"] for s, r in wanted.items()})
    plan = []
    for s, r in sorted(wanted.items()):
        n = have.get(s, 0)
        blocks = -(-n // block_tokens)
        plan.append({"source": s, "target_share": r["target_share"], "max_repeats": r["max_repeats"], "source_tokens": n, "blocks": blocks, "allotted_tokens": tokens[s], "slots": tokens[s] / (n / blocks) if blocks else 0.0, "corpus_tokens": total})
    return plan


def blocks(counts: DataFrame, block_tokens: int = BLOCK_TOKENS, bits: int = BUCKET_BITS, seed: int = SEED) -> DataFrame:
    """(source, block, doc_id, n_tokens): each source shuffled and joined to blocks."""
    d = counts.where("source is not null and doc_id is not null and n_tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    d = d.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))  # at most 2**bits rows a source
    before = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(before, ["source", "bucket"])
    return d.select("source", F.floor((F.col("before") + F.col("within")) / block_tokens).alias("block"), "doc_id", "n_tokens")


def schedule(spark, plan: list[dict], per_chunk: int = SLOTS_PER_CHUNK) -> DataFrame:
    """(slot, source, pass, block) from golden-ratio points through the cumulative weights."""
    live = [p for p in plan if p["slots"] > 0]
    schema = "slot bigint, source string, pass bigint, block bigint"
    if not live:
        return spark.createDataFrame([], schema)
    total = sum(p["slots"] for p in live)
    whole = lambda x: F.lit(Decimal(x)).cast("decimal(20,0)")
    point = ((F.col("id").cast("decimal(18,0)") * whole(PHI) + whole(PHI // 2)) % whole(ONE)).cast("double") / float(ONE)
    source, at = F.lit(live[-1]["source"]), 0.0
    edges = []
    for p in live:
        at += p["slots"] / total
        edges.append((at, p["source"]))
    for edge, name in reversed(edges[:-1]):
        source = F.when(F.col("u") < edge, F.lit(name)).otherwise(source)
    slots = spark.range(max(1, round(total))).withColumn("u", point).select(F.col("id").alias("slot"), source.alias("source"), F.floor(F.col("id") / per_chunk).alias("chunk"))
    sums = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = sums.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1).join(before, ["source", "chunk"])
    n_blocks, repeats = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for p in live:
        n_blocks = F.when(F.col("source") == p["source"], F.lit(p["blocks"])).otherwise(n_blocks)
        repeats = F.when(F.col("source") == p["source"], F.lit(p["max_repeats"])).otherwise(repeats)
    r = ranked.select("slot", "source", (F.col("before") + F.col("r")).alias("r"), n_blocks.alias("n"), repeats.alias("m"))
    return r.select("slot", "source", F.floor(F.col("r") / F.col("n")).alias("pass"), (F.col("r") % F.col("n")).alias("block"), "m").where("pass < m").drop("m")


def _mixed(documents: DataFrame, targets: DataFrame, block_tokens: int, tokenizer: str) -> tuple[DataFrame, list[dict]]:
    spark = documents.sparkSession
    counts = Scratch(spark, "mixing").cut(token_counts(documents, tokenizer), "tokens")
    targets = targets.select("source", "target_share", "max_repeats")
    plan = _plan(counts, targets, block_tokens)
    docs = blocks(counts.join(targets.select("source"), "source", "left_semi"), block_tokens)
    return schedule(spark, plan).join(docs, ["source", "block"]).select("slot", "source", "pass", "block", "doc_id", "n_tokens"), plan


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER) -> DataFrame:
    """(slot, source, pass, block, doc_id, n_tokens): the mix in order of its slots."""
    return _mixed(documents, targets, block_tokens, tokenizer)[0]


def mix_report(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per target source: target, allotted and actual tokens and shares, and uses of its documents."""
    mixed, plan = _mixed(documents, targets, block_tokens, tokenizer)
    uses = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("uses"))
    got = uses.groupBy("source").agg(F.sum("n").alias("mixed_tokens"), F.count("*").alias("n_documents"), F.max("uses").alias("max_uses"))
    spark = documents.sparkSession
    want = spark.createDataFrame([(p["source"], float(p["target_share"]), int(p["max_repeats"]), int(p["source_tokens"]), float(p["allotted_tokens"])) for p in plan], "source string, target_share double, max_repeats int, source_tokens bigint, allotted_tokens double")
    out = want.join(got, "source", "left").fillna(0, ["mixed_tokens", "n_documents", "max_uses"])
    whole = Window.partitionBy()  # one row per target source
    return out.withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(whole), F.lit(0)), F.lit(0.0)))
