"""Identifiers to symbols through a lookup table ``id_map(id, from_type, symbol)``.

A row with a NULL symbol means "looked up, not found". Lookups are joins; the
remote service of a missing id is an injected function that maps a DataFrame of
(id, from_type) to hits (id, from_type, hit_rank, symbol), called once per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPES = ("auto", "symbol", "entrez", "ensembl", "uniprot")


def _check(scope: str) -> None:
    if scope not in SCOPES:
        raise ValueError(f"unknown from_type {scope!r}; one of {SCOPES}")


def to_symbols(ids: DataFrame, id_map: DataFrame, from_type: str = "auto", hgnc: DataFrame | None = None) -> DataFrame:
    """``ids(pos, id)`` with ``symbol``, position kept; unmapped ids have a NULL symbol.

    For the scopes auto and symbol an id that no row of ``id_map`` answers and that is a
    symbol of ``hgnc(symbol)`` stands for itself.
    """
    _check(from_type)
    m = id_map.where(F.col("from_type") == from_type).groupBy("id").agg(F.max("symbol").alias("symbol"), F.lit(True).alias("_asked"))
    out = ids.join(m, "id", "left")
    if hgnc is not None and from_type in ("auto", "symbol"):
        own = hgnc.select(F.col("symbol").alias("id"), F.col("symbol").alias("_own")).where("id is not null").distinct()
        out = out.join(own, "id", "left").withColumn("symbol", F.when(F.col("_asked").isNull(), F.col("_own")).otherwise(F.col("symbol")))
    return out.select("pos", "id", "symbol")


def first_hits(hits: DataFrame) -> DataFrame:
    """(id, from_type, symbol): the first hit with a symbol, NULL if no hit has one."""
    return hits.groupBy("id", "from_type").agg(F.min_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("hit_rank"))).alias("symbol"))


def resolve(ids: DataFrame, id_map: DataFrame, lookup: Callable[[DataFrame], DataFrame], from_type: str = "auto") -> DataFrame:
    """``id_map`` with the missing ids of ``ids(id)`` looked up in one batch; misses are kept as NULL."""
    _check(from_type)
    known = id_map.where(F.col("from_type") == from_type).select("id")
    missing = ids.select("id").where("id is not null").distinct().join(known, "id", "left_anti").withColumn("from_type", F.lit(from_type))
    got = first_hits(lookup(missing))
    new = missing.join(got, ["id", "from_type"], "left").select("id", "from_type", "symbol")
    return id_map.select("id", "from_type", "symbol").unionByName(new)


def harmonize(ids: DataFrame, id_map: DataFrame, from_type: str = "auto") -> DataFrame:
    """(pos, symbol): distinct symbols of ``ids(pos, id)`` in order of first appearance; unmapped ones always go."""
    s = to_symbols(ids, id_map, from_type).where("symbol is not null")
    return s.groupBy("symbol").agg(F.min("pos").alias("pos")).select("pos", "symbol")


def batch_convert(ids: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, symbol) for ``ids(id)``: the last hit wins, unmapped ids are absent."""
    last = hits.where("symbol is not null").groupBy("id").agg(F.max_by("symbol", "hit_rank").alias("symbol"))
    return ids.select("id").distinct().join(last, "id")


def to_entrez(symbols: DataFrame, hgnc: DataFrame, lookup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``symbols(pos, symbol)`` with ``entrez_id``; of repeated symbols in ``hgnc(row, symbol, entrez_id)`` the last row holds.

    Symbols without an id there go to ``lookup`` in one batch, (symbol) to hits (symbol,
    hit_rank, entrez_id); the first hit with an id wins.
    """
    h = hgnc.groupBy("symbol").agg(F.max_by("entrez_id", "row").try_cast("bigint").alias("entrez_id"))
    out = symbols.join(h, "symbol", "left")
    if lookup is not None:
        missing = out.where("entrez_id is null and symbol is not null").select("symbol").distinct()
        hits = lookup(missing).groupBy("symbol").agg(F.min_by("entrez_id", F.when(F.col("entrez_id").isNotNull(), F.col("hit_rank"))).try_cast("bigint").alias("_found"))
        out = out.join(hits, "symbol", "left").withColumn("entrez_id", F.coalesce("entrez_id", "_found"))
    return out.select("pos", "symbol", "entrez_id")
