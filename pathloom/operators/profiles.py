"""Profiles and gene modules from signature tables.

NULL and NaN values are skipped; a side of a drug module always holds at least
one gene; ties go to the gene that sorts first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.columns import aggregate, name_key, symbol_key, valid
from pathloom.operators.graph import last_by


def join_metadata(values: DataFrame, metadata: DataFrame, sig_id: str = "sig_id", compound: str = "pert_iname", order: str = "row_id") -> DataFrame:
    """Values with their compound; of repeated metadata rows the last holds, values without metadata go.

    No match at all is an error for callers to raise with ``unmatched``.
    """
    m = last_by(metadata.where(F.col(sig_id).isNotNull()), sig_id, order).select(F.col(sig_id).alias("sig_id"), F.col(compound).alias("compound"))
    return values.join(m, "sig_id").where("compound is not null")


def unmatched(values: DataFrame, metadata: DataFrame) -> DataFrame:
    """(sig_id, n_values) of signatures without metadata."""
    return values.join(metadata.select("sig_id").where("sig_id is not null"), "sig_id", "left_anti").groupBy("sig_id").agg(F.count("*").alias("n_values"))


def profiles(values: DataFrame, method: str = "median") -> DataFrame:
    """(compound, gene, fold_change): exact median or mean over a compound's signatures."""
    return values.where(valid("fold_change") & F.col("gene").isNotNull()).groupBy("compound", "gene").agg(aggregate(method, "fold_change").alias("fold_change"))


def top_fraction(profile: DataFrame, key: str = "compound", value: str = "fold_change", top_pct: float = 0.05) -> DataFrame:
    """(key, gene, direction): the signed top and bottom fraction of each profile.

    Each side has max(1, int(n * top_pct)) genes; a small profile may put one gene in both.
    """
    if not 0 < top_pct <= 1:
        raise ValueError(f"top_pct must be in (0, 1], not {top_pct}")
    p = profile.where(valid(value))
    w = Window.partitionBy(key)
    n = F.greatest(F.lit(1), (F.count("*").over(w) * F.lit(top_pct)).cast("int"))
    r = p.select(key, "gene", n.alias("n"), F.row_number().over(w.orderBy(F.desc(value), "gene")).alias("top"), F.row_number().over(w.orderBy(F.asc(value), "gene")).alias("low"))
    sides = F.array_compact(F.array(F.when(F.col("top") <= F.col("n"), F.lit("up")), F.when(F.col("low") <= F.col("n"), F.lit("down"))))
    return r.where("top <= n or low <= n").select(key, "gene", F.explode(sides).alias("direction"))


def creeds_genes(signatures: DataFrame) -> DataFrame:
    """(disease, gene, direction) as reported, repeats kept; directions other than up and down are ignored."""
    s = signatures.select(name_key("disease_name").alias("disease"), symbol_key("gene_symbol").alias("gene"), F.lower(F.trim("direction")).alias("direction"))
    return s.where("direction in ('up', 'down') and disease <> '' and gene is not null")


def disease_modules(genes: DataFrame) -> DataFrame:
    """(disease, gene): up and down together."""
    return genes.select("disease", "gene").distinct()


def direction_signature(genes: DataFrame) -> DataFrame:
    """(disease, gene, fold_change): reports up minus reports down, genes without a balance left out."""
    s = genes.groupBy("disease", "gene").agg(F.sum(F.when(F.col("direction") == "up", 1.0).otherwise(-1.0)).alias("fold_change"))
    return s.where("fold_change <> 0")


def drug_union(drug_genes: DataFrame) -> DataFrame:
    """(drug, gene): up and down together."""
    return drug_genes.select("drug", "gene").distinct()


def susceptibility_genes(spark) -> DataFrame:
    """Always empty, as no such source is read: (disease, gene)."""
    return spark.createDataFrame([], "disease string, gene string")
