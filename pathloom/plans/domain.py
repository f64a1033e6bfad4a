"""The domain objects derived from the given tables: graph, modules, signatures, known pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.columns import hi, lo, name_key, symbol_key
from pathloom.operators import graph, profiles
from pathloom.sources.tables import table
from pathloom.storage import Scratch, kept

TOP_PCT, DRAWS, SEED = 0.05, 1000, 42

#: Searches take the rows whose id is divisible by this as queries, against all rows.
EVERY = 50


def ends(spark: SparkSession, sf: str) -> DataFrame:
    return graph.harmonize_ends(table(spark, sf, "interactions")).withColumn("seq", F.col("interaction_id"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.simple_edges(ends(spark, sf))


def network(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the largest component, written once a program."""
    return kept(spark, ("network", sf), lambda: Scratch(spark, "network").cut(graph.largest_component(edges(spark, sf)), "edges"))


def disease_reports(spark: SparkSession, sf: str) -> DataFrame:
    """(disease, gene, direction) under the name as given, but for case and surrounding space; blank names go."""
    return profiles.creeds_genes(table(spark, sf, "creeds_signatures"))


def disease_modules(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.disease_modules(disease_reports(spark, sf))


def disease_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.direction_signature(disease_reports(spark, sf))


def asked_diseases(spark: SparkSession, sf: str) -> DataFrame:
    """(disease): names in the rows whose record_id is divisible by ``EVERY``."""
    c = table(spark, sf, "creeds_signatures").where(F.col("record_id") % EVERY == 0)
    return c.select(name_key("disease_name").alias("disease")).where("disease <> ''").distinct()


def compound_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values of signatures under the compound's name as given, but for case and surrounding space; blank names go."""
    v = table(spark, sf, "lincs_values").select("sig_id", symbol_key("gene").alias("gene"), "fold_change")
    j = profiles.join_metadata(v, table(spark, sf, "lincs_metadata"))
    return j.withColumn("compound", name_key("compound")).where("compound <> ''")


def asked_drugs(spark: SparkSession, sf: str) -> DataFrame:
    """(drug): names in the metadata rows whose row_id is divisible by ``EVERY``."""
    m = table(spark, sf, "lincs_metadata").where(F.col("row_id") % EVERY == 0)
    return m.select(name_key("pert_iname").alias("drug")).where("drug <> ''").distinct()


def drug_genes(spark: SparkSession, sf: str, top_pct: float = TOP_PCT) -> DataFrame:
    p = profiles.profiles(compound_values(spark, sf))
    return profiles.top_fraction(p, top_pct=top_pct).withColumnRenamed("compound", "drug")


def drug_modules(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.drug_union(drug_genes(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Each scored pair of a run and disease once, with a score and a disease."""
    p = table(spark, sf, "predictions").where("disease is not null and prediction_score is not null and not isnan(prediction_score)")
    g = p.groupBy("run_id", "disease", lo("drug_a", "drug_b").alias("drug_a"), hi("drug_a", "drug_b").alias("drug_b"))
    first = F.min_by(F.struct("tqab", "pqab", "cqab", "topology_class"), "prediction_id")
    return g.agg(F.max("prediction_score").alias("prediction_score"), first.alias("f")).select("run_id", "disease", "drug_a", "drug_b", "prediction_score", "f.*")


def known(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that some run calls complementary: the stand-in for a synergy resource, which no table holds."""
    p = table(spark, sf, "predictions").where("topology_class = 'complementary_exposure'")
    return p.select(lo("drug_a", "drug_b").alias("drug_lo"), hi("drug_a", "drug_b").alias("drug_hi")).distinct()
