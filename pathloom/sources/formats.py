"""Scans of the source files, each with a declared schema of what is read.

Delimited files are read with their header and every column as a string, since
ids such as 672 must stay strings; numbers are cast where they are numbers.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

INTERACTIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("protein_a", "protein_b", "source", "interaction_type")])

#: Names that a metadata file may give these columns, in order of preference.
SIGNATURE_ID_NAMES = ("sig_id", "signature_id", "distil_id", "pert_sig_id", "id")
COMPOUND_NAMES = ("pert_iname", "pert_desc", "pert_name", "drug_name", "compound", "pert_id")


def detect_column(df: DataFrame, candidates: Sequence[str], what: str) -> str:
    """The first of ``candidates`` that ``df`` has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"no column for {what}: tried {list(candidates)}, found {df.columns}")


def file_order() -> Column:
    """Where a row stands in its files: file, split of the file, row within the split."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return F.struct(at.alias("split"), F.monotonically_increasing_id().alias("row"))


def _delimited(spark: SparkSession, path: str, sep: str = "\t", comment: str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    return (r.option("comment", comment) if comment else r).csv(path)


def _with_constants(df: DataFrame, source: str, kind: str) -> DataFrame:
    return df.withColumns({"source": F.lit(source), "interaction_type": F.lit(kind)})


def read_huri(spark: SparkSession, path: str) -> DataFrame:
    df = _delimited(spark, path, comment="#").select(F.col("Symbol A").alias("protein_a"), F.col("Symbol B").alias("protein_b"))
    return _with_constants(df.where("protein_a is not null and protein_b is not null"), "HuRI", "PPI")


def read_corum(spark: SparkSession, path: str) -> DataFrame:
    """All pairs by position of each human complex; ``complex_id`` is kept, repeated pairs are, too."""
    df = _delimited(spark, path).where(F.col("Organism") == "Human")
    genes = F.filter(F.transform(F.split("subunits(Gene name)", ";"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    m = df.select(F.col("ComplexID").alias("complex_id"), F.posexplode(F.coalesce(genes, F.array().cast("array<string>"))).alias("pos", "gene"))
    from pathloom.operators.graph import complex_pairs

    return _with_constants(complex_pairs(m), "CORUM", "complex").select("protein_a", "protein_b", "source", "interaction_type", "complex_id")


def read_phosphosite(spark: SparkSession, path: str, skip: int = 3) -> DataFrame:
    """Human kinase and substrate pairs; the first ``skip`` lines are a notice, the next one the header."""
    lines = spark.read.text(path)
    head = [r[0] for r in lines.limit(skip + 1).collect()]
    if len(head) <= skip:
        return spark.createDataFrame([], INTERACTIONS)
    header = head[skip].split("\t")
    cell = lambda name: F.get(F.split("value", "\t"), header.index(name))
    body = lines.where(~F.col("value").isin(head)).where((cell("KIN_ORGANISM") == "human") & (cell("SUB_ORGANISM") == "human"))
    return _with_constants(body.select(cell("KINASE").alias("protein_a"), cell("SUBSTRATE").alias("protein_b")), "PhosphoSitePlus", "phosphorylation").distinct()


def read_kegg_rpair(spark: SparkSession, path: str) -> DataFrame:
    """Not read by anyone yet: an empty table of the right schema."""
    return spark.createDataFrame([], INTERACTIONS)


INTERACTION_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"huri": read_huri, "corum": read_corum, "phosphositeplus": read_phosphosite, "kegg_rpair": read_kegg_rpair}


def read_interactions(spark: SparkSession, files: dict[str, str]) -> dict[str, DataFrame]:
    """Source name -> table; unknown sources are skipped with a warning."""
    if unknown := [s for s in files if s.lower() not in INTERACTION_READERS]:
        log.warning("no reader for %s; known sources: %s", unknown, sorted(INTERACTION_READERS))
    return {s: INTERACTION_READERS[s.lower()](spark, p) for s, p in files.items() if s.lower() in INTERACTION_READERS}


def read_creeds(spark: SparkSession, path: str) -> DataFrame:
    """(disease, gene, direction), repeats kept; directions other than up and down ignored."""
    df = _delimited(spark, path).select(F.col("disease_name").alias("disease"), F.col("gene_symbol").alias("gene"), "direction")
    return df.where("direction in ('up', 'down') and disease is not null and gene is not null")


def read_signature_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(gene, sig_id, fold_change) of a matrix with genes in its first column."""
    df = _delimited(spark, path)
    gene, *sigs = df.columns
    long = df.unpivot([gene], sigs, "sig_id", "v")
    return long.select(F.col(gene).alias("gene"), "sig_id", F.col("v").try_cast("double").alias("fold_change"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, sig_id, pert_iname), columns detected by name, ``row_id`` in file order."""
    df = _delimited(spark, path)
    s, c = detect_column(df, SIGNATURE_ID_NAMES, "signature id"), detect_column(df, COMPOUND_NAMES, "compound name")
    return df.select(file_order().alias("row_id"), F.col(s).alias("sig_id"), F.col(c).alias("pert_iname"))


def read_lincs(spark: SparkSession, signatures: str, metadata: str, top_pct: float = 0.05, method: str = "median") -> DataFrame:
    """(compound, gene, direction): top and bottom fractions of the aggregated profiles."""
    from pathloom.functions.columns import AGGREGATES
    from pathloom.operators.profiles import join_metadata, profiles, top_fraction

    if not 0 < top_pct <= 1:
        raise ValueError(f"top_pct must be in (0, 1], not {top_pct}")
    if method not in AGGREGATES:
        raise ValueError(f"unknown aggregate {method!r}")
    joined = join_metadata(read_signature_matrix(spark, signatures), read_metadata(spark, metadata))
    if joined.isEmpty():
        raise ValueError("no signature of the matrix has metadata")
    return top_fraction(profiles(joined, method), top_pct=top_pct)


def read_hgnc(spark: SparkSession, path: str) -> DataFrame:
    """(row, symbol, entrez_id); a missing file gives an empty table."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "row bigint, symbol string, entrez_id bigint")
    return _delimited(spark, path).select(file_order().alias("row"), "symbol", F.col("entrez_id").try_cast("bigint").alias("entrez_id"))


def read_known_pairs(spark: SparkSession, path: str, disease: str | None = None) -> DataFrame:
    """(drug_lo, drug_hi): known pairs, unordered; a missing file gives none, the disease filter ignores case."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "drug_lo string, drug_hi string")
    df = _delimited(spark, path, sep=",")
    if disease is not None and "disease" in df.columns:
        df = df.where(F.lower("disease") == disease.lower())
    return known_pairs(df)


def known_pairs(df: DataFrame) -> DataFrame:
    a, b = (F.btrim(F.col(c), F.lit(" \t\r\n")) for c in ("drug_a", "drug_b"))
    d = df.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    return d.select(F.least("a", "b").alias("drug_lo"), F.greatest("a", "b").alias("drug_hi")).distinct()


def read_drugcombdb(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, sep=",").withColumnsRenamed({"Drug1": "drug_a", "Drug2": "drug_b", "Disease": "disease", "Synergy_Score": "synergy_score"})


def read_modules(spark: SparkSession, path: str) -> DataFrame:
    """(module, gene) of a module file; a drug file's ``drug`` column will do, too."""
    df = _delimited(spark, path, sep=",")
    return df.select(F.col(detect_column(df, ("module", "drug"), "module")).alias("module"), "gene")


def read_drug_modules(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, sep=",").select("drug", "gene", "direction")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(gene_a, gene_b) of a parquet folder, an edge list or a GraphML file, by suffix."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "edgelist":
        e = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where("size(p) >= 2 and not startswith(p[0], '#')")
        pairs = e.select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    elif kind == "graphml":
        schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType())])
        pairs = spark.read.format("xml").option("rowTag", "edge").schema(schema).load(path).select(F.col("_source").alias("a"), F.col("_target").alias("b"))
    else:
        raise ValueError(f"unknown graph format of {path!r}")
    return pairs.select(F.least("a", "b").alias("gene_a"), F.greatest("a", "b").alias("gene_b"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_predictions`` wrote; nothing there gives an empty table with a warning."""
    from pyspark.errors import AnalysisException

    schema = "drug_a string, drug_b string, tqab double, pqab double, cqab double, prediction_score double, topology_class string, pqa double, pqb double, cqa double, cqb double, disease string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        log.warning("no predictions at %s", path)
        return spark.createDataFrame([], schema)


def read_symbol_cache(spark: SparkSession, path: str) -> DataFrame:
    """(id, from_type, symbol) of a JSON object of symbols by id, one object a line; NULL means looked up and not found.

    A missing or unreadable cache gives an empty table with a warning.
    """
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException:
        log.warning("no symbol cache at %s", path)
        return spark.createDataFrame([], "id string, from_type string, symbol string")
    o = lines.where("trim(value) <> ''").select(F.from_json("value", "map<string,string>").alias("o"))
    if not o.where("o is null").isEmpty():
        log.warning("the symbol cache at %s is corrupt and ignored", path)
        o = o.where("false")
    return o.select(F.explode("o").alias("id", "symbol")).select("id", F.lit("auto").alias("from_type"), "symbol")
