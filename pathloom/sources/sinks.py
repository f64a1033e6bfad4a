"""Writers for graphs, modules, predictions, reports and the lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.evaluation import report


def write_graph(edges: DataFrame, path: str) -> None:
    """Parquet keeps ``sources`` as an array, GraphML joins it by ``;``; an edge list keeps the ends only.

    The parts of a GraphML folder, in the order of their names, make up one document.
    """
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "parquet":
        edges.write.mode("overwrite").parquet(path)
    elif kind == "edgelist":
        edges.select(F.concat_ws(" ", "gene_a", "gene_b").alias("value")).write.mode("overwrite").text(path)
    elif kind == "graphml":
        _graphml(edges).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown graph format of {path!r}")


def _graphml(edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document in order: ranges of lines, so that no task holds the whole graph."""
    text = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    names = [c for c in ("sources", "interaction_type") if c in edges.columns]
    value = {c: F.array_join(c, ";") if c == "sources" else F.col(c) for c in names}
    data = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), text(value[c]), F.lit("</data>"))).otherwise("") for c in names]
    ends = F.concat(F.lit('<edge source="'), text(F.col("gene_a")), F.lit('" target="'), text(F.col("gene_b")), F.lit('">'))
    lines = edges.select(F.lit(1).alias("o"), F.concat_ws(" ", "gene_a", "gene_b").alias("k"), F.concat(ends, *data, F.lit("</edge>")).alias("value"))
    keys = "".join(f'<key id="{c}" for="edge" attr.name="{c}" attr.type="string"/>' for c in names)
    frame = [(0, "", f'<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'), (2, "", "</graph></graphml>")]
    lines = lines.unionByName(edges.sparkSession.createDataFrame(frame, "o int, k string, value string"))
    return lines.orderBy("o", "k").select("value")


def write_modules(modules: DataFrame, path: str) -> None:
    modules.select("module", "gene").write.mode("overwrite").option("header", True).csv(path)


def write_drug_modules(drug_genes: DataFrame, path: str) -> None:
    drug_genes.select("drug", "gene", "direction").write.mode("overwrite").option("header", True).csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").partitionBy("disease").parquet(path)


def write_report(evaluation: DataFrame, path: str) -> None:
    report(evaluation).write.mode("overwrite").option("header", True).csv(path)


def write_id_map(id_map: DataFrame, path: str) -> None:
    id_map.write.mode("overwrite").parquet(path)


def write_symbol_cache(id_map: DataFrame, path: str) -> None:
    """A JSON object a line, together the symbols by id; NULL symbols are kept."""
    entry = F.concat(F.to_json(F.array("id")), F.lit(":"), F.coalesce(F.to_json(F.array("symbol")), F.lit("[null]")))
    entry = F.regexp_replace(entry, r'^\[(.*)\]:\[(.*)\]$', "{$1:$2}")
    id_map.select(entry.alias("value")).write.mode("overwrite").text(path)
