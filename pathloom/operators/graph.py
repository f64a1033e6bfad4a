"""The interaction graph as edge and node tables.

Edges are canonical (gene_a < gene_b), without self-loops and parallel edges;
``adjacency`` gives both directions. Rows with a NULL end join nothing, an empty
table gives an empty graph, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.columns import hi, lo, symbol_key
from pathloom.operators.components import connected, reach_from_hub
from pathloom.operators.numbering import number
from pathloom.storage import Scratch, measured, rows, sized

if TYPE_CHECKING:
    from pathloom.operators.compact import Compact, Graph


def union_sources(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Bag union of interaction tables in the order given; ``seq`` (number of the table, row in it) keeps that order."""
    if not tables:
        raise ValueError("no sources to build from")
    out = None
    for i, df in enumerate(tables.values()):
        t = df.withColumn("seq", F.struct(F.lit(i).alias("table"), F.monotonically_increasing_id().alias("row")))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def harmonize_ends(interactions: DataFrame, id_map: DataFrame | None = None) -> DataFrame:
    """Ends as gene symbols: through ``id_map(id, symbol)`` if given, else by their key; rows without both ends go."""
    if id_map is None:
        df = interactions.withColumns({"protein_a": symbol_key("protein_a"), "protein_b": symbol_key("protein_b")})
    else:
        m = id_map.select("id", "symbol")
        df = interactions
        for end in ("protein_a", "protein_b"):
            df = df.join(m.withColumnsRenamed({"id": end, "symbol": f"_{end}"}), end, "left").drop(end).withColumnRenamed(f"_{end}", end)
    return df.where(F.col("protein_a").isNotNull() & F.col("protein_b").isNotNull())


def merge_edges(interactions: DataFrame, seq: str = "seq") -> DataFrame:
    """Parallel edges merged: distinct ``sources`` in order of first arrival, ``n_rows``, ``interaction_type`` of the first row.

    Counts stand for repeated sources, so an edge of any number of rows stays one small row.
    """
    e = interactions.where(F.col("protein_a") != F.col("protein_b"))
    e = e.select(lo("protein_a", "protein_b").alias("gene_a"), hi("protein_a", "protein_b").alias("gene_b"), "source", "interaction_type", F.col(seq).alias("seq"))
    per = e.groupBy("gene_a", "gene_b", "source").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.min_by("interaction_type", "seq").alias("t"))
    g = per.groupBy("gene_a", "gene_b").agg(F.array_sort(F.collect_list(F.struct("seq", "source"))).alias("s"), F.sum("n").alias("n_rows"), F.min_by("t", "seq").alias("interaction_type"))
    return g.select("gene_a", "gene_b", F.array_compact(F.transform("s", lambda x: x["source"])).alias("sources"), "n_rows", "interaction_type")


def edge_sources(interactions: DataFrame, seq: str = "seq") -> DataFrame:
    """(gene_a, gene_b, pos, source): the source of every row of an edge in order of arrival, NULL and repeats included.

    The list that belongs to an edge, as rows: an edge of any number of rows is never one value.
    """
    e = interactions.where(F.col("protein_a") != F.col("protein_b"))
    e = e.select(lo("protein_a", "protein_b").alias("gene_a"), hi("protein_a", "protein_b").alias("gene_b"), F.struct(F.col(seq), "source").alias("_r"))
    return number(e, "_r", ["gene_a", "gene_b"], "pos").select("gene_a", "gene_b", "pos", "_r.source")


def simple_edges(interactions: DataFrame) -> DataFrame:
    """(gene_a, gene_b) of ``merge_edges`` without what it collects per edge."""
    e = interactions.where(F.col("protein_a") != F.col("protein_b"))
    return e.select(lo("protein_a", "protein_b").alias("gene_a"), hi("protein_a", "protein_b").alias("gene_b")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst), each edge in both directions."""
    ab = F.array(F.struct(F.col("gene_a").alias("src"), F.col("gene_b").alias("dst")), F.struct(F.col("gene_b").alias("src"), F.col("gene_a").alias("dst")))
    return edges.select(F.explode(ab).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(gene, degree) of every node with an edge."""
    return adjacency(edges).groupBy(F.col("src").alias("gene")).agg(F.count("*").alias("degree"))


def _lo_hi(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("gene_a").alias("lo"), F.col("gene_b").alias("hi"))


def components(edges: DataFrame) -> DataFrame:
    """(component, gene): the smallest gene of each component names it."""
    scratch = Scratch(edges.sparkSession, "components")
    got = connected(scratch.cut(_lo_hi(edges), "edges"), scratch)
    return got.select(F.col("group").alias("component"), F.col("member").alias("gene"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """(component, n_genes)."""
    return components(edges).groupBy("component").agg(F.count("*").alias("n_genes"))


def is_connected(edges: DataFrame) -> bool:
    """Whether all nodes form one component; an empty graph is refused."""
    n = components(edges).select("component").distinct().limit(2).count()
    if not n:
        raise ValueError("an empty graph is neither connected nor not")
    return n == 1


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component; of equal ones, that with the smallest gene.

    A graph that a task can hold is labelled there. Of a larger one, what the highest-degree
    gene reaches is the answer if it has more genes than the edges left could join; only
    otherwise are the other components labelled.
    """
    from pathloom.operators.compact import outside_largest

    scratch = Scratch(edges.sparkSession, "lcc")
    e = scratch.cut(_lo_hi(edges), "edges")
    if (outside := outside_largest(e)) is not None:
        outside = scratch.cut(outside, "outside")
        return _as_written(edges, e).where("gene_a is not null").join(sized(outside).withColumnRenamed("gene", "gene_a"), "gene_a", "left_anti").select(*edges.columns)
    peeled, complete = reach_from_hub(e, scratch)
    rest = scratch.cut(e.join(peeled.withColumnRenamed("node", "lo"), "lo", "left_anti"), "rest")
    genes = peeled
    if rows(rest) + 1 >= rows(peeled):
        others = scratch.cut(connected(rest, scratch), "labels")
        top = others.groupBy("group").count().orderBy(F.desc("count"), "group").first()
        first = measured(peeled).get("least")
        if top and (-top["count"], top["group"]) < (-rows(peeled), first):
            genes = others.where(F.col("group") == top["group"]).select(F.col("member").alias("node"))
    return _as_written(edges, e).join(genes.withColumnRenamed("node", "gene_a"), "gene_a", "left_semi")


def _as_written(edges: DataFrame, e: DataFrame) -> DataFrame:
    """``edges`` read from the table ``e(lo, hi)`` instead of made again, if they have no other columns."""
    if sorted(edges.columns) != ["gene_a", "gene_b"]:
        return edges
    return e.select(F.col("lo").alias("gene_a"), F.col("hi").alias("gene_b")).select(*edges.columns)


def build_graph(tables: Mapping[str, DataFrame], id_map: DataFrame | None = None) -> DataFrame:
    """Sources to the merged edges of their largest component."""
    return largest_component(merge_edges(harmonize_ends(union_sources(tables), id_map)))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average degree, components, average clustering and diameter.

    Triangles are found by joining each edge with the neighbours of its ends, ordered
    by (degree, gene), so a hub's neighbour pairs are never enumerated. The diameter is
    NULL unless the graph is connected. A graph that a task can hold is counted there.
    """
    from pathloom.operators.compact import compact
    from pathloom.operators.distances import eccentricity

    if (g := compact(edges)) is not None:
        return _compact_stats(edges, g)
    deg = degrees(edges)
    rank = F.struct("degree", "gene")
    e = edges.join(deg.select(F.col("gene").alias("gene_a"), rank.alias("ra")), "gene_a")
    e = e.join(deg.select(F.col("gene").alias("gene_b"), rank.alias("rb")), "gene_b")
    up = e.select(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))
    up = up.select(F.col("x.gene").alias("s"), F.col("y.gene").alias("t"), F.col("y.degree").alias("td"))
    later = (F.col("p.td") < F.col("q.td")) | ((F.col("p.td") == F.col("q.td")) & (F.col("p.t") < F.col("q.t")))
    two = up.alias("p").join(up.alias("q"), F.col("p.s") == F.col("q.s")).where(later)
    tri = two.select(F.col("p.s").alias("a"), F.col("p.t").alias("s"), F.col("q.t").alias("t")).join(up.select("s", "t"), ["s", "t"])
    per = tri.select(F.explode(F.array("a", "s", "t")).alias("gene")).groupBy("gene").agg(F.count("*").alias("tri"))
    k = F.col("degree")
    cl = deg.join(per, "gene", "left").select("degree", F.when(k < 2, 0.0).otherwise(2.0 * F.coalesce("tri", F.lit(0)) / (k * (k - 1))).alias("c"))
    base = cl.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"), F.avg("c").alias("avg_clustering"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    sizes = component_sizes(edges).agg(F.count("*")).first()[0]
    diameter = F.lit(eccentricity(edges).agg(F.max("eccentricity")).first()[0] if sizes == 1 else None).cast("int")
    return base.select(
        "n_nodes",
        "n_edges",
        F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0).alias("density"),
        F.coalesce(F.try_divide(2.0 * m, n), F.lit(0.0)).alias("avg_degree"),
        F.lit(sizes).alias("n_components"),
        F.coalesce("avg_clustering", F.lit(0.0)).alias("avg_clustering"),
        diameter.alias("diameter"),
    )


def _compact_stats(edges: DataFrame, g: Compact) -> DataFrame:
    """``graph_stats`` of a graph that a task holds; each task counts the triangles of a part of the nodes."""
    from pathloom.operators.distances import farthest, hub_hops

    def run(graph: Graph, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"triangles": [graph.triangles(part, parts).tobytes()], "degree": [graph.degree.astype(np.int64).tobytes() if part == 0 else None]})

    triangles, k = np.zeros(g.n, np.int64), np.zeros(g.n, np.int64)
    for r in g.tasks(run, "triangles binary, degree binary", int(g.spark.conf.get("spark.sql.shuffle.partitions"))).toLocalIterator():
        triangles = triangles + np.frombuffer(r["triangles"], np.int64)
        k = np.frombuffer(r["degree"], np.int64) if r["degree"] else k
    c = 2.0 * triangles / np.maximum(k * (k - 1), 1)
    away = hub_hops(g)
    whole = g.n > 0 and bool((away >= 0).all())
    sizes = 1 if whole else component_sizes(edges).count()
    diameter = farthest(g, away) if whole else None
    n, m = g.n, g.m // 2
    row = (n, m, 2.0 * m / (n * (n - 1)) if n > 1 else 0.0, 2.0 * m / n if n else 0.0, sizes, float(c.sum() / n) if n else 0.0, diameter)
    return g.spark.createDataFrame([row], "n_nodes bigint, n_edges bigint, density double, avg_degree double, n_components int, avg_clustering double, diameter int")


def complex_pairs(members: DataFrame) -> DataFrame:
    """All pairs by position of each complex: ``members(complex_id, pos, gene)`` to (complex_id, protein_a, protein_b).

    A complex is a fixed list of subunits; the join is within a complex by design.
    """
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, F.col("a.complex_id") == F.col("b.complex_id")).where("a.pos < b.pos").select("a.complex_id", F.col("a.gene").alias("protein_a"), F.col("b.gene").alias("protein_b"))


def per_source_counts(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("source").agg(F.count("*").alias("n_rows"))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with an equal key the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
