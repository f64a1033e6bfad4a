"""Hop distances by breadth-first joins, many sources at once.

One search serves all modules: a node carries bitmaps of the modules that reach
it, 64 modules to a word, and a level ORs the words of a node's neighbours with
map-side combine. Words are compared with the two levels before, which suffices
in an undirected graph. Each level is a table in the shared folder.

A graph that a task can hold (``compact``) is searched there instead, by the operators that
return less than the search: nothing but keys and results then leaves a task.

Genes outside the graph take no part. Distances to an empty module are
``INFINITY``; a module of one gene has no distance to itself (0.0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.columns import DUST, INFINITY, tidy
from pathloom.operators import nearest
from pathloom.operators.compact import Compact, Graph, compact
from pathloom.operators.graph import adjacency
from pathloom.operators.numbering import number
from pathloom.storage import BROADCAST_ROWS, Scratch, rows, sized

WORD = 64


def in_network(genes: DataFrame, edges: DataFrame, gene: str = "gene") -> DataFrame:
    """Rows whose gene is a node of the graph."""
    nodes = adjacency(edges).select(F.col("src").alias(gene)).distinct()
    return genes.join(nodes, gene, "left_semi")


class Reach:
    """A finished search: bitmaps (node, word, bits) per level, and the numbers of the keys."""

    def __init__(self, levels: list[DataFrame], numbers: DataFrame, key: str):
        self.levels, self.numbers, self.key = levels, numbers, key

    def bits(self) -> DataFrame:
        """(node, word, bits, hops): the keys that reach a node over exactly ``hops`` edges."""
        out = None
        for h, level in enumerate(self.levels):
            part = level.withColumn("hops", F.lit(h))
            out = part if out is None else out.unionByName(part)
        return out

    def table(self, nodes: DataFrame | None = None) -> DataFrame:
        """(key, node, hops) for each node a key reaches, or for ``nodes(node)`` only."""
        b = self.bits()
        if nodes is not None:
            b = b.join(nodes.select("node").distinct(), "node", "left_semi")
        places = F.expr(f"filter(sequence(0, {WORD - 1}), i -> getbit(bits, i) = 1)")
        flat = b.select("node", "hops", "word", F.explode(places).alias("_at")).select("node", "hops", (F.col("word") * WORD + F.col("_at")).alias("_i"))
        names = self.numbers.select(self.key, F.col("_i"))
        names = F.broadcast(names) if rows(self.numbers) <= BROADCAST_ROWS else names
        return flat.join(names, "_i").select(self.key, "node", "hops")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``wanted(key, node, ...)`` with ``hops``; rows whose key does not reach the node go."""
        w = wanted.join(self.numbers, self.key)
        w = w.withColumn("word", F.floor(F.col("_i") / WORD).cast("int")).withColumn("_at", (F.col("_i") % WORD).cast("int"))
        hit = w.join(self.bits(), ["node", "word"]).where("getbit(bits, _at) = 1")
        return hit.select(*wanted.columns, "hops")


def search(edges: DataFrame, sources: DataFrame, key: str = "module", max_hops: int | None = None) -> Reach:
    """Breadth-first search from the genes of each key; ``sources`` is (key, gene)."""
    scratch = Scratch(edges.sparkSession, "search")
    adj = scratch.cut(adjacency(edges), "adjacent")
    start = sources.select(key, F.col("gene").alias("node")).where(F.col(key).isNotNull() & F.col("node").isNotNull()).distinct()
    start = scratch.cut(start.join(adj.select(F.col("src").alias("node")), "node", "left_semi"), "start")
    numbers = number(start.select(key).distinct(), key, out="_i")
    at = start.join(sized(numbers), key)
    word, bit = F.floor(F.col("_i") / WORD).cast("int"), F.expr(f"shiftleft(1L, cast(_i % {WORD} as int))")
    levels = [scratch.cut(at.groupBy("node", word.alias("word")).agg(F.bit_or(bit).alias("bits")), "level")]
    while rows(levels[-1]) and (max_hops is None or len(levels) <= max_hops):
        step = adj.join(_renamed(levels[-1]), "src")
        step = step.groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        for i, near in enumerate(levels[-2:]):
            old = near.select("node", "word", F.col("bits").alias(f"_b{i}"))
            old = F.broadcast(old) if rows(near) <= BROADCAST_ROWS else old.hint("merge")
            step = step.join(old, ["node", "word"], "left")
            step = step.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(f"_b{i}", F.lit(0).cast("bigint"))))).drop(f"_b{i}")
        step = scratch.cut(step.where("bits <> 0"), "level")
        if not rows(step):
            break
        levels.append(step)
    scratch.drop(adj, start)
    return Reach(levels, numbers, key)


def _renamed(level: DataFrame) -> DataFrame:
    out = level.withColumnRenamed("node", "src")
    return F.broadcast(out) if rows(level) <= BROADCAST_ROWS else out.hint("merge")


def bfs(edges: DataFrame, sources: DataFrame, key: str = "module", max_hops: int | None = None) -> DataFrame:
    """(key, node, hops): distance of each node to the sources of each key. Nodes that no source reaches are absent."""
    if max_hops is None and (g := compact(edges)) is not None:
        return nearest.reached(g, sources, key)
    return search(edges, sources, key, max_hops).table()


def module_distances(edges: DataFrame, sources: DataFrame, targets: DataFrame, to: Reach | None = None, digits: int | None = None) -> DataFrame:
    """(source, target, d): mean over a source module's genes of the hops to the nearest gene of a target module.

    ``sources`` is (source, gene), ``targets`` (target, gene). Pairs of which one side is
    empty within the graph are absent; callers take ``INFINITY`` for them. ``to`` is
    ``search(edges, targets, 'target')`` if at hand. ``d`` is rounded to ``digits``, if given.
    """
    if to is None and (g := compact(edges)) is not None and (cut := nearest.cut_members(edges, sources, "source")) is not None:
        return nearest.distances(g, cut, targets.select("target", "gene").where("target is not null and gene is not null").distinct(), digits)
    src = in_network(sources.select("source", "gene").distinct(), edges)
    to = search(edges, targets, "target") if to is None else to
    n = src.groupBy("source").agg(F.count("*").alias("n"))
    near = to.table(src.select(F.col("gene").alias("node"))).withColumnRenamed(to.key, "target")
    s = src.join(near, F.col("gene") == F.col("node")).groupBy("source", "target").agg(F.sum("hops").alias("h"), F.count("*").alias("k"))
    d = (F.col("h") + INFINITY * (F.col("n") - F.col("k"))) / F.col("n")
    return s.join(n, "source").select("source", "target", (d if digits is None else tidy(d, digits)).alias("d"))


def both_ways(edges: DataFrame, diseases: DataFrame, drugs: DataFrame, digits: int | None = None) -> DataFrame:
    """(disease, drug, d_qx, d_xq): ``module_distances`` of ``diseases(disease, gene)`` to ``drugs(drug, gene)``, and back, beside each other."""
    if (g := compact(edges)) is not None:
        q, x = nearest.cut_members(edges, diseases, "disease"), nearest.cut_members(edges, drugs, "drug")
        if q is not None and x is not None:
            return nearest.both_ways(g, q, x, digits)
    a = module_distances(edges, diseases.withColumnRenamed("disease", "source"), drugs.withColumnRenamed("drug", "target"), digits=digits)
    b = module_distances(edges, drugs.withColumnRenamed("drug", "source"), diseases.withColumnRenamed("disease", "target"), digits=digits)
    a = a.withColumnsRenamed({"source": "disease", "target": "drug", "d": "d_qx"})
    return a.join(b.withColumnsRenamed({"source": "drug", "target": "disease", "d": "d_xq"}), ["disease", "drug"]).select("disease", "drug", "d_qx", "d_xq")


def self_distances(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, d): mean over a module's genes of the hops to the nearest *other* gene of it.

    The genes of a module are numbered. Two genes differ in some binary digit of their
    numbers, so a gene's nearest other one is the nearest of those that differ from it in
    one digit, over all digits: a search from two halves of the module per digit.
    A gene that reaches no other one counts ``INFINITY``; a module of one gene gives 0.0.
    """
    m = in_network(modules.select("module", "gene").where("module is not null").distinct(), edges)
    m = number(m, "gene", ["module"], "pos")
    digits = F.greatest(F.ceil(F.log2(F.count("*").over(Window.partitionBy("module")))), F.lit(1)).cast("int")
    d = m.withColumn("digits", digits).withColumn("digit", F.explode(F.sequence(F.lit(0), F.col("digits") - 1)))
    side = F.expr("getbit(cast(pos as bigint), digit)").cast("int")
    half = lambda s: F.concat_ws("|", F.col("digit").cast("string"), s.cast("string"), "module")
    scratch = Scratch(edges.sparkSession, "halves")
    d = scratch.cut(d.select("module", "gene", half(side).alias("own"), half(1 - side).alias("half")), "halves")
    found = search(edges, d.select(F.col("own").alias("half"), "gene"), "half")
    near = found.lookup(d.select("module", "half", F.col("gene").alias("node"))).groupBy("module", F.col("node").alias("gene")).agg(F.min("hops").alias("d"))
    per = m.join(near, ["module", "gene"], "left").groupBy("module").agg(F.count("*").alias("n"), F.avg(F.coalesce("d", F.lit(INFINITY))).alias("d"))
    return per.select("module", F.when(F.col("n") > 1, F.col("d")).otherwise(0.0).alias("d"))


def separations(edges: DataFrame, modules: DataFrame, pairs: DataFrame) -> DataFrame:
    """(module_a, module_b, s_ab) for ``pairs(module_a, module_b)``.

    s = (d_ab + d_ba) / 2 - (d*_aa + d*_bb) / 2. Two empty modules give 0.0, an empty
    one against another gives INFINITY - (INFINITY + d*) / 2.
    """
    m = modules.select("module", "gene").distinct()
    if (g := compact(edges)) is not None and (cut := nearest.cut_members(edges, m, "module")) is not None and (s := nearest.separations(g, cut, pairs)) is not None:
        return s
    scratch = Scratch(edges.sparkSession, "separations")
    cross = module_distances(edges, m.withColumnRenamed("module", "source"), m, to=search(edges, m, "module"))
    cross, own = scratch.cut(cross, "cross"), scratch.cut(self_distances(edges, m), "own")
    p = pairs.select("module_a", "module_b")
    p = p.join(cross.withColumnsRenamed({"source": "module_a", "target": "module_b", "d": "ab"}), ["module_a", "module_b"], "left")
    p = p.join(cross.withColumnsRenamed({"source": "module_b", "target": "module_a", "d": "ba"}), ["module_a", "module_b"], "left")
    for side in ("a", "b"):
        p = p.join(own.withColumnsRenamed({"module": f"module_{side}", "d": f"d{side}"}), f"module_{side}", "left")
    inf = F.lit(INFINITY)
    s = (F.coalesce("ab", inf) + F.coalesce("ba", inf)) / 2 - (F.coalesce("da", inf) + F.coalesce("db", inf)) / 2
    return p.select("module_a", "module_b", (F.round(s, DUST) + F.lit(0.0)).alias("s_ab"))


def pairwise_distances(edges: DataFrame, genes: DataFrame, to: DataFrame | None = None) -> DataFrame:
    """(gene_a, gene_b, hops) from ``genes`` to ``to``, or within one gene set; (i, i) included, unreachable pairs absent."""
    g = genes.select("gene").distinct()
    found = search(edges, g.select(F.col("gene").alias("gene_a"), "gene"), "gene_a")
    far = (g if to is None else to.select("gene").distinct()).select(F.col("gene").alias("node"))
    return found.table(far).select("gene_a", F.col("node").alias("gene_b"), "hops")


def eccentricity(edges: DataFrame) -> DataFrame:
    """(gene, eccentricity) of every node; the largest is the diameter of its component."""
    if (g := compact(edges)) is not None:
        return _eccentricity(g)
    nodes = adjacency(edges).select(F.col("src").alias("gene")).distinct()
    found = search(edges, nodes.select(F.col("gene").alias("start"), "gene"), "start")
    far = found.bits().groupBy("word", "hops").agg(F.bit_or("bits").alias("bits"))  # which starts still reach anything that far
    last = far.select("hops", "word", F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), i -> getbit(bits, i) = 1)")).alias("_at"))
    last = last.groupBy((F.col("word") * WORD + F.col("_at")).alias("_i")).agg(F.max("hops").alias("eccentricity"))
    return last.join(found.numbers, "_i").select(F.col("start").alias("gene"), "eccentricity")


def hub_hops(g: Compact) -> np.ndarray:
    """Hops of each node of a compact graph from its first one, the hub; -1 where there is no way."""

    def run(graph: Graph, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"hops": [_from_hub(graph).tobytes()]})

    return np.frombuffer(g.tasks(run, "hops binary", 1).first()["hops"], np.int32)


def _from_hub(graph: Graph) -> np.ndarray:
    far = np.full(graph.n, -1, np.int32)
    for h, (new, _) in enumerate(graph.levels(np.zeros(min(1, graph.n), np.int64), np.zeros(min(1, graph.n), np.int64), 1)):
        far[new[:, 0] != 0] = h
    return far


def farthest(g: Compact, away: np.ndarray) -> int:
    """Diameter of a connected compact graph, of whose nodes ``away`` are the hops from the hub.

    Nodes are searched from, the farthest from the hub first. Two that are left are at most twice as far
    from each other as the farther of them is from the hub; once a search went as far, none goes farther.
    """
    order, parts = np.argsort(-away, kind="stable"), int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    width, most, done, size = 64 * g.width(16), int(away.max(initial=0)), 0, 64
    while done < g.n and most < 2 * away[order[done]]:

        def run(graph: Graph, part: int, parts: int, lo: int = done, hi: int = done + size) -> Iterator[pa.RecordBatch]:
            mine = np.argsort(-_from_hub(graph), kind="stable")[lo:hi][part::parts]
            far = 0
            for a in range(0, len(mine), width):
                some = mine[a : a + width]
                far = max(far, sum(1 for _ in graph.levels(some, np.arange(len(some)), len(some))) - 1)
            yield pa.RecordBatch.from_pydict({"far": [far]})

        most = max(most, *(r["far"] for r in g.tasks(run, "far long", 1 if size == 64 else parts).collect()))
        done, size = done + size, min(8 * size if size > 64 else 64 * parts, width * parts)
    return most


def _eccentricity(g: Compact) -> DataFrame:
    """Searches from the nodes that are farthest from the hub, level by level, until no other node can be farther.

    A node ``a`` hops from the hub is at most ``a + k`` hops from any node on level k. Once the searches
    from all levels above k found one at least that far, the farthest of those is its eccentricity.
    Nodes that the hub doesn't reach are all searched from.
    """
    away, parts = hub_hops(g), int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    width = 64 * g.width(16)
    most, done_to = np.zeros(g.n, np.int32), int(away.max(initial=-1)) + 1
    alone = away < 0
    while done_to > 0 or alone.any():
        at, to = alone.sum(), done_to
        while to > 0 and at < width * parts:  # levels that fill a round
            to -= 1
            at += (away == to).sum()

        def run(graph: Graph, part: int, parts: int, lo: int = to, hi: int = done_to, lost: bool = bool(alone.any())) -> Iterator[pa.RecordBatch]:
            hub = _from_hub(graph)
            mine = np.flatnonzero(((hub >= lo) & (hub < hi)) | ((hub < 0) & lost))[part::parts]
            far = np.zeros(graph.n, np.int32)
            for a in range(0, len(mine), width):
                some = mine[a : a + width]
                for h, (new, _) in enumerate(graph.levels(some, np.arange(len(some)), len(some))):
                    far[new.any(axis=1)] = h
            yield pa.RecordBatch.from_pydict({"far": [far.tobytes()]})

        for r in g.tasks(run, "far binary", parts).toLocalIterator():
            most = np.maximum(most, np.frombuffer(r["far"], np.int32))
        alone, done_to = np.zeros(g.n, bool), to
        if not ((away >= 0) & (most < away + done_to - 1)).any():
            break

    def named(graph: Graph, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        at = slice(part * graph.n // parts, (part + 1) * graph.n // parts)
        yield pa.RecordBatch.from_arrays([graph.genes[at], pa.array(most[at])], names=["gene", "eccentricity"])

    return g.tasks(named, f"gene {g.gene}, eccentricity int", parts)
