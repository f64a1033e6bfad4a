"""A graph as arrays that a task holds: neighbours as 32-bit numbers, without names.

One task numbers the genes by falling degree and writes the neighbour lists to the shared
folder; later tasks read them there once a Python worker. Searches and walks of many keys
are then sweeps: each node takes the sum, or the union, of the rows of its neighbours, a
row being some columns of a matrix. Keys are what is split over tasks, so nothing of a
search is shuffled but its keys and its result.

Graphs of more than ``MOST_EDGES`` directed edges, as counted, are not made compact;
callers have their joins for those.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.storage import Scratch, kept_object, read_shared, rows, write_shared

#: Directed edges that a task may hold (4 bytes each, some 40 while they are numbered), and cells of a matrix over all nodes.
MOST_EDGES, CELLS = 40_000_000, 3_000_000

#: Neighbours of fewer nodes than this are taken node by node; nodes that one step of a sweep takes.
FEW, STEP = 64, 2048

#: Paths of two edges that a count of triangles looks at together.
WAYS = 1_000_000


class Compact:
    """What the driver knows of a compact graph: its folder, nodes, directed edges and the type of a gene."""

    def __init__(self, spark: SparkSession, path: str, n: int, m: int, gene: str):
        self.spark, self.path, self.n, self.m, self.gene = spark, path, n, m, gene

    def tasks(self, run: Callable, schema: str, parts: int) -> DataFrame:
        """Rows of ``run(graph, part, parts)``, which yields record batches, one task for each part."""
        path = self.path

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in b["id"].to_pylist():
                    yield from run(held(path), part, parts)

        return self.spark.range(0, parts, 1, parts).mapInArrow(each, schema)

    def keyed(self, df: DataFrame, key: str, width: int, run: Callable, schema: str) -> DataFrame:
        """Rows of ``run(graph, table)`` for the rows of at most ``width`` keys at a time, each key's together."""
        path = self.path

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in blocks(batches, key, width):
                yield from run(held(path), t)

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # By a hash of the key: a table that is split by the key already would not be split again, and so few rows be merged into one or two tasks.
        return df.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key).mapInArrow(each, schema)

    def width(self, most: int = 1 << 30) -> int:
        """Columns of a matrix over all nodes of about ``CELLS`` cells."""
        return max(1, min(most, CELLS // max(1, self.n)))


def compact(edges: DataFrame) -> Compact | None:
    """The compact form of (gene_a, gene_b), made once a program for a table of ``cut``; None if the graph is too large."""
    spark = edges.sparkSession
    if path := getattr(edges, "_pathloom_path", None):
        return kept_object(spark, ("compact", path), lambda: _made(spark, edges))
    table = Scratch(spark, "graph").cut(edges.select("gene_a", "gene_b").where("gene_a is not null and gene_b is not null"), "edges")
    return _made(spark, table)


def _made(spark: SparkSession, table: DataFrame) -> Compact | None:
    if 2 * rows(table) > MOST_EDGES:
        return None
    source, root = table._pathloom_path, Scratch(spark, "compact").root

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            t = read_shared(source, columns=["gene_a", "gene_b"])
            t = t.filter(pc.and_(pc.is_valid(t["gene_a"]), pc.is_valid(t["gene_b"])))
            genes = pc.unique(pa.chunked_array([*t["gene_a"].chunks, *t["gene_b"].chunks], t["gene_a"].type))
            genes = genes.combine_chunks() if isinstance(genes, pa.ChunkedArray) else genes
            a, b = (pc.index_in(t[c], genes).to_numpy().astype(np.int32) for c in ("gene_a", "gene_b"))
            del t
            degree = np.bincount(a, minlength=len(genes)) + np.bincount(b, minlength=len(genes))
            order = np.argsort(-degree, kind="stable")
            place = np.empty(len(genes), np.int32)
            place[order] = np.arange(len(genes), dtype=np.int32)
            a, b = place[a], place[b]
            key = np.concatenate([a.astype(np.int64) * len(genes) + b, b.astype(np.int64) * len(genes) + a])
            del a, b
            key.sort()
            near = (key % max(1, len(genes))).astype(np.int32)
            to = f"{root}/{uuid.uuid4().hex}"
            write_shared(f"{to}/nodes", pa.table({"gene": genes.take(pa.array(order)), "degree": degree[order]}))
            write_shared(f"{to}/near", pa.table({"near": near}))
            yield pa.RecordBatch.from_pydict({"path": [to], "n": [len(genes)], "m": [len(near)]})

    got = spark.range(0, 1, 1, 1).mapInArrow(build, "path string, n long, m long").first()
    return Compact(spark, got["path"], got["n"], got["m"], table.schema["gene_a"].dataType.simpleString())


def outside_largest(table: DataFrame) -> DataFrame | None:
    """(gene) outside the largest component of a table of ``cut(lo, hi)``, told apart in one task; None if the graph is too large.

    Of components of equal size that with the smallest gene counts as the largest.
    """
    if 2 * rows(table) > MOST_EDGES:
        return None
    source = table._pathloom_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            t = read_shared(source, columns=["lo", "hi"])
            genes = pc.unique(pa.chunked_array([*t["lo"].chunks, *t["hi"].chunks], t["lo"].type)).drop_null()
            t = t.filter(pc.and_(pc.is_valid(t["lo"]), pc.is_valid(t["hi"])))
            a, b = (pc.index_in(t[c], genes).to_numpy().astype(np.int32) for c in ("lo", "hi"))
            out = np.ones(len(genes), bool)
            if len(a):
                label = _labels(a, b, len(genes))
                sizes = np.bincount(label)
                most = np.flatnonzero(sizes == sizes.max())
                if len(most) > 1:
                    at = np.flatnonzero(np.isin(label, most))
                    first = pc.array_sort_indices(genes.take(pa.array(at)))[0].as_py()
                    most = label[at[first : first + 1]]
                out = label != most[0]
            yield pa.RecordBatch.from_arrays([genes.filter(pa.array(out))], names=["gene"])

    return table.sparkSession.range(0, 1, 1, 1).mapInArrow(run, f"gene {table.schema['lo'].dataType.simpleString()}")


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, of edges between ``a`` and ``b``: roots are hung below smaller ones, and ways to a root cut short."""
    label = np.arange(n, dtype=np.int32)
    while len(a):
        a, b = label[a], label[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    return label


_HELD: dict[str, "Graph"] = {}


def held(path: str) -> "Graph":
    """The graph at ``path``, read once a Python worker."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Graph(path)
    return _HELD[path]


def blocks(batches: Iterator[pa.RecordBatch], key: str, width: int) -> Iterator[pa.Table]:
    """The rows of a partition sorted by ``key``, those of ``width`` keys at a time."""
    left = None
    for b in batches:
        new = pa.Table.from_batches([b])
        left = new if left is None else pa.concat_tables([left, new])
        here = pc.unique(left[key])
        while len(here) > width:  # the last key may go on in the next batch
            mine = pc.is_in(left[key], here[:width])
            yield left.filter(mine)
            left, here = left.filter(pc.invert(mine)), here[width:]
    if left is not None and len(left):
        yield left


class Graph:
    """Nodes by falling degree. ``near[first[i]:first[i + 1]]`` are the neighbours of node i, in order."""

    def __init__(self, path: str):
        nodes = read_shared(f"{path}/nodes")
        self.genes, self.degree = nodes["gene"].combine_chunks(), nodes["degree"].to_numpy()
        self.near = read_shared(f"{path}/near")["near"].to_numpy()
        self.n, self.first = len(self.genes), np.concatenate([[0], np.cumsum(self.degree)])
        self._columns: list[np.ndarray] = []
        while (more := self._above(len(self._columns))) >= FEW:
            self._columns.append(self.near[self.first[:more] + len(self._columns)])
        self._tails = self._above(len(self._columns))

    def _above(self, k: int) -> int:
        """Nodes of more than ``k`` neighbours."""
        return int(np.searchsorted(-self.degree, -k, side="left"))

    def at(self, genes: pa.ChunkedArray) -> np.ndarray:
        """Node numbers; -1 for what is no node."""
        return pc.fill_null(pc.index_in(genes, self.genes), -1).to_numpy().astype(np.int64)

    def sweep(self, f: np.ndarray, op: np.ufunc, out: np.ndarray) -> np.ndarray:
        """``out[i]``: ``op`` over the rows of ``f`` of the neighbours of i."""
        room = np.empty((min(STEP, self.n), f.shape[1]), f.dtype)
        for a in range(0, self.n, STEP):
            b = min(self.n, a + STEP)
            out[a:b] = 0
            for c in self._columns:
                k = min(b, len(c)) - a
                if k <= 0:
                    break
                np.take(f, c[a : a + k], axis=0, out=room[:k], mode="clip")
                op(out[a : a + k], room[:k], out=out[a : a + k])
        for i in range(self._tails):
            rest = self.near[self.first[i] + len(self._columns) : self.first[i + 1]]
            for a in range(0, len(rest), STEP):
                op(out[i], op.reduce(f[rest[a : a + STEP]], axis=0), out=out[i])
        return out

    def levels(self, nodes: np.ndarray, keys: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Search from ``nodes`` for ``keys`` below ``size``: for each level the bits that are new and those set so far, 64 keys to a word."""
        seen = np.zeros((self.n, -(-size // 64)), np.uint64)
        np.bitwise_or.at(seen, (nodes, keys // 64), np.uint64(1) << (keys % 64).astype(np.uint64))
        new, out = seen.copy(), np.empty_like(seen)
        while new.any():
            yield new, seen
            self.sweep(seen, np.bitwise_or, out)
            np.bitwise_and(out, ~seen, out=new)
            seen |= new

    def hops(self, nodes: np.ndarray, keys: np.ndarray, size: int, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(to, key): hops from the nodes of each key to the nodes ``to``, and whether there is a way; without one the hops mean nothing."""
        found, seen = np.zeros((len(to), size), np.uint8), None
        for h, (_, seen) in enumerate(self.levels(nodes, keys, size)):
            if h == np.iinfo(found.dtype).max:
                found = found.astype(np.uint32)
            there = _bits(seen[to], size)
            found += ~there
        return found, _bits(seen[to], size) if seen is not None else np.zeros(found.shape, bool)

    def triangles(self, part: int, parts: int) -> np.ndarray:
        """Triangles at each node, of those whose last node is of the ``part``; edges are there once, without loops.

        Each node looks at neighbours before it and at their neighbours before them, which a hub,
        as one of the first nodes, has few of.
        """
        to = np.repeat(np.arange(self.n), self.degree)
        up, self_ = self.near[self.near < to], to[self.near < to]
        ups = np.bincount(self_, minlength=self.n)
        first = np.concatenate([[0], np.cumsum(ups)])
        edge = self_ * self.n + up
        found = np.zeros(self.n, np.int64)
        mine = np.flatnonzero(self_ % parts == part)
        ways = np.concatenate([[0], np.cumsum(ups[up[mine]])])
        a = 0
        while a < len(mine):
            b = max(a + 1, int(np.searchsorted(ways, ways[a] + WAYS, side="right")) - 1)
            e, size = mine[a:b], ups[up[mine[a:b]]]
            start = np.repeat(first[up[e]] - (ways[a:b] - ways[a]), size)
            third, last, middle = up[start + np.arange(len(start))], np.repeat(self_[e], size), np.repeat(up[e], size)
            key = last * self.n + third
            there = edge[np.minimum(np.searchsorted(edge, key), len(edge) - 1)] == key
            for x in (third, last, middle):
                found += np.bincount(x[there], minlength=self.n)
            a = b
        return found


def _bits(words: np.ndarray, size: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).astype("<u8", copy=False).view(np.uint8), axis=1, count=size, bitorder="little").view(bool)
