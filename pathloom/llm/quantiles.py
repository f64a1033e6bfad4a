"""Percentiles from mergeable randomised compactor sketches.

A sketch holds items on levels; an item on level h stands for 2**h values. When
a level holds more than ``2 * k`` items, they are sorted and every other one,
from a random start, moves up a level. Two sketches merge level by level. A
compaction on level h moves the rank of any value by -2**h, 0 or +2**h with mean
zero, so with V the sum of 4**h over all compactions, Hoeffding's inequality
bounds the rank error of an answer by ``sqrt(2 V ln(2 / delta))`` with
probability ``1 - delta``. V travels with the sketch; with n <= 2k nothing was
compacted and the answers are exact. A sketch holds at most 2k items per level,
so neither a hot group nor many partial sketches need memory in proportion.

``partial_sketches`` sketches each partition before anything is shuffled, with a bounded
number of open sketches; ``merge_sketches`` merges in two levels, first the salted shares
of a key, then those, so that no task gets all partial sketches of a hot key.
Merging streams over sorted rows, one sketch in memory at a time.

NULL and NaN values don't count. Groups without values give n = 0 and NULL
percentiles where the caller lists them. The random starts are drawn from the number of
the partition and that of the sketch within it, so equal partitions draw their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

K = 1024
DELTA = 0.01
SEED = 20231

#: Sketches a task holds open, values after which it hands them on, and shares of a key in the first level of merging.
OPEN, HELD, SALTS = 20_000, 2_000_000, 16


class Sketch:
    """Compactor hierarchy over doubles."""

    __slots__ = ("levels", "n", "variance", "k", "seed", "coins")

    def __init__(self, k: int = K, seed: Sequence[int] = ()):
        self.levels: list[list[np.ndarray]] = [[]]
        self.n, self.variance, self.k, self.seed, self.coins = 0, 0.0, k, tuple(seed), None

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        for i in range(0, len(values), 8 * self.k):
            self.levels[0].append(np.asarray(values[i : i + 8 * self.k], dtype=np.float64))
            self._compact()

    def merge(self, n: int, variance: float, sizes: Sequence[int], items: bytes) -> None:
        self.n += n
        self.variance += variance
        flat, at = np.frombuffer(items, dtype=np.float64), 0
        for h, size in enumerate(sizes):
            if h == len(self.levels):
                self.levels.append([])
            if size:
                self.levels[h].append(flat[at : at + size])
            at += size
        self._compact()

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            size = sum(map(len, self.levels[h]))
            if size > 2 * self.k:
                if h + 1 == len(self.levels):
                    self.levels.append([])
                a = np.sort(np.concatenate(self.levels[h]))
                keep = a[len(a) - len(a) % 2 :]  # an odd one stays on its level
                a = a[: len(a) - len(a) % 2]
                if self.coins is None:
                    self.coins = np.random.default_rng((SEED, *self.seed))
                start = self.coins.integers(2)
                self.levels[h + 1].append(a[start::2])
                self.levels[h] = [keep] if len(keep) else []
                self.variance += 4.0**h
            h += 1

    def state(self) -> tuple[int, float, list[int], bytes]:
        flat = [np.concatenate(lv) if lv else np.empty(0) for lv in self.levels]
        return self.n, self.variance, [len(a) for a in flat], np.concatenate(flat).tobytes()

    def quantiles(self, ps: Sequence[float]) -> list[float | None]:
        """For each p the smallest kept value whose estimated rank reaches p * n."""
        if not self.n:
            return [None] * len(ps)
        v = np.concatenate([a for lv in self.levels for a in lv])
        w = np.concatenate([np.full(len(a), 2.0**h) for h, lv in enumerate(self.levels) for a in lv])
        o = np.argsort(v, kind="stable")
        v, c = v[o], np.cumsum(w[o])
        at = np.searchsorted(c, np.maximum(np.ceil(np.asarray(ps) * self.n - 1e-9), 1.0))
        return [float(x) for x in v[np.minimum(at, len(v) - 1)]]

    def rank_error(self, delta: float = DELTA) -> float:
        """Bound of the rank error as a share of n, held with probability 1 - delta."""
        return math.sqrt(2 * self.variance * math.log(2 / delta)) / self.n if self.n else 0.0


_STATE = [T.StructField("n", T.LongType()), T.StructField("variance", T.DoubleType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("items", T.BinaryType())]
_ARROW_STATE = [pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.binary()]


def _sketch_partitions(keys: Sequence[str], arrow: Sequence[pa.DataType], value: str, k: int):
    names = [*keys, "n", "variance", "sizes", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, Sketch] = {}
        held, begun, part_id = 0, 0, TaskContext.get().partitionId() if TaskContext.get() else 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part in _chunks(list(open_.items()), 5_000):
                cols = [pa.array([key[i] for key, _ in part], t) for i, t in enumerate(arrow)]
                states = [s.state() for _, s in part]
                cols += [pa.array([s[i] for s in states], t) for i, t in enumerate(_ARROW_STATE)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            open_.clear()

        for b in batches:
            df = b.to_pandas()
            code, uniques = np.zeros(len(df), dtype=np.int64), [()]
            for c in keys:  # NULL is a key like any other
                own, found = pd.factorize(df[c])
                found = [*found, None]
                code, pairs = pd.factorize(code * len(found) + np.where(own < 0, len(found) - 1, own))
                uniques = [(*uniques[x // len(found)], found[x % len(found)]) for x in pairs]
            order = np.argsort(code, kind="stable")
            values = df[value].to_numpy()[order]
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            for c, part in zip(code[order][np.r_[0, cuts]] if len(code) else [], np.split(values, cuts)):
                if uniques[c] not in open_:
                    if len(open_) >= OPEN:  # bounds a task's memory; sketches merge later
                        yield from flush()
                        held = 0
                    begun += 1
                    open_[uniques[c]] = Sketch(k, (0, part_id, begun))
                open_[uniques[c]].update(part)
            held += len(values)
            if held > HELD:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _chunks(rows: list, size: int) -> Iterator[list]:
    for i in range(0, len(rows), size):
        yield rows[i : i + size]


def partial_sketches(values: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """(keys, n, variance, sizes, items): sketches of each partition, several per key; NULL is a key like any other."""
    df = values.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    schema = T.StructType([*(df.schema[c] for c in keys), *_STATE])
    arrow = [f.type for f in to_arrow_schema(T.StructType([df.schema[c] for c in keys]))]
    return df.mapInArrow(_sketch_partitions(keys, arrow, value, k), schema)


def day_sketches(values: DataFrame, group: str, day: str, value: str, k: int = K) -> DataFrame:
    """(group, day, n, variance, sizes, items): one sketch per group and day; values without a day have one of their own, of day NULL."""
    return merge_sketches(partial_sketches(values.where(F.col(group).isNotNull()), [group, day], value, k), [group, day], k)


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K, salts: int = SALTS) -> DataFrame:
    """Merge all sketches with equal ``keys`` into one, in two levels."""
    schema = T.StructType([*(sketches.schema[c] for c in keys), *_STATE])
    if salts > 1:
        salted = T.StructType([*schema.fields[: len(keys)], T.StructField("_salt", T.IntegerType()), *_STATE])
        parts = sketches.withColumn("_salt", F.pmod(F.xxhash64("n", "items"), F.lit(salts)).cast("int"))
        run = _merge_sorted(len(keys) + 1, k, lambda s: s.state(), 1)
        sketches = _sorted(parts, [*keys, "_salt"]).mapInArrow(_to_batches(run, salted), salted)
    run = _merge_sorted(len(keys), k, lambda s: s.state(), 2)
    return _sorted(sketches, keys).mapInArrow(_to_batches(run, schema), schema)


def percentiles(sketches: DataFrame, keys: Sequence[str], ps: dict[str, float], k: int = K, delta: float = DELTA) -> DataFrame:
    """Percentiles per ``keys`` over all their sketches: (keys, n_values, one column per entry of ``ps``, rank_error)."""
    schema = T.StructType([*(sketches.schema[c] for c in keys), T.StructField("n_values", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ps), T.StructField("rank_error", T.DoubleType())])
    run = _merge_sorted(len(keys), k, lambda s: (s.n, *s.quantiles(list(ps.values())), s.rank_error(delta)), 3)
    return _sorted(sketches, keys).mapInArrow(_to_batches(run, schema), schema)


def _sorted(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    state = ["n", "variance", "sizes", "items"]
    return sketches.select(*keys, *state).repartition(*keys).sortWithinPartitions(*keys, "n", "items")


def _merge_sorted(n_keys: int, k: int, finish, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, sketch, begun = None, Sketch(k), 0
        part_id = TaskContext.get().partitionId() if TaskContext.get() else 0
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for row in zip(*cols):
                if row[:n_keys] != key:
                    if key is not None:
                        yield (*key, *finish(sketch))
                    begun += 1
                    key, sketch = row[:n_keys], Sketch(k, (level, part_id, begun))
                sketch.merge(*row[n_keys:])
        if key is not None:
            yield (*key, *finish(sketch))

    return run


def _to_batches(rows, schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for r in rows(batches):
            held.append(r)
            if len(held) == 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    return run


PERCENTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _compounds(metadata: DataFrame) -> DataFrame:
    """(sig_id, pert_iname): of rows with equal sig_id the one with the highest row_id holds."""
    m = metadata.where("sig_id is not null").groupBy("sig_id").agg(F.max_by("pert_iname", "row_id").alias("pert_iname"))
    return m.where("pert_iname is not null")


def compound_sketches(values: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sketches of fold_change per pert_iname, as written, and day of measured_at.

    Values are sketched per sig_id and day where they lie; only sketches meet the metadata.
    """
    v = values.select("sig_id", F.to_date("measured_at").alias("day"), F.col("fold_change").cast("double").alias("value"))
    partial = partial_sketches(v.where("sig_id is not null"), ["sig_id", "day"], "value")
    return merge_sketches(partial.join(_compounds(metadata), "sig_id").drop("sig_id"), ["pert_iname", "day"])


def compound_percentiles(values: DataFrame, metadata: DataFrame) -> DataFrame:
    """(pert_iname, n_values, p05, p25, median, p75, p95, p99, rank_error) for each pert_iname that holds for a sig_id."""
    found = percentiles(compound_sketches(values, metadata), ["pert_iname"], PERCENTILES)
    names = _compounds(metadata).select("pert_iname").distinct()
    out = names.join(found, "pert_iname", "left")
    return out.select("pert_iname", F.coalesce("n_values", F.lit(0)).alias("n_values"), *PERCENTILES, F.coalesce("rank_error", F.lit(0.0)).alias("rank_error"))
