"""Top N distinct items of every group, skipping row groups by their statistics.

``cluster_scores`` writes the scores once, clustered: range partitions over (group,
descending score, item), so a group of any size spreads over as many files as it needs
(repeats of an item are merged map-side before), each file sorted the same way and cut
into row groups whose size follows that of the table. ``top_n`` then skips in two steps:

* from the footers alone: the row groups of one group only, in descending order of their
  minimum, give a lower bound of the group's N-th score as soon as they hold N rows;
  row groups of that group whose maximum lies strictly below it are never opened, in
  whatever file they are;
* within a file, row groups are read in descending order of their maximum, and one that
  lies strictly below the current N-th score of every group it contains is skipped. Which
  groups it contains is read from the sorted group columns.

A file yields at most N items per group and read row group; these are ranked once more
per group. ``skip_report`` counts what was read and skipped.

The tie rule is total: higher score first, then the smaller item columns in
their order. Rows with a NULL or NaN score, or a NULL group or item column, take
no part. Repeats of an item count once, with their highest score. Groups with
fewer than N items keep all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.storage import Scratch

#: Rows of a row group: a thousandth of the table between these bounds.
LEAST_ROWS, MOST_ROWS = 1_000, 100_000


def cluster_scores(df: DataFrame, group: Sequence[str], items: Sequence[str], score: str, path: str, rows_per_group: int | None = None) -> None:
    """Write (group, items, score) to ``path``, clustered for ``top_n``."""
    keys = [*group, *items]
    ok = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    for k in keys:
        ok = ok.where(F.col(k).isNotNull())
    if rows_per_group is None:
        rows_per_group = min(MOST_ROWS, max(LEAST_ROWS, df.count() // 1_000))
    ok = ok.select(*keys, (F.col(score).cast("double") + F.lit(0.0)).alias("score"))
    once = ok.groupBy(*keys).agg(F.max("score").alias("score"))  # repeats go before the shuffles, however many
    order = [*(F.col(g).asc() for g in group), F.desc("score"), *(F.col(i).asc() for i in items)]
    ordered = once.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.option("parquet.block.row.count.limit", rows_per_group).parquet(path)


def _open(uri: str):
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def _footer(uri: str, group: Sequence[str]) -> list[tuple]:
    """(file, row group, rows, least, most, first group, whether it is the only one) of each row group."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as handle:
        meta = pq.ParquetFile(handle).metadata
    out = []
    for i in range(meta.num_row_groups):
        rg = meta.row_group(i)
        by = {rg.column(c).path_in_schema: rg.column(c).statistics for c in range(meta.num_columns)}
        known = {k: s for k, s in by.items() if s is not None and s.has_min_max}
        least, most = (known["score"].min, known["score"].max) if "score" in known else (float("-inf"), float("inf"))
        single = all(g in known and known[g].min == known[g].max for g in group)
        first = [str(known[g].min) if g in known else None for g in group]
        out.append((uri, i, rg.num_rows, float(least), float(most), first, single))
    return out


def row_groups(spark: SparkSession, files: list[str], group: Sequence[str], n: int) -> DataFrame:
    """(file, part, rows, most, skipped) of every row group, ``skipped`` as the footers alone tell."""
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files), "file")

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["file"]:
                yield pd.DataFrame(_footer(uri, group), columns=["file", "part", "rows", "least", "most", "first", "single"])

    schema = "file string, part int, rows bigint, least double, most double, first array<string>, single boolean"
    parts = Scratch(spark, "footers").cut(names.mapInPandas(footers, schema), "footers")
    alone = parts.where("single")
    # Row groups of one group only: few in number, a thousandth of its rows at most.
    held = F.sum("rows").over(Window.partitionBy("first").orderBy(F.desc("least"), "file", "part"))
    bound = alone.withColumn("held", held).where(F.col("held") >= n).groupBy("first").agg(F.max("least").alias("bound"))
    return parts.join(bound, "first", "left").select("file", "part", "rows", "most", (F.col("single") & (F.coalesce(F.col("most") < F.col("bound"), F.lit(False)))).alias("skipped"))


def read_top(uri: str, parts: Sequence[tuple[int, float]], group: Sequence[str], items: Sequence[str], n: int) -> Iterator[tuple[pa.Table, int, int]]:
    """Candidates of the row groups ``parts`` (number, maximum) of one file: (rows, row groups read, skipped)."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as handle:
        file = pq.ParquetFile(handle, read_dictionary=list(group))
        kept: dict[tuple, np.ndarray] = {}  # best scores of the groups that go on beyond a row group
        for i, most in sorted(parts, key=lambda p: (-p[1], p[0])):
            keys = file.read_row_group(i, columns=list(group))
            columns = [keys.column(g).combine_chunks() for g in group]
            codes = [c.indices.to_numpy() if pa.types.is_dictionary(c.type) else pd.factorize(c.to_pandas())[0] for c in columns]
            change = np.any([np.diff(c) != 0 for c in codes], axis=0)
            starts = np.r_[0, np.flatnonzero(change) + 1]
            ends = (tuple(c[0].as_py() for c in columns), tuple(c[-1].as_py() for c in columns))
            # Every other group lies wholly within this row group, so that only these may be full already.
            contained = set(ends) if len(starts) <= 2 else None
            if contained and all(len(b := kept.get(g, ())) >= n and most < b[n - 1] for g in contained):
                yield None, 0, 1
                continue
            size = np.diff(np.r_[starts, len(keys)])
            rank = np.arange(len(keys)) - np.repeat(starts, size)
            table = file.read_row_group(i, columns=[*group, *items, "score"])
            scores = table.column("score").to_numpy()
            for g, at in zip(ends, (0, len(starts) - 1)):
                mine = scores[starts[at] : starts[at] + min(n, size[at])]
                kept[g] = np.sort(np.r_[kept.get(g, np.empty(0)), mine])[::-1][:n]
            yield table.filter(pa.array(rank < n)), 1, 0


def _scan(group: Sequence[str], items: Sequence[str], n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pa.Table | None, int, int]]:
        for b in batches:
            for uri, parts in zip(b["file"], b["parts"]):
                yield from read_top(uri, [(p["part"], p["most"]) for p in parts], group, items, n)

    return run


def _to_read(parts: DataFrame, n_files: int) -> DataFrame:
    """(file, parts) of the row groups that the footers don't rule out; a file has a bounded number of them."""
    p = parts.where("not skipped").groupBy("file").agg(F.collect_list(F.struct("part", "most")).alias("parts"))
    return p.repartition(n_files, "file")


def top_n(spark: SparkSession, path: str, group: Sequence[str], items: Sequence[str], n: int) -> DataFrame:
    """(group, items, score, rank) of the ``n`` best items per group of a clustered table."""
    table = spark.read.parquet(path)
    files, keys = table.inputFiles(), [*group, *items]
    schema = T.StructType([*(table.schema[k] for k in keys), T.StructField("score", T.DoubleType())])
    scan = _scan(group, items, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found, _, _ in scan(batches):
            if found is not None:
                yield found.select([*keys, "score"]).to_pandas()

    found = _to_read(row_groups(spark, files, group, n), len(files)).mapInPandas(run, schema) if files else spark.createDataFrame([], schema)
    w = Window.partitionBy(*group).orderBy(F.desc("score"), *items)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def skip_report(spark: SparkSession, path: str, group: Sequence[str], items: Sequence[str], n: int) -> DataFrame:
    """One row: row groups of a clustered table, skipped by the footers, skipped within their file, and read."""
    files = spark.read.parquet(path).inputFiles()
    parts = Scratch(spark, "skips").cut(row_groups(spark, files, group, n), "parts")
    scan = _scan(group, items, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, read, skipped in scan(batches):
            yield pd.DataFrame({"read": [read], "skipped": [skipped]})

    seen = _to_read(parts, len(files)).mapInPandas(run, "read int, skipped int")
    seen = seen.agg(F.coalesce(F.sum("read"), F.lit(0)).alias("n_read"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped_in_file"))
    total = parts.agg(F.count("*").alias("n_row_groups"), F.count(F.when(F.col("skipped"), 1)).alias("skipped_by_footer"))
    return total.crossJoin(seen)  # one row each


def _clustered(predictions: DataFrame) -> tuple[str, list[str], list[str]]:
    pairs = predictions.select("run_id", "disease", F.least("drug_a", "drug_b").alias("drug_lo"), F.greatest("drug_a", "drug_b").alias("drug_hi"), "prediction_score")
    path = Scratch(predictions.sparkSession, "top-n").path("clustered")
    group, items = ["run_id", "disease"], ["drug_lo", "drug_hi"]
    cluster_scores(pairs.where("drug_lo < drug_hi"), group, items, "prediction_score", path)
    return path, group, items


def top_pairs(predictions: DataFrame, n: int = 10) -> DataFrame:
    """(run_id, disease, drug_lo, drug_hi, prediction_score, rank): unordered pairs, ``n`` best of each run and disease."""
    path, group, items = _clustered(predictions)
    return top_n(predictions.sparkSession, path, group, items, n).withColumnRenamed("score", "prediction_score")


def top_pairs_skips(predictions: DataFrame, n: int = 10) -> DataFrame:
    """``skip_report`` of ``top_pairs``."""
    path, group, items = _clustered(predictions)
    return skip_report(predictions.sparkSession, path, group, items, n)
