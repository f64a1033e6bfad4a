"""Dense numbers for distinct values, without ordering them all in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.storage import BROADCAST_ROWS, Scratch, rows


def number(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "i") -> DataFrame:
    """(keys, value, out): rows of (keys, value) numbered from 0 per ``keys`` in the order of ``value``.

    A table of few rows, as counted, is numbered at once; of a larger one ranges of values
    first and values within a range next, so no key has to fit into one task. The rows
    are expected to be distinct. Written once.
    """
    scratch = Scratch(df.sparkSession, "numbers")
    table = scratch.cut(df.select(*keys, value), "values")
    if rows(table) <= BROADCAST_ROWS:  # few enough for one task
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) if keys else F.row_number().over(Window.orderBy(value))
        numbered = scratch.cut(table.withColumn(out, (at - 1).cast("int")), "numbers")
    else:
        numbered = scratch.cut(_by_ranges(table, value, keys, out), "numbers")
    return numbered


def _by_ranges(table: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    scratch = Scratch(table.sparkSession, "ranges")
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = scratch.cut(table.repartitionByRange(parts, *keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_range") if keys else Window.orderBy("_range")  # a row per range
    before = sums.select(*keys, "_range", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(value)) - 1
    got = cut.withColumn("_within", within).join(before, [*keys, "_range"])
    return got.select(*keys, value, (F.col("_before") + F.col("_within")).cast("int").alias(out))
