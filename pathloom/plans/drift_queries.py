"""Registered queries of problem 1: drifting schemas of metadata files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.operators.schema_drift import LINCS_PROMOTED, LINCS_TARGETS, field_changes, ingest, replay
from pathloom.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return field_changes(ingest(table(spark, sf, "lincs_meta_raw"), LINCS_TARGETS), LINCS_TARGETS)


def p1_table(spark: SparkSession, sf: str) -> DataFrame:
    """All files in one consistent table; what fits no column stays in ``_rescued``."""
    return replay(ingest(table(spark, sf, "lincs_meta_raw"), LINCS_TARGETS), LINCS_PROMOTED, LINCS_TARGETS)


QUERIES = {"p1_found": p1_found, "p1_table": p1_table}
