"""Session factory with the settings every plan here relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "pathloom", cores: int | str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE (coalescing, skew joins), UTC and Arrow transfer.

    On a cluster the master and memory come from spark-submit, and ``spark.checkpoint.dir``
    must name a folder that all executors share; a local session gets a temporary one.
    ``conf`` overrides anything.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "spark.master" not in conf:
        b = b.master(f"local[{cores}]")
        conf.setdefault("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
