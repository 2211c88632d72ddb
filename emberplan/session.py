"""A SparkSession with the settings that the engine's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, and as many shuffle partitions as given.

    On a cluster leave master and partitions to spark-submit: pass master="" and None.
    """
    b = SparkSession.builder.appName("emberplan")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    } | ({} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)}) | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
