from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution; local runs get as many shuffle partitions as a small machine has cores."""
    builder = SparkSession.builder.master(master).appName("nearfield").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if master.startswith("local"):
        builder = builder.config("spark.sql.shuffle.partitions", "8")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
