"""Session for local runs. On a cluster, pass the session the cluster gives you."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "roadstats", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    Partition counts are left to adaptive execution, which merges small shuffle
    partitions and splits skewed ones; only the starting count is set here.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ROADSTATS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
