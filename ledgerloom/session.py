"""A Spark session for tests and the benchmark. On a cluster, bring your own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", app: str = "ledgerloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # Building plans is most of the time of a small run; skip recording Python call sites.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
