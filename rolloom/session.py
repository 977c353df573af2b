"""Session defaults for local runs; on a cluster the session that is given is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.speculation": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for k, v in (DEFAULTS | extra).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
