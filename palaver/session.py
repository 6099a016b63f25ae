"""Session defaults for one machine; on a cluster the cluster's own settings hold."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", name: str = "palaver", **extra: str) -> SparkSession:
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # list states and timers of streams need this store
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    builder = SparkSession.builder.master(master).appName(name).config(map=conf)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
