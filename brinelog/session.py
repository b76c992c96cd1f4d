"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "brinelog", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI on, adaptive execution with skew joins; state in RocksDB. conf: more settings, ``_`` for ``.``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
