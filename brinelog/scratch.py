"""Scratch tables in the folder that the cluster shares, and column names that a user's table doesn't have."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many narrow rows may be broadcast; its rows are counted first.
BROADCAST_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    """A new place under spark.checkpoint.dir, or a temporary one in local runs without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.gettempdir()}/brinelog-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, so that what follows doesn't work it out again and lost executors lose nothing."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spare(name: str, *frames: DataFrame) -> str:
    """name, behind as many underscores as it takes to be no column of frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
