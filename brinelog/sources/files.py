"""Readers and writers of CSV and JSON lines, in batches and as streams."""

from __future__ import annotations

import json
import os
import tempfile
import urllib.request

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import scalars as S
from ..operators import detect
from .schemas import CETP, FACTORY, RAW_HEADERS, TAMPER


def _csv(spark: SparkSession, path: str, schema: StructType, glob: str, stream: bool, files_a_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", files_a_batch) if stream else spark.read
    try:
        return reader.schema(schema).option("header", True).option("nullValue", "").option("pathGlobFilter", glob).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} is missing; write the readings there first") from e
        raise


def plant_readings(spark: SparkSession, path: str, glob: str = "cetp_clean.csv", stream: bool = False, files_a_batch: int = 1000) -> DataFrame:
    """Plant readings with their constant sensor id."""
    return _csv(spark, path, CETP, glob, stream, files_a_batch).withColumn("sensor_id", F.lit("CETP_INLET"))


def factory_readings(spark: SparkSession, path: str, glob: str = "factory_*.csv", stream: bool = False, include_blackout: bool = True, files_a_batch: int = 1000) -> DataFrame:
    """All factories' readings, one scan over the matching files, tagged NORMAL or BLACKOUT."""
    rows = _csv(spark, path, FACTORY, glob, stream, files_a_batch)
    rows = rows.withColumn("status", detect.status(F.col("cod")))
    return rows if include_blackout else rows.where("cod IS NOT NULL")


def factory_index(spark: SparkSession, path: str, fmt: str, glob: str = "factory_*.csv", keep_null: bool = False) -> DataFrame:
    """Static readings with a parsed ts, unparseable numbers and times null; rows without cod only if keep_null."""
    text = StructType([StructField(f.name, StringType()) for f in FACTORY])
    rows = _csv(spark, path, text, glob, False)
    out = rows.select("factory_id", "time", S.parsed(F.col("time"), fmt).alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in ("cod", "bod", "ph", "tss")])
    return out if keep_null else out.where("cod IS NOT NULL AND ts IS NOT NULL")


def preprocessed(spark: SparkSession, path: str) -> DataFrame:
    """A raw plant CSV with our headers: the known columns that it has, "NA" as null."""
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    return raw.select(*[F.col(f"`{c}`").alias(RAW_HEADERS[c]) for c in raw.columns if c in RAW_HEADERS])


def timeline(df: DataFrame, value: str = "cetp_inlet_cod") -> DataFrame:
    """(time, is_valid) of a plant frame."""
    text = F.col(value).cast("string")
    return df.select("time", (text.isNotNull() & ~F.lower(F.trim(text)).isin("", "na", "nan")).alias("is_valid"))


def jsonl(spark: SparkSession, path: str, schema: StructType, newest_first: str | None = None) -> DataFrame:
    """JSON lines; malformed lines are left out, a missing path gives no rows."""
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema)
    return rows.orderBy(F.desc(newest_first)) if newest_first else rows


def dashboard_readings(spark: SparkSession, path: str, fmt: str, glob: str = "cetp_clean.csv") -> DataFrame:
    """Plant readings in order of time, unparseable numbers and times null, those without inlet COD or time left out."""
    text = StructType([StructField(f.name, StringType()) for f in CETP])
    rows = _csv(spark, path, text, glob, False).withColumn("ts", S.parsed(F.col("time"), fmt))
    numbers = {c: F.col(c).try_cast("double") for c in text.names if c not in ("s_no", "time")}
    return rows.withColumns(numbers).withColumn("s_no", F.col("s_no").try_cast("long")).where("cetp_inlet_cod IS NOT NULL AND ts IS NOT NULL").orderBy("ts", "s_no")


def tamper_log(spark: SparkSession, path: str) -> DataFrame:
    """Tamper records of all kinds, columns that a kind lacks null; malformed lines are left out, a missing log gives no rows."""
    return jsonl(spark, path, TAMPER)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    df.write.mode(mode).option("header", True).option("compression", compression).csv(path)


def append_jsonl(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent for a repeated micro-batch: each batch has a folder of its own. Read with path/*."""
    df.withColumn("logged_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).write.mode("overwrite").json(f"{path}/batch={batch_id}")


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    df.withColumn("logged_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).write.mode("overwrite").json(path)


def write_kpis(df: DataFrame, path: str) -> None:
    """One row as JSON, put in place at once, so that readers never see half a file. A driver-side file by design."""
    row = json.loads(df.toJSON().first())
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w") as f:
        json.dump(row, f)
    os.replace(temp, path)


def post_webhook(record: dict, url: str, timeout: float = 5.0) -> bool:
    """Best effort; off without a URL."""
    if not url:
        return False
    try:
        request = urllib.request.Request(url, json.dumps(record, default=str).encode(), {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=timeout).close()
        return True
    except OSError:
        return False
