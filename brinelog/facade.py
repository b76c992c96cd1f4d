"""The operators behind the names of a user's own columns, as configured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config
from .functions import scalars as S
from .operators import detect as D


def readings(df: DataFrame, cfg: Config, time: str = "time", keep: list[str] | None = None) -> DataFrame:
    """(sensor_id, ts, value, columns to keep) from the configured sensor and value columns and a text time in the configured form.

    Times that don't fit the form give null; ValueError names the columns that df lacks.
    """
    sensor, value, kept = cfg.input_schema_sensor_column, cfg.input_schema_value_column, keep or []
    S.require(df.columns, [sensor, value, time, *kept])
    return df.select(F.col(sensor).alias("sensor_id"), S.parsed(F.col(time), cfg.input_time_format).alias("ts"), F.col(value).try_cast("double").alias("value"), *kept)


def stats(df: DataFrame, cfg: Config) -> DataFrame:
    """Statistics of (sensor_id, ts, value) in the configured sliding windows."""
    return D.sliding_stats(df, f"{cfg.window_duration_ms} milliseconds", f"{cfg.window_hop_ms} milliseconds", cfg.epsilon)


def score(df: DataFrame, cfg: Config) -> DataFrame:
    """z-scores of (sensor_id, ts, value, ...) against the configured windows that end in a reading's minute."""
    return D.with_scores(df, stats(df, cfg), None, cfg)


def detect(df: DataFrame, cfg: Config, time: str = "time", tie: str | None = None) -> DataFrame:
    """Confirmed anomalies of a user's own table: renamed, scored, then held to the configured run length."""
    rows = readings(df, cfg, time, [tie] if tie else None)
    return D.persisted(score(rows, cfg), cfg.persistence_count, tie)
