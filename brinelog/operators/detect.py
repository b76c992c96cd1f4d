"""Validation, sliding statistics, z-scores and the persistence gate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..config import Config
from ..functions import scalars as S


def validated(df: DataFrame, sensor: str, time: str, value: str, cfg: Config, nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows as they are, quarantine (record, rejection_reason, received_at)). nulls: a missing value is a blackout, which is valid."""
    S.require(df.columns, [sensor, time, value])
    why = scratch.spare("_why", df)
    shown = F.coalesce(F.col(value), F.lit(0.0)) if nulls else F.col(value)
    marked = df.withColumn(why, S.rejection(F.col(sensor), F.col(time), shown, cfg))
    bad = marked.where(F.col(why) != "").select(F.to_json(F.struct(*df.columns)).alias("record"), F.col(why).alias("rejection_reason"), (F.unix_micros(F.current_timestamp()) / 1e6).alias("received_at"))
    return marked.where(F.col(why) == "").select(*df.columns), bad


def status(cod: Column) -> Column:
    """Tagged before validation, so that a null reading is a blackout and not a rejected record."""
    return F.when(cod.isNull(), "BLACKOUT").otherwise("NORMAL")


def tripwire(df: DataFrame, cfg: Config, value: str = "cod_value") -> DataFrame:
    """Rows at or over the threshold, with breach_mag and alert_level. NaN is no breach."""
    v = F.col(value)
    return df.where((v >= cfg.cod_threshold) & ~F.isnan(v)).withColumn("breach_mag", v - cfg.cod_baseline).withColumn("alert_level", F.when(v >= 2 * cfg.cod_baseline, "HIGH").otherwise("MEDIUM"))


def _panes(duration: str, hop: str) -> tuple[int, int, int]:
    """(pane, hop, duration) in microseconds: panes are the widest stretches of which every window has whole ones."""
    d, h = S.interval_micros(duration), S.interval_micros(hop)
    if not 0 < h <= d:
        raise ValueError(f"a window's hop must be positive and at most its duration (got {hop}, {duration})")
    return math.gcd(d, h), h, d


def _windows(pane: Column, width: int, hop: int, duration: int) -> Column:
    """Starts, in microseconds, of the windows that a pane (its number) is in."""
    begin = pane * width
    return F.transform(F.sequence(S.floor_div(begin + width - duration - 1, hop) + 1, S.floor_div(begin, hop)), lambda k: k * hop)


def sliding_stats(df: DataFrame, duration: str, hop: str, eps: float = 1e-9) -> DataFrame:
    """Statistics of (sensor_id, ts, value) per sensor and sliding window [start, end) with values in it.

    Rows are summed up once, into panes that no window cuts; a window is put together from its panes, so it costs duration / hop
    rows a pane and not a reading. A stream keeps Spark's own windows, which its watermark evicts.
    """
    v = F.col("value")
    if df.isStreaming:
        rows = df.groupBy("sensor_id", F.window("ts", duration, hop).alias("w")).agg(F.avg(v).alias("mean"), F.avg(v * v).alias("_square"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("sample_count"))
        return rows.select("sensor_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mean", S.population_std(F.col("mean"), F.col("_square"), eps).alias("std"), "min", "max", "sample_count")
    width, step, whole = _panes(duration, hop)
    panes = df.where("ts IS NOT NULL").groupBy("sensor_id", S.floor_div(S.micros(F.col("ts")), width).alias("pane")).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    rows = panes.withColumn("start", F.explode(_windows(F.col("pane"), width, step, whole))).groupBy("sensor_id", "start").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("sample_count"))
    mean, square = F.try_divide("s", "sample_count"), F.try_divide("q", "sample_count")
    return rows.select("sensor_id", S.at_micros(F.col("start")).alias("window_start"), S.at_micros(F.col("start") + whole).alias("window_end"), mean.alias("mean"), S.population_std(mean, square, eps).alias("std"), "min", "max", "sample_count")


def rolling_mean(df: DataFrame, duration: str, hop: str) -> DataFrame:
    """Mean over all rows of each sliding window, at the last reading's time in it; by panes, as sliding_stats."""
    width, step, whole = _panes(duration, hop)
    panes = df.where("ts IS NOT NULL").groupBy(S.floor_div(S.micros(F.col("ts")), width).alias("pane")).agg(F.sum("value").alias("s"), F.count("value").alias("n"), F.max("ts").alias("ts"))
    rows = panes.withColumn("start", F.explode(_windows(F.col("pane"), width, step, whole))).groupBy("start").agg(F.max("ts").alias("ts"), F.try_divide(F.sum("s"), F.sum("n")).alias("rolling_mean"))
    return rows.select("ts", "rolling_mean")


def scored(df: DataFrame, duration: str, hop: str, hop_unit: str | None, cfg: Config) -> DataFrame:
    """z-scores of (sensor_id, ts, value, ...) against the window that ends at the reading's time cut to the hop.

    The window is half open, so a reading is never in its own baseline, and each meets one window at most. hop_unit: the
    date_trunc unit that equals the hop; None: windows that end in the reading's minute, as many as there are.
    """
    return with_scores(df, sliding_stats(df, duration, hop, cfg.epsilon), hop_unit, cfg)


def with_scores(df: DataFrame, stats: DataFrame, hop_unit: str | None, cfg: Config) -> DataFrame:
    """scored() against statistics that are there already."""
    stats = stats.select(F.col("sensor_id").alias("_sensor"), F.col("window_end").alias("_end"), F.col("mean").alias("rolling_mean"), F.col("std").alias("rolling_std"))
    if hop_unit is None:
        left, right = F.date_trunc("minute", "ts").cast("timestamp_ntz"), F.date_trunc("minute", "_end").cast("timestamp_ntz")
    else:
        left, right = F.date_trunc(hop_unit, "ts").cast("timestamp_ntz"), F.col("_end")
    joined = df.join(stats, (F.col("sensor_id") == F.col("_sensor")) & (left == right)).drop("_sensor", "_end")
    z = (F.col("value") - F.col("rolling_mean")) / F.col("rolling_std")
    return joined.withColumn("z_score", z).withColumn("is_anomaly", F.abs("z_score") > cfg.zscore_threshold)


def persisted(df: DataFrame, count: int, tie: str | None = None, chunk_s: int = 3600) -> DataFrame:
    """Rows whose run of successive anomalies in their sensor's order (ts, then tie) has reached count; every such row. A null flag ends a run.

    A sensor's rows are cut into chunks of chunk_s seconds, so that a busy sensor spreads over tasks. Runs are islands between
    non-anomalies within a chunk; what a chunk's last run hands on to the next chunks is summed from one row a chunk. df is
    written once, as it is read for both.
    """
    order = ["ts"] + ([tie] if tie else [])
    at, run, island, own, into, carry = (scratch.spare(c, df) for c in ("_chunk", "_run", "_island", "_sensor", "_into", "_carry"))
    hit = F.coalesce("is_anomaly", F.lit(False)).cast("int")
    upto = (Window.unboundedPreceding, 0)
    by = Window.partitionBy("sensor_id", at).orderBy(*order).rowsBetween(*upto)
    of_island = Window.partitionBy("sensor_id", at, island).orderBy(*order).rowsBetween(*upto)
    rows = scratch.written(df).withColumn(at, S.floor_div(S.micros(F.col("ts")), chunk_s * 1_000_000))
    rows = rows.withColumn(island, F.sum(1 - hit).over(by)).withColumn(run, F.sum(hit).over(of_island))
    ends = rows.groupBy("sensor_id", at).agg(F.max(island).alias("_breaks"), F.max(F.struct(island, run))[run].alias("_tail"))
    chunks = Window.partitionBy("sensor_id").orderBy(at)
    ends = ends.withColumn("_since", F.sum((F.col("_breaks") > 0).cast("int")).over(chunks.rowsBetween(*upto)))
    ends = ends.withColumn("_handed", F.sum("_tail").over(Window.partitionBy("sensor_id", "_since").orderBy(at).rowsBetween(*upto)))
    handed = ends.select(F.col("sensor_id").alias(own), F.col(at).alias(into), F.lag("_handed").over(chunks).alias(carry)).where(F.col(carry) > 0)
    rows = rows.join(handed, F.col("sensor_id").eqNullSafe(F.col(own)) & F.col(at).eqNullSafe(F.col(into)), "left")
    before = F.when(F.col(island) == 0, F.coalesce(carry, F.lit(0))).otherwise(0)
    return rows.withColumn("consecutive_count", F.col(run) + before).where(F.col("is_anomaly") & (F.col("consecutive_count") >= count)).select(*[c for c in df.columns if c != "consecutive_count"], "consecutive_count")


def resets(df: DataFrame, tie: str | None = None, chunk_s: int = 3600) -> DataFrame:
    """(sensor_id, resets): how often a run of anomalies ended in a row that is none (or has no flag). Chunked as persisted() is."""
    order = ["ts"] + ([tie] if tie else [])
    rows = df.select("sensor_id", S.floor_div(S.micros(F.col("ts")), chunk_s * 1_000_000).alias("chunk"), F.struct(*order).alias("at"), F.coalesce("is_anomaly", F.lit(False)).alias("hit"))
    before = F.lag("hit").over(Window.partitionBy("sensor_id", "chunk").orderBy("at"))
    rows = rows.withColumn("ended", (before & ~F.col("hit")).cast("long"))
    chunks = rows.groupBy("sensor_id", "chunk").agg(F.coalesce(F.sum("ended"), F.lit(0)).alias("inside"), F.min_by("hit", "at").alias("first"), F.max_by("hit", "at").alias("last"))
    handed = F.lag("last").over(Window.partitionBy("sensor_id").orderBy("chunk"))  # a row a chunk
    chunks = chunks.withColumn("border", F.coalesce((handed & ~F.col("first")).cast("long"), F.lit(0)))
    return chunks.groupBy("sensor_id").agg(F.sum(F.col("inside") + F.col("border")).alias("resets"))
