"""Group scores, attribution, the risk index, and gated alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BANDS, Config
from ..functions import scalars as S
from .cooldown import cooled


def members(spark, groups: dict[str, list[str]]) -> DataFrame:
    """(group_name, sensor_id, pos, members): a few rows of configuration."""
    rows = [(g, s, k, list(all_)) for g, all_ in groups.items() for k, s in enumerate(all_)]
    return spark.createDataFrame(rows, "group_name string, sensor_id string, pos int, members array<string>")


def group_anomalies(scored: DataFrame, cfg: Config) -> DataFrame:
    """A row per group and time bucket of (sensor_id, ts, z_score): composite score over all rows, sensors, attribution.

    Contributing and missing sensors are in the order of configuration; fractions come from each sensor's last score. The
    membership is configuration, so it is broadcast, and readings are scanned once for all groups.
    """
    if not cfg.sensor_groups:
        raise ValueError("sensor_groups is empty")
    joined = scored.select("sensor_id", "ts", "z_score").join(F.broadcast(members(scored.sparkSession, cfg.sensor_groups)), "sensor_id").withColumn("bucket", S.time_bucket(F.col("ts"), cfg.sync_tolerance_ms))
    z = F.col("z_score")
    per = joined.groupBy("group_name", "bucket", "sensor_id", "pos", "members").agg(F.max("ts").alias("ts"), F.sum(z * z).alias("q"), F.count(z).alias("n"), F.max_by("z_score", F.struct("ts", "z_score")).alias("z"))
    whole = Window.partitionBy("group_name", "bucket")
    square = F.col("z") * F.col("z")
    share = F.coalesce(F.try_divide(square, F.sum(square).over(whole)), F.lit(1.0) / F.count(F.lit(1)).over(whole))
    per = per.withColumn("fraction", share)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("fraction")).alias("f"), "pos", F.col("sensor_id").alias("sensor"))))
    named = F.sort_array(F.collect_list(F.struct("pos", F.col("sensor_id").alias("sensor"))))
    rows = per.groupBy("group_name", "bucket", "members").agg(
        F.max("ts").alias("ts"), S.rms(F.sum("q"), F.sum("n")).alias("composite_score"), F.sum("n").alias("n"),
        F.transform(named, lambda x: x["sensor"]).alias("named"), F.transform(ordered, lambda x: F.struct(x["sensor"].alias("sensor"), (-x["f"]).alias("fraction"))).alias("shares"),
    )
    return rows.select(
        "group_name", "bucket", "ts", "n", "composite_score", F.array_join("named", ",").alias("contributing_sensors"), F.array_join(F.array_except("members", "named"), ",").alias("missing_sensors"),
        (F.col("composite_score") > cfg.group_threshold).alias("is_group_anomaly"), F.coalesce(F.get("shares", F.lit(0))["sensor"], F.lit("")).alias("top_contributor"), "shares",
        S.attribution_detail(F.col("shares")).alias("attribution_detail"), S.attribution_message(F.col("group_name"), F.col("shares")).alias("alert_message"),
    )


def risk_index(groups: DataFrame, cfg: Config) -> DataFrame:
    """groups with discharge_point_id, sensitivity_factor, eri, risk_band, unknown_sensitivity; attribution stays on the rows."""
    rows = groups.sparkSession.createDataFrame([(k, float(v)) for k, v in cfg.river_sensitivity.items()], "_point string, _factor double")
    joined = groups.withColumn("discharge_point_id", F.col("group_name")).join(F.broadcast(rows), F.col("group_name") == F.col("_point"), "left")
    factor = F.coalesce("_factor", F.lit(float(cfg.default_sensitivity)))
    joined = joined.withColumn("sensitivity_factor", factor).withColumn("unknown_sensitivity", F.col("_factor").isNull())
    eri = F.col("composite_score") * F.col("sensitivity_factor") * cfg.severity_multiplier
    return joined.withColumn("eri", eri).withColumn("risk_band", S.risk_band(F.col("eri"), cfg)).drop("_point", "_factor")


def alerts(eri: DataFrame, cfg: Config, kept: DataFrame | None = None) -> DataFrame:
    """Rows of at least the configured band, cooled down per point; details are masked below HIGH. kept: (discharge_point_id, ts) of alerts told before, which count for the cooldown."""
    least = cfg.alert_min_risk_band
    rank = S.band_rank(F.col("risk_band"))
    rows = eri.where(rank >= (BANDS.index(least) if least in BANDS else 1)).withColumn("_new", F.lit(True))
    if kept is not None:
        rows = rows.unionByName(kept.select("discharge_point_id", "ts"), allowMissingColumns=True)
    rows = cooled(rows, "discharge_point_id", cfg.alert_cooldown_seconds).where("_new")
    shown = rank >= 2
    return rows.select("discharge_point_id", "ts", "eri", "risk_band", S.alert_level(F.col("risk_band")).alias("alert_level"), F.when(shown, F.col("sensitivity_factor")).otherwise(0.0).alias("sensitivity_factor"), F.when(shown, F.col("top_contributor")).otherwise("").alias("top_contributor"), F.when(shown, F.col("alert_message")).otherwise("").alias("alert_message"))
