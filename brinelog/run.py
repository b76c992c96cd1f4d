"""Entry points that join readers, operators and sinks.

The pipeline is four streams, each with its own checkpoint under ``out``: valid factory readings; quarantine of the others;
plant readings over the threshold, which become evidence attributed to a factory; and, from the valid rows, scores, groups, risk indices and gated
alerts, with the KPIs after each batch. Spark's file sink keeps valid rows and quarantine to once each; all other micro-batches write
folders of their own number, so a batch that is repeated after a crash replaces itself: nothing is lost or told twice.

    python -m brinelog.run pipeline --plant-dir data/cetp --factory-dir data/factories --out data/out
    python -m brinelog.run anticheat --factory-dir data/factories --out data/out
"""

from __future__ import annotations

import argparse
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from . import facade
from .config import Config
from .functions import scalars as S
from .operators import forensics, report, risk
from .operators import detect as D
from .sources import files
from .streaming import jobs

NEVER = 1 << 30


def stored(spark: SparkSession, path: str, schema: str, before: int = NEVER) -> DataFrame:
    """Rows of a sink's batches of lower number, with their batch; none if there is nothing yet."""
    kind = f"{schema}, batch int"
    try:
        return spark.read.schema(kind).option("basePath", path).parquet(f"{path}/batch=*").where(F.col("batch") < before)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)


def put(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


VALID = "s_no long, time string, factory_id string, cod double, bod double, ph double, tss double, status string"
SCORED = "sensor_id string, ts timestamp_ntz, value double, rolling_mean double, rolling_std double, z_score double, is_anomaly boolean"
INDEX = "discharge_point_id string, group_name string, bucket timestamp_ntz, ts timestamp_ntz, composite_score double, is_group_anomaly boolean, sensitivity_factor double, eri double, risk_band string, top_contributor string, attribution_detail string, alert_message string"
ALERT = "discharge_point_id string, ts timestamp_ntz, eri double, risk_band string, alert_level string, sensitivity_factor double, top_contributor string, alert_message string"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def alert_batch(spark: SparkSession, batch: DataFrame, number: int, out: str, cfg: Config, began: float, kpis: bool = True) -> None:
    """Scores, indices, alerts and KPIs of a micro-batch of valid rows.

    A reading is scored against its window's valid rows so far. A bucket's group row is made of all its scores so far; that of a later
    batch replaces it (see last_of_each). An alert looks back on the last one kept of its point.
    """
    fresh = facade.readings(batch.where("cod IS NOT NULL"), cfg).where("ts IS NOT NULL")
    span = fresh.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if span.low is None:
        return
    valid = spark.read.schema(VALID).parquet(f"{out}/valid")
    back = F.expr(f"INTERVAL {cfg.window_duration_ms + 120_000} MILLISECONDS")
    near = facade.readings(valid.where("cod IS NOT NULL"), cfg).where(F.col("ts").between(F.lit(span.low).cast("timestamp_ntz") - back, F.lit(span.high).cast("timestamp_ntz")))
    put(D.with_scores(fresh, facade.stats(near, cfg), None, cfg).select(*names(SCORED)), f"{out}/scores", number)
    scored = stored(spark, f"{out}/scores", SCORED, number + 1)
    bucket = S.time_bucket(F.col("ts"), cfg.sync_tolerance_ms)
    touched = scored.where(F.col("batch") == number).select(bucket.alias("_bucket")).distinct()
    whole = scored.withColumn("_of", bucket).join(touched, F.col("_of") == F.col("_bucket"), "left_semi")
    index = risk.risk_index(risk.group_anomalies(whole, cfg), cfg)
    put(index.select(*names(INDEX)), f"{out}/eri", number)
    kept = stored(spark, f"{out}/alerts", ALERT, number).groupBy("discharge_point_id").agg(F.max("ts").alias("ts"))
    put(risk.alerts(spark.read.schema(INDEX).parquet(f"{out}/eri/batch={number}"), cfg, kept).select(*names(ALERT)), f"{out}/alerts", number)
    if not kpis:
        return
    told = stored(spark, f"{out}/eri", INDEX, number + 1).withColumnRenamed("batch", "_batch").transform(jobs.last_of_each("group_name", "bucket"))
    readings = valid.withColumn("ts", S.parsed(F.col("time"), cfg.input_time_format))
    figures = report.kpis(readings, told.where("is_group_anomaly"), told, stored(spark, f"{out}/alerts", ALERT, number + 1), time.monotonic() - began, cfg.alert_cooldown_seconds)
    files.write_kpis(figures, cfg.metrics_output_path)


def start_pipeline(spark: SparkSession, plant_dir: str, factory_dir: str, out: str, cfg: Config, once: bool = True, files_a_batch: int = 1000, globs: tuple[str, str] = ("cetp_clean.csv", "factory_*.csv"), kpis: bool = True) -> list[StreamingQuery]:
    """Starts the streams; with once, each runs to the end of what is there, the alerts after the readings. globs: of plant and factory files. kpis: a file on the driver, see files.write_kpis."""
    began, ts = time.monotonic(), S.parsed(F.col("time"), cfg.input_time_format)
    trigger = {"availableNow": True} if once else {"processingTime": "1 second"}

    def writer(df: DataFrame, name: str):
        return df.writeStream.queryName(name).option("checkpointLocation", f"{out}/checkpoints/{name}").trigger(**trigger)

    readings = files.factory_readings(spark, factory_dir, globs[1], stream=True, files_a_batch=files_a_batch)
    good, bad = D.validated(readings, "factory_id", "time", "cod", cfg, nulls=True)
    running = [writer(good, "valid").format("parquet").start(f"{out}/valid"), writer(bad, "quarantine").format("json").start(f"{out}/quarantine")]
    plant = D.tripwire(files.plant_readings(spark, plant_dir, globs[0], stream=True, files_a_batch=files_a_batch), cfg, "cetp_inlet_cod")
    shocks = plant.select(S.event_id(F.col("sensor_id"), F.col("time")).alias("shock_id"), ts.alias("ts"), F.col("time").alias("cetp_event_time"), F.col("cetp_inlet_cod").alias("cetp_cod"), "breach_mag", "alert_level")

    def attributed(batch: DataFrame) -> DataFrame:
        index = files.factory_index(spark, factory_dir, cfg.input_time_format, globs[1]).drop("time")
        rows = forensics.backtracked(batch, index, cfg.pipe_travel_minutes * 60, cfg.asof_tolerance_seconds)
        return rows.select("cetp_event_time", "cetp_cod", "breach_mag", "alert_level", S.bound_text(F.col("backtrack_time")).alias("backtrack_time"), "attributed_factory", "factory_cod", "factory_bod", "factory_tss")

    running.append(writer(shocks, "plant").foreachBatch(jobs.evidence_batch(attributed, cfg.alert_log_path, cfg.shield_webhook_url)).start())
    if once:
        for q in running:
            q.awaitTermination()
    valid = spark.readStream.schema(VALID).option("maxFilesPerTrigger", files_a_batch).parquet(f"{out}/valid")
    running.append(writer(valid, "alerts").foreachBatch(lambda batch, n: alert_batch(spark, batch, n, out, cfg, began, kpis)).start())
    if once:
        running[-1].awaitTermination()
    return running


def run_pipeline(spark: SparkSession, plant_dir: str, factory_dir: str, out: str, cfg: Config, once: bool = True, **options) -> DataFrame:
    """Runs the pipeline; the alerts that there are when it ends. Without once it runs until one of its streams fails. options: see start_pipeline."""
    queries = start_pipeline(spark, plant_dir, factory_dir, out, cfg.checked(), once, **options)
    if not once:
        try:
            spark.streams.awaitAnyTermination()
        finally:  # all are stopped together, and resumed together by the next run
            for q in queries:
                q.stop()
    return stored(spark, f"{out}/alerts", ALERT)


def run_anticheat(spark: SparkSession, factory_dir: str, cfg: Config) -> DataFrame:
    """All three detectors over all readings; their records, in order of window_end, replace the tamper log."""
    index = files.factory_index(spark, factory_dir, cfg.input_time_format, keep_null=True).where("ts IS NOT NULL")
    zero, dark = cfg.zero_variance_minutes * 60, cfg.blackout_min_minutes * 60
    found = forensics.all_tampering(forensics.zero_variance(index, zero), forensics.dilution(index, 3600, cfg.cod_drop_fraction, cfg.tss_stable_fraction), forensics.blackout(index, dark))
    files.overwrite_jsonl(found.withColumn("window_end", S.bound_text(F.col("window_end"))).orderBy("window_end", "tamper_type", "factory_id"), cfg.tamper_log_path)
    return files.tamper_log(spark, cfg.tamper_log_path)


def watch_anticheat(spark: SparkSession, factory_dir: str, out: str, cfg: Config, once: bool = True, files_a_batch: int = 1000) -> StreamingQuery:
    """The detectors on a stream of readings, each kind of record to a log of its own; windows are told once the watermark has closed them."""
    rows = files.factory_readings(spark, factory_dir, stream=True, files_a_batch=files_a_batch).select("factory_id", S.parsed(F.col("time"), cfg.input_time_format).alias("ts"), "cod", "tss", F.col("s_no").alias("event_id"))
    zero = {"width_s": cfg.zero_variance_minutes * 60, "least": 1e-4, "min_rows": 2}
    dilution = {"width_s": 3600, "drop": cfg.cod_drop_fraction, "stable": cfg.tss_stable_fraction, "min_rows": 3}
    blackout = {"width_s": cfg.blackout_min_minutes * 60, "ratio": 0.8, "min_rows": max(1, cfg.blackout_min_minutes)}
    found = jobs.tampering(rows, cfg.watermark, zero, dilution, blackout)
    with jobs.settings(spark):
        query = found.writeStream.queryName("anticheat").option("checkpointLocation", f"{out}/checkpoints/anticheat").foreachBatch(jobs.tamper_batch(cfg.tamper_log_path)).trigger(**({"availableNow": True} if once else {"processingTime": "1 second"})).start()
    if once:
        query.awaitTermination()
    return query


def main() -> None:
    from .session import session

    cfg = Config.from_env().checked()
    p = argparse.ArgumentParser(prog="brinelog.run")
    p.add_argument("what", choices=["pipeline", "anticheat"])
    p.add_argument("--plant-dir", default=cfg.cetp_dir)
    p.add_argument("--factory-dir", default=cfg.factory_dir)
    p.add_argument("--out", default="data/out")
    p.add_argument("--once", action="store_true", help="stop at the end of what is there")
    a = p.parse_args()
    spark = session(a.what)
    if a.what == "pipeline":
        run_pipeline(spark, a.plant_dir, a.factory_dir, a.out, cfg, a.once)
    else:
        print(f"{run_anticheat(spark, a.factory_dir, cfg).count()} tamper records in {cfg.tamper_log_path}")


if __name__ == "__main__":
    main()
