"""Queries over the driver's tables, each with SQL that gives the same rows.

events stand for readings: event_type is the sensor (five of them), user_id the factory, value the measure, the length of
props a second one. Doubles that come from sums or interpolation are rounded to six places on both sides, as their last bits depend on the order of work.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import facade, scratch
from ..config import Config
from ..functions import scalars as S
from ..operators import detect, forensics, report, risk
from ..sources import files, schemas

CFG = replace(
    Config(), zscore_threshold=1.5, cod_threshold=150.0, cod_baseline=100.0, alert_cooldown_seconds=6 * 3600, group_threshold=1.0, sync_tolerance_ms=3_600_000,
    sensor_value_range={"*click*": [0.0, 100.0], "*e*": [0.0, 200.0], "*": [-1e9, 1e9]},
    sensor_groups={"g_all": ["click", "view", "purchase", "signup", "error"], "g_web": ["click", "view"]}, river_sensitivity={"g_all": 3.5}, severity_multiplier=2.0,
)
DAY = 86_400


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def readings(spark, sf):
    return events(spark, sf).select(F.col("event_type").alias("sensor_id"), "ts", "value", "event_id")


def factories(spark, sf):
    cod = F.when(F.col("event_type") != "error", F.col("value"))
    return events(spark, sf).select(F.col("user_id").alias("factory_id"), "ts", cod.alias("cod"), F.length("props").cast("double").alias("tss"), "event_id", "value")


def r6(*names: str):
    return lambda df: df.withColumns({n: F.round(n, 6) for n in names})


def dirty(spark, sf):
    """Readings with flaws by event_id."""
    i = F.col("event_id")
    return events(spark, sf).select(
        "event_id", F.when(i % 41 == 0, F.lit(None)).when(i % 43 == 0, F.lit("  ")).when(i % 47 == 0, F.repeat("event_type", F.lit(20))).otherwise(F.col("event_type")).alias("sensor_id"),
        F.when(i % 53 == 0, F.lit(None)).when(i % 59 == 0, F.lit("invalid date")).when(i % 61 == 0, F.lit("1740743600")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("timestamp"),
        F.when(i % 67 == 0, F.lit(None)).when(i % 71 == 0, F.lit(float("nan"))).when(i % 73 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"),
    )


DIRTY = """d AS (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN '  ' WHEN event_id % 47 = 0 THEN repeat(event_type, 20) ELSE event_type END AS sensor_id,
 CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN 'invalid date' WHEN event_id % 61 = 0 THEN '1740743600' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS timestamp,
 CASE WHEN event_id % 67 = 0 THEN NULL WHEN event_id % 71 = 0 THEN 'nan'::DOUBLE WHEN event_id % 73 = 0 THEN 'inf'::DOUBLE ELSE value END AS value FROM events),
v AS (SELECT *, CASE WHEN sensor_id IS NULL THEN 'missing ''sensor_id''' WHEN timestamp IS NULL THEN 'missing ''timestamp''' WHEN value IS NULL THEN 'missing ''value'''
 WHEN trim(sensor_id) = '' THEN 'invalid ''sensor_id type/content: str' WHEN length(sensor_id) > 64 THEN 'sensor_id exceeds max length (' || length(sensor_id) || ' > 64)'
 WHEN isnan(value) THEN 'value must be finite (got nan)' WHEN isinf(value) THEN 'value must be finite (got inf)' WHEN timestamp = 'invalid date' THEN 'invalid ''timestamp'' format: ''invalid date'''
 WHEN sensor_id LIKE '%click%' THEN CASE WHEN value > 100 THEN 'value ' || value || ' out of range [0.0, 100.0] for pattern ''*click*''' ELSE '' END
 WHEN sensor_id LIKE '%e%' THEN CASE WHEN value > 200 THEN 'value ' || value || ' out of range [0.0, 200.0] for pattern ''*e*''' ELSE '' END ELSE '' END AS reason FROM d)"""


def validate_valid(spark, sf):
    return detect.validated(dirty(spark, sf), "sensor_id", "timestamp", "value", CFG)[0]


def validate_quarantine(spark, sf):
    bad = detect.validated(dirty(spark, sf), "sensor_id", "timestamp", "value", CFG)[1]
    told = F.from_json("record", "event_id long, sensor_id string, timestamp string, value string", {"allowNonNumericNumbers": "true"})
    recent = F.col("received_at").between(F.unix_micros(F.current_timestamp()) / 1e6 - 86_400, F.unix_micros(F.current_timestamp()) / 1e6 + 86_400)
    return bad.select(told.alias("r"), "rejection_reason", recent.alias("received")).select("r.event_id", "r.sensor_id", "r.timestamp", F.col("r.value").try_cast("double").alias("value"), "rejection_reason", "received")


def tripwire(spark, sf):
    return detect.tripwire(events(spark, sf), CFG, "value").select("event_id", "value", F.round("breach_mag", 6).alias("breach_mag"), "alert_level")


def rolling_mean(spark, sf):
    return detect.rolling_mean(readings(spark, sf), "6 hours", "1 hour").select("ts", F.round("rolling_mean", 6).alias("rolling_mean"))


def _ends(group: str, hours: int = 6) -> str:
    """Windows of so many hours that end on the hour, and their rows."""
    return f"w AS (SELECT {group} date_trunc('hour', ts) + to_hours(k) AS window_end, ts, value FROM events, generate_series(1, {hours}) AS g(k))"


def windowed_stats(spark, sf):
    return detect.sliding_stats(readings(spark, sf), "6 hours", "1 hour").transform(r6("mean", "std"))


STATS = _ends("event_type AS sensor_id,") + """, s AS (SELECT sensor_id, window_end - INTERVAL 6 HOUR AS window_start, window_end, avg(value) AS mean,
 sqrt(greatest(0.0, avg(value * value) - avg(value) * avg(value))) + 1e-9 AS std, min(value) AS min, max(value) AS max, count(*) AS sample_count FROM w GROUP BY sensor_id, window_end)"""
SCORES = STATS + """, z AS (SELECT e.event_type AS sensor_id, e.ts, e.value, e.event_id, s.mean AS rolling_mean, s.std AS rolling_std, (e.value - s.mean) / s.std AS z_score,
 abs((e.value - s.mean) / s.std) > 1.5 AS is_anomaly FROM events e JOIN s ON s.sensor_id = e.event_type AND s.window_end = date_trunc('hour', e.ts) WHERE s.sample_count >= 1)"""


def scores(spark, sf):
    return detect.scored(readings(spark, sf), "6 hours", "1 hour", "hour", CFG)


def zscore(spark, sf):
    """Windows of one row or of equal ones have hardly more than epsilon for a deviation; there a score's sign is shown, as its size is noise."""
    rows = scores(spark, sf)
    flat = F.col("rolling_std") <= 1e-6
    return rows.withColumn("z_score", F.when(flat, F.signum(F.round(F.col("value") - F.col("rolling_mean"), 6))).otherwise(F.col("z_score"))).withColumn("deviation", F.col("value") - F.col("rolling_mean")).transform(r6("rolling_mean", "rolling_std", "z_score", "deviation"))


def persistence(spark, sf):
    rows = detect.persisted(scores(spark, sf), 2, "event_id")
    return rows.select("sensor_id", "ts", "event_id", "consecutive_count")


ISLANDS = SCORES + """, i AS (SELECT *, sum(CASE WHEN is_anomaly THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS island FROM z),
 p AS (SELECT sensor_id, ts, event_id, is_anomaly, CAST(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id, island ORDER BY ts, event_id) AS BIGINT) AS consecutive_count FROM i)"""


def persistence_strict(spark, sf):
    return detect.persisted(scores(spark, sf), CFG.persistence_count, "event_id").select("sensor_id", "ts", "event_id", "consecutive_count")


def standard(spark, sf):
    """Readings with value / 100 for a score: group operators take any (sensor_id, ts, z_score)."""
    return readings(spark, sf).select("sensor_id", "ts", (F.col("value") / 100).alias("z_score"))


def groups(spark, sf):
    return risk.group_anomalies(standard(spark, sf), CFG)


def group_anomalies(spark, sf):
    rows = groups(spark, sf).select("group_name", "bucket", "ts", "n", "composite_score", "contributing_sensors", "missing_sensors", "is_group_anomaly", "top_contributor", "alert_message", "attribution_detail")
    return rows.transform(r6("composite_score"))


GROUPS = """m(group_name, sensor_id, pos) AS (VALUES ('g_all', 'click', 0), ('g_all', 'view', 1), ('g_all', 'purchase', 2), ('g_all', 'signup', 3), ('g_all', 'error', 4), ('g_web', 'click', 0), ('g_web', 'view', 1)),
 j AS (SELECT group_name, sensor_id, pos, ts, value / 100 AS z, date_trunc('hour', ts) AS bucket FROM events JOIN m ON m.sensor_id = event_type),
 l AS (SELECT group_name, bucket, sensor_id, pos, arg_max(z, {'t': ts, 'z': z}) AS z FROM j GROUP BY ALL),
 f AS (SELECT group_name, bucket, sensor_id, pos, z * z / sum(z * z) OVER (PARTITION BY group_name, bucket) AS fraction FROM l),
 t AS (SELECT group_name, bucket, arg_min(sensor_id, {'f': -fraction, 'p': pos}) AS top_contributor, max(fraction) AS top_fraction, string_agg(sensor_id, ',' ORDER BY pos) AS contributing_sensors, '{' || string_agg('"' || sensor_id || '":' || round_even(fraction, 3), ',' ORDER BY fraction DESC, pos) || '}' AS attribution_detail FROM f GROUP BY ALL),
 x AS (SELECT t.group_name, t.bucket, coalesce(string_agg(m.sensor_id, ',' ORDER BY m.pos), '') AS missing_sensors FROM t JOIN m ON m.group_name = t.group_name
   WHERE NOT list_contains(string_split(contributing_sensors, ','), m.sensor_id) GROUP BY ALL),
 c AS (SELECT group_name, bucket, max(ts) AS ts, count(*) AS n, sqrt(sum(z * z) / count(*)) AS composite_score FROM j GROUP BY ALL),
 g AS (SELECT c.*, contributing_sensors, coalesce(missing_sensors, '') AS missing_sensors, composite_score > 1.0 AS is_group_anomaly, top_contributor, top_fraction, attribution_detail,
   'Anomaly in ' || c.group_name || ': primary driver ' || top_contributor || ' (' || CAST(round_even(top_fraction * 100, 0) AS INTEGER) || '% of score)' AS alert_message
   FROM c JOIN t USING (group_name, bucket) LEFT JOIN x USING (group_name, bucket)),
 r AS (SELECT *, CASE WHEN group_name = 'g_all' THEN 3.5 ELSE 2.0 END AS sensitivity_factor, group_name <> 'g_all' AS unknown_sensitivity FROM g),
 e AS (SELECT *, composite_score * sensitivity_factor * 2.0 AS eri FROM r),
 b AS (SELECT *, CASE WHEN eri < 2 THEN 'LOW' WHEN eri < 5 THEN 'MEDIUM' WHEN eri < 10 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_band, CASE WHEN eri < 2 THEN 0 WHEN eri < 5 THEN 1 WHEN eri < 10 THEN 2 ELSE 3 END AS band FROM e)"""


def attribution(spark, sf):
    rows = groups(spark, sf).select("group_name", "bucket", F.posexplode("shares").alias("place", "share"))
    return rows.select("group_name", "bucket", "place", F.col("share.sensor").alias("sensor_id"), F.round("share.fraction", 6).alias("fraction"))


def eri(spark, sf):
    rows = risk.risk_index(groups(spark, sf), CFG)
    return rows.select("discharge_point_id", "bucket", "sensitivity_factor", "eri", "risk_band", "unknown_sensitivity").transform(r6("eri"))


def alerts(spark, sf):
    return risk.alerts(risk.risk_index(groups(spark, sf), CFG), CFG).transform(r6("eri"))


def cooldown(spark, sf):
    rows = events(spark, sf).where("value >= 100").select("user_id", "ts", "event_id", "value")
    return risk.cooled(rows, "user_id", DAY, tie="event_id")


def backtrack(spark, sf):
    shocks = events(spark, sf).where("value >= 200").select(F.col("event_id").alias("shock_id"), "ts", "value")
    sources = factories(spark, sf).select("factory_id", "ts", "cod", "tss")
    return forensics.backtracked(shocks, sources, 15 * 60, 120)


def _tamper(spark, sf):
    f = scratch.written(factories(spark, sf).select("factory_id", "ts", "cod", "tss", "event_id"))  # read by three detectors
    return (
        forensics.zero_variance(f.where("cod IS NOT NULL"), DAY, 1.0, tie="event_id"),
        forensics.dilution(f, DAY, 0.8, 0.2, tie="event_id"),
        forensics.blackout(f, DAY, 0.8, 3, tie="event_id"),
    )


def tamper_zero_variance(spark, sf):
    return _tamper(spark, sf)[0].transform(r6("cod_range"))


def tamper_dilution(spark, sf):
    return _tamper(spark, sf)[1].transform(r6("mean_cod", "mean_tss", "baseline_cod", "baseline_tss"))


def tamper_blackout(spark, sf):
    return _tamper(spark, sf)[2].transform(r6("blackout_ratio"))


def tamper_all(spark, sf):
    rows = forensics.all_tampering(*_tamper(spark, sf))
    rounded = rows.transform(r6("cod_range", "mean_cod", "mean_tss", "baseline_cod", "baseline_tss", "blackout_ratio"))
    shown = {c: rounded[c] for c in rounded.columns} | {c: F.format_string("%.6f", rounded[c]) for c in ("cod_max", "cod_range", "mean_cod", "baseline_cod", "mean_tss")}
    return rounded.select("tamper_type", "factory_id", "window_end", "cod_range", "mean_cod", "blackout_ratio", S.tamper_detail(shown).alias("detail")).orderBy("window_end", "tamper_type", "factory_id")


def _anchored(rows: str) -> str:
    return f"a AS (SELECT *, epoch(ts) // 1 AS sec FROM ({rows})), w AS (SELECT *, CAST(floor((floor(epoch(ts)) - min(floor(epoch(ts))) OVER (PARTITION BY factory_id)) / 86400) AS BIGINT) AS b FROM a)"


FACTORY = "SELECT user_id AS factory_id, ts, CASE WHEN event_type <> 'error' THEN value END AS cod, CAST(length(props) AS DOUBLE) AS tss, event_id FROM events"
ZERO = _anchored(f"SELECT * FROM ({FACTORY}) WHERE cod IS NOT NULL") + """ SELECT 'ZERO_VARIANCE' AS tamper_type, factory_id, arg_max(ts, {'t': ts, 'e': event_id}) AS window_end, max(cod) AS cod_max, min(cod) AS cod_min,
 round(max(cod) - min(cod), 6) AS cod_range, count(*) AS row_count FROM w GROUP BY factory_id, b HAVING count(*) >= 2 AND max(cod) - min(cod) < 1.0"""
DILUTION = _anchored(f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY factory_id) AS total FROM ({FACTORY}) WHERE cod IS NOT NULL AND tss IS NOT NULL) WHERE total >= 6") + """,
 q AS (SELECT factory_id, b, avg(cod) AS mean_cod, avg(tss) AS mean_tss, arg_max(ts, {'t': ts, 'e': event_id}) AS window_end FROM w GROUP BY factory_id, b HAVING count(*) >= 3),
 k AS (SELECT *, lag(mean_cod) OVER (PARTITION BY factory_id ORDER BY b) AS baseline_cod, lag(mean_tss) OVER (PARTITION BY factory_id ORDER BY b) AS baseline_tss FROM q)
 SELECT 'DILUTION_TAMPER' AS tamper_type, factory_id, window_end, round(mean_cod, 6) AS mean_cod, round(mean_tss, 6) AS mean_tss, round(baseline_cod, 6) AS baseline_cod, round(baseline_tss, 6) AS baseline_tss
 FROM k WHERE mean_cod <= baseline_cod * (1 - 0.8) AND mean_tss >= baseline_tss * (1 - 0.2)"""
DARK = _anchored(FACTORY) + """ SELECT 'BLACKOUT_TAMPER' AS tamper_type, factory_id, arg_max(ts, {'t': ts, 'e': event_id}) AS window_end, count(*) AS total_rows, count(*) FILTER (WHERE cod IS NULL) AS blackout_rows,
 round(count(*) FILTER (WHERE cod IS NULL) / count(*), 6) AS blackout_ratio FROM w GROUP BY factory_id, b HAVING count(*) >= 3 AND count(*) FILTER (WHERE cod IS NULL) / count(*) >= 0.8"""


def kpis(spark, sf):
    """The index and the alerts are written once, so that each step of the chain is worked once."""
    rows = scratch.written(risk.risk_index(groups(spark, sf), CFG))
    raised = scratch.written(risk.alerts(rows, CFG))
    out = report.kpis(events(spark, sf), rows.where("is_group_anomaly"), rows, raised, cooldown_s=CFG.alert_cooldown_seconds).transform(r6("avg_eri_last_5min"))
    return out.drop("pipeline_uptime_seconds")


def latency_percentiles(spark, sf):
    return report.latency(events(spark, sf).select("ts", F.col("value").alias("latency_ms")), None).transform(r6("p50", "p99"))


def latency_recent(spark, sf):
    rows = report.latency(events(spark, sf).select("event_id", F.col("value").alias("latency_ms")), 1000, "event_id").transform(r6("p50", "p99"))
    return rows.withColumn("summary", S.latency_summary(F.col("p50"), F.col("p99"), F.lit(2.0)))


def alerts_per_minute(spark, sf):
    rows = events(spark, sf).where("value >= 100")
    return report.per_minute(rows, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 6 * 3600.0)


def stage_unpivot(spark, sf):
    at = F.col("event_id").cast("double")
    rows = events(spark, sf).select(S.event_id(F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("event_id"), at.alias("ingestion"), (at + 0.25).alias("scoring"), F.when(F.col("value") >= 50, at + 0.5).alias("gate"), F.when(F.col("value") >= 100, at + 1.0).alias("alert"))
    return report.stage_rows(rows, ["ingestion", "scoring", "gate", "alert"])


def factory_summary(spark, sf):
    return report.factory_summary(factories(spark, sf)).transform(r6("mean_cod", "std_cod"))


def factory_extremes(spark, sf):
    return report.extremes(report.factory_summary(factories(spark, sf))).transform(r6("steady_std"))


def top_attributed(spark, sf):
    return report.counted(backtrack(spark, sf), "attributed_factory")


def recent_k(spark, sf):
    return report.recent(detect.tripwire(events(spark, sf), CFG, "value").select("event_id", "ts", "value", "alert_level"), 12, "ts", "event_id")


def window_slice(spark, sf):
    return report.window_slice(events(spark, sf).select("event_id", "ts", "value"), 24, 150.0)


def breach_count(spark, sf):
    return report.breach_figures(events(spark, sf), 150.0)


def distinct_sensors(spark, sf):
    return events(spark, sf).select(F.col("event_type").alias("sensor_id")).distinct()


def slice_figures(spark, sf):
    return report.slice_figures(readings(spark, sf), 24, 150.0).transform(r6("mean"))


def alert_levels(spark, sf):
    return report.tally(tripwire(spark, sf), "alert_level")


def tamper_types(spark, sf):
    return report.tally(forensics.all_tampering(*_tamper(spark, sf)), "tamper_type")


def csv_roundtrip(spark, sf):
    """Readings through a CSV folder and the factory reader: blackouts tagged, nulls kept."""
    path = scratch.folder(spark)
    i = F.col("event_id")
    rows = events(spark, sf).select(i.alias("s_no"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), F.col("user_id").cast("string").alias("factory_id"), F.when(i % 7 > 0, F.col("value")).alias("cod"), F.lit(45.5).alias("bod"), F.lit(7.2).alias("ph"), F.length("props").cast("double").alias("tss"))
    files.write_csv(rows, path)
    return files.factory_readings(spark, path, glob="*.csv").select("s_no", "time", "factory_id", "cod", "ph", "status")


def jsonl_scan(spark, sf):
    path = scratch.folder(spark)
    rows = backtrack(spark, sf).select("shock_id", "value", "attributed_factory", "factory_cod")
    rows.write.json(path)
    return files.jsonl(spark, path, rows.schema)


def stream_windowed_stats(spark, sf):
    from ..streaming import jobs

    return jobs.replayed(spark, events(spark, sf).schema, f"{sf}/events.parquet", lambda s: jobs.sliding_stats(s.select(F.col("event_type").alias("sensor_id"), "ts", "value"), "6 hours", "1 hour", "1 day"), scratch.folder(spark), "update").transform(jobs.last_of_each("sensor_id", "window_end")).transform(r6("mean", "std"))



def reset_counts(spark, sf):
    return detect.resets(scores(spark, sf), "event_id")


OWN = replace(CFG, input_schema_sensor_column="machine", input_schema_value_column="level", window_duration_ms=3_600_000, window_hop_ms=60_000, persistence_count=1, zscore_threshold=1.0)


def facade_detect(spark, sf):
    """A table with names of its own, times as text, through the facade: renamed, scored against the hour before, held to the run length."""
    own = events(spark, sf).select(F.col("event_type").alias("machine"), F.col("value").cast("string").alias("level"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), "event_id", "props")
    return facade.detect(own, OWN, tie="event_id").select("sensor_id", "ts", "value", "event_id", "consecutive_count", F.round("rolling_mean", 6).alias("rolling_mean"))


def _factory_csv(spark, sf, **values) -> str:
    """Factory readings as a CSV folder; cod is empty for each 7th event and no number for each 11th if asked."""
    path = scratch.folder(spark)
    i = F.col("event_id")
    cod = F.when(i % 7 == 0, F.lit(None)).when((i % 11 == 0) & F.lit(values.get("odd", False)), F.lit("n/a")).otherwise(F.col("value").cast("string"))
    files.write_csv(events(spark, sf).select(i.alias("s_no"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), F.col("user_id").cast("string").alias("factory_id"), cod.alias("cod"), F.lit(45.5).alias("bod"), F.lit(7.2).alias("ph"), F.length("props").cast("double").alias("tss")), path)
    return path


def stream_clean_factories(spark, sf):
    """CSV files as a stream, blackouts left out."""
    from ..streaming import jobs

    rows = files.factory_readings(spark, _factory_csv(spark, sf), glob="*.csv", stream=True, include_blackout=False, files_a_batch=3)
    return jobs.drained(rows, scratch.folder(spark))[0].select("s_no", "time", "factory_id", "cod", "tss", "status")


def factory_full_load(spark, sf):
    """All readings, cells that are no numbers null."""
    return files.factory_index(spark, _factory_csv(spark, sf, odd=True), "yyyy-MM-dd HH:mm", glob="*.csv", keep_null=True).select("factory_id", "ts", "cod", "tss")


def dashboard_load(spark, sf):
    path, i = scratch.folder(spark), F.col("event_id")
    time = F.when(i % 13 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    cells = {f.name: F.lit(1.5) for f in schemas.CETP} | {"s_no": i, "time": time, "cetp_inlet_cod": F.when(i % 11 == 0, F.lit("NA")).when(i % 7 > 0, F.col("value").cast("string"))}
    files.write_csv(events(spark, sf).select(*[c.alias(n) for n, c in cells.items()]), path)
    return files.dashboard_readings(spark, path, "yyyy-MM-dd HH:mm", glob="*.csv").select("s_no", "ts", "cetp_inlet_cod", "cetp_outlet_ph")


def tamper_log(spark, sf):
    """Records of all detectors, written over an older log and read back."""
    path = scratch.folder(spark)
    found = forensics.all_tampering(*_tamper(spark, sf)).withColumn("window_end", S.bound_text(F.col("window_end")))
    files.overwrite_jsonl(found.limit(1), path)
    files.overwrite_jsonl(found, path)
    rows = files.tamper_log(spark, path)
    return rows.withColumn("logged", F.col("logged_at").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")).drop("logged_at").transform(r6("cod_range", "mean_cod", "mean_tss", "baseline_cod", "baseline_tss", "blackout_ratio"))


#: Days of a file of the fed streams; rows come a file late at most, within the watermark.
BLOCK, LATE = 10, "12 days"


#: A batch of a fed stream is so many files at most, of so many rows at least.
FILES, FILE_ROWS = 16, 200_000


def _feed(df: DataFrame, batch, files: int, closing: dict | None = None) -> tuple[str, int]:
    """Writes df as files of a stream, as many for each batch; (where, how many a batch). batch: rows by their batch from 0. closing: a last row far ahead, which lets time pass for all keys.

    df is read once for each batch, so what is not simply read from a table should be written before.
    """
    path, rows = scratch.folder(df.sparkSession), df.withColumn("_file", batch)
    sizes = [r.n for r in rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()]
    each = max(1, min(FILES, min(sizes, default=0) // FILE_ROWS)) if len(sizes) == files else 1
    for k in range(files):  # one after another, so that they are read in this order
        part = rows.where(F.col("_file") == k).select(*df.columns)
        (part.repartition(each) if each > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    if each > 1 and len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()) != files * each:
        raise RuntimeError(f"{path} should have {files} times {each} files")
    if closing is not None:
        last = df.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
        end = last.select(*[F.col("ts") if f.name == "ts" else F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        end.coalesce(1).write.mode("append").parquet(path)
    return path, each


def _block(late_every: int = 3):
    """A row's file: its stretch of days, or the next one's for each late_every-th event."""
    days = F.floor(S.micros(F.col("ts")) / (BLOCK * DAY * 1_000_000)) - F.lit(int(19723 / BLOCK))  # from 2024-01-01 on
    return F.least(F.greatest(days, F.lit(0)), F.lit(2)) + F.when(F.col("event_id") % late_every == 0, 1).otherwise(0)


def stream_late_revisions(spark, sf):
    """Windows that late rows revise: rows a file late are taken in, each 50th row comes at the very end, mostly too late and refused window by window.

    Spark refuses what the watermark of the batch before had passed, so that is what the SQL takes for a file's mark."""
    from ..streaming import jobs

    rows = readings(spark, sf)
    file = F.when(F.col("event_id") % 50 == 7, 4).otherwise(_block())
    path, each = _feed(rows, file, 5)
    build = lambda s: jobs.sliding_stats(s, "6 hours", "1 hour", LATE)
    out = jobs.replayed(spark, rows.schema, path, build, scratch.folder(spark), "update", each)
    return out.transform(jobs.last_of_each("sensor_id", "window_end")).transform(r6("mean", "std"))


def stream_persistence(spark, sf):
    from ..streaming import jobs

    rows = scratch.written(scores(spark, sf).select("sensor_id", "ts", "event_id", "is_anomaly"))
    path, each = _feed(rows, _block(), 4, {"sensor_id": "", "event_id": -1})
    return jobs.replayed(spark, rows.schema, path, lambda s: jobs.persisted(s, 2, LATE), scratch.folder(spark), "append", each).drop("_batch")


def stream_cooldown(spark, sf):
    from ..streaming import jobs

    rows = events(spark, sf).where("value >= 100").select("user_id", "ts", "event_id", "value")
    path, each = _feed(rows, _block(), 4, {"user_id": -1, "event_id": -1})
    return jobs.replayed(spark, rows.schema, path, lambda s: jobs.cooled(s, "user_id", DAY, LATE), scratch.folder(spark), "append", each).drop("_batch")


def stream_tamper(spark, sf):
    from ..streaming import jobs

    rows = factories(spark, sf).select("factory_id", "ts", "cod", "tss", "event_id")
    path, each = _feed(rows, _block(), 4, {"factory_id": -1, "event_id": -1})
    build = lambda s: jobs.tampering(s, LATE, {"width_s": DAY, "least": 1.0, "min_rows": 2}, {"width_s": DAY, "drop": 0.8, "stable": 0.2, "min_rows": 3}, {"width_s": DAY, "ratio": 0.8, "min_rows": 3})
    out = jobs.replayed(spark, rows.schema, path, build, scratch.folder(spark), "append", each)
    return out.drop("_batch").transform(r6("cod_range", "mean_cod", "mean_tss", "baseline_cod", "baseline_tss", "blackout_ratio"))


STAGES = {"ingestion": (0, -1.0), "scoring": (250, -1.0), "gate": (500, 50.0), "alert": (1000, 100.0)}


def stream_stages(spark, sf):
    """Four streams, an event's stages, joined within five seconds; stages that an event never reaches are told as missing."""
    from ..streaming import jobs

    rows = events(spark, sf).select("event_id", "ts", "value")
    path, each = _feed(rows, _block(), 4, {"event_id": -1, "value": 1e9})
    feed = lambda: jobs.source(spark, rows.schema, path, each)
    stages = {n: feed().where(F.col("value") >= least).select("event_id", (F.col("ts") + F.expr(f"INTERVAL {ms} MILLISECONDS")).alias("ts")) for n, (ms, least) in STAGES.items()}
    out = jobs.drained(jobs.stage_rows(jobs.stage_timeline(stages, "5 SECONDS", LATE), list(STAGES)), scratch.folder(spark))[0]
    return out.where("event_id >= 0").drop("_batch").transform(r6("latency_ms"))


def stream_backtrack(spark, sf):
    from ..streaming import jobs

    rows = events(spark, sf).select("event_id", "ts", "value", F.col("user_id").alias("factory_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("cod"), F.length("props").cast("double").alias("tss"))
    path, each = _feed(rows, _block(), 4, {"event_id": -1, "value": 1e9, "factory_id": -1, "cod": 0.0})
    feed = lambda: jobs.source(spark, rows.schema, path, each)
    shocks = feed().where("value >= 200").select(F.col("event_id").alias("shock_id"), "ts", "value")
    matches = jobs.drained(jobs.backtrack_matches(shocks, feed(), 15 * 60, 120, LATE), scratch.folder(spark))[0]
    return jobs.strongest(matches.where("shock_id >= 0"), 15 * 60)


def stream_active_alerts(spark, sf):
    from ..streaming import jobs

    rows = scratch.written(alerts(spark, sf).select("discharge_point_id", "ts", "risk_band", F.xxhash64("ts").alias("event_id")))
    path, each = _feed(rows, _block(), 4, {})
    return jobs.replayed(spark, rows.schema, path, lambda s: jobs.active_alerts(s, "6 hours", "1 hour", LATE), scratch.folder(spark), "append", each).drop("_batch")


def stream_split(spark, sf):
    """A stream of flawed records to two file sinks, valid rows and quarantine, read back together."""
    from ..streaming import jobs

    rows, out = dirty(spark, sf), scratch.folder(spark)
    feed = jobs.source(spark, rows.schema, *_feed(rows, F.col("event_id") % 3, 3))
    good, bad = detect.validated(feed, "sensor_id", "timestamp", "value", CFG)
    jobs.filed(good, f"{out}/valid", f"{out}/state/valid")
    jobs.filed(bad, f"{out}/quarantine", f"{out}/state/quarantine", "json")
    kept = spark.read.parquet(f"{out}/valid").select("event_id", F.lit("").alias("reason"))
    told = spark.read.schema("record string, rejection_reason string, received_at double").json(f"{out}/quarantine")
    return kept.unionByName(told.select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"), F.col("rejection_reason").alias("reason")))


def stream_evidence(spark, sf):
    """Shocks of a stream to the evidence log, each micro-batch attributed as a whole, and the log read back."""
    from ..streaming import jobs

    rows, out = events(spark, sf).select("event_id", "ts", "value"), scratch.folder(spark)
    feed = jobs.source(spark, rows.schema, *_feed(rows, F.col("event_id") % 3, 3))
    shocks = detect.tripwire(feed, CFG, "value").where("value >= 200").select(F.col("event_id").alias("shock_id"), "ts", F.col("value").alias("cetp_cod"), "breach_mag", "alert_level")
    sources = factories(spark, sf).select("factory_id", "ts", "cod", "tss")

    def attributed(batch: DataFrame) -> DataFrame:
        found = forensics.backtracked(batch, sources, 15 * 60, 120)
        return found.select(S.bound_text(F.col("ts")).alias("cetp_event_time"), "cetp_cod", "breach_mag", "alert_level", S.bound_text(F.col("backtrack_time")).alias("backtrack_time"), F.col("attributed_factory").cast("string").alias("attributed_factory"), "factory_cod", "factory_tss")

    jobs.sunk(shocks, jobs.evidence_batch(attributed, f"{out}/log"), f"{out}/state")
    return files.jsonl(spark, f"{out}/log", schemas.EVIDENCE).drop("logged_at", "factory_bod").transform(r6("breach_mag"))


def stream_tamper_log(spark, sf):
    """Tampering on a stream to a log for each kind of record, read back as one."""
    from ..streaming import jobs

    rows, out = factories(spark, sf).select("factory_id", "ts", "cod", "tss", "event_id"), scratch.folder(spark)
    feed = jobs.source(spark, rows.schema, *_feed(rows, _block(), 4, {"factory_id": -1, "event_id": -1}))
    found = jobs.tampering(feed, LATE, {"width_s": DAY, "least": 1.0, "min_rows": 2}, {"width_s": DAY, "drop": 0.8, "stable": 0.2, "min_rows": 3}, {"width_s": DAY, "ratio": 0.8, "min_rows": 3})
    jobs.sunk(found, jobs.tamper_batch(f"{out}/log"), f"{out}/state")
    return files.tamper_log(spark, f"{out}/log").drop("logged_at").transform(r6("cod_range", "mean_cod", "mean_tss", "baseline_cod", "baseline_tss", "blackout_ratio"))


def pipeline_alerts(spark, sf):
    """The whole pipeline from CSV folders to alerts: readings split, scored against the hour before, grouped, indexed and gated."""
    from .. import run

    out, i = scratch.folder(spark), F.col("event_id")
    time = F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time")
    files.write_csv(events(spark, sf).select(i.alias("s_no"), time, F.col("event_type").alias("factory_id"), F.when(i % 7 > 0, F.col("value")).alias("cod"), F.lit(45.5).alias("bod"), F.lit(7.2).alias("ph"), F.lit(80.0).alias("tss")), f"{out}/factories", compression="gzip")
    files.write_csv(events(spark, sf).select(*[{"s_no": i, "time": time, "cetp_inlet_cod": F.col("value")}.get(f.name, F.lit(1.0)).alias(f.name) for f in schemas.CETP]), f"{out}/plant", compression="gzip")
    cfg = replace(CFG, sensor_value_range={"*": [-1e9, 1e9]}, window_duration_ms=3_600_000, window_hop_ms=60_000, metrics_output_path=f"{out}/kpis", alert_log_path=f"{out}/evidence")
    rows = run.run_pipeline(spark, f"{out}/plant", f"{out}/factories", f"{out}/run", cfg, globs=("*.csv.gz", "*.csv.gz"), kpis=False)
    return rows.select("discharge_point_id", "ts", F.round(F.log10("eri"), 6).alias("log_eri"), "risk_band", "alert_level", "sensitivity_factor", "top_contributor", "alert_message")


def queries() -> dict:
    own = [
        validate_valid, validate_quarantine, tripwire, rolling_mean, windowed_stats, zscore, persistence, persistence_strict, group_anomalies, attribution, eri, alerts, cooldown, backtrack,
        tamper_zero_variance, tamper_dilution, tamper_blackout, tamper_all, kpis, latency_percentiles, latency_recent, alerts_per_minute, stage_unpivot, factory_summary, factory_extremes,
        top_attributed, recent_k, window_slice, breach_count, distinct_sensors, csv_roundtrip, jsonl_scan, stream_windowed_stats, slice_figures, alert_levels, tamper_types,
        reset_counts, facade_detect, stream_clean_factories, factory_full_load, dashboard_load, tamper_log,
        stream_late_revisions, stream_persistence, stream_cooldown, stream_tamper, stream_stages, stream_backtrack, stream_active_alerts,
        stream_split, stream_evidence, stream_tamper_log, pipeline_alerts,
    ]
    return {f.__name__: f for f in own}


KEPT = """n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, tie) AS k FROM src),
 walk AS (SELECT key, k, ts, ts AS last, true AS kept FROM n WHERE k = 1
   UNION ALL SELECT n.key, n.k, n.ts, CASE WHEN n.ts >= walk.last + GAP THEN n.ts ELSE walk.last END, n.ts >= walk.last + GAP FROM walk JOIN n ON n.key = walk.key AND n.k = walk.k + 1)"""
SHOCKS = f"""f AS ({FACTORY}), s AS (SELECT event_id AS shock_id, ts, value, ts - INTERVAL 15 MINUTE AS backtrack_time FROM events WHERE value >= 200),
 h AS (SELECT shock_id, factory_id, f.ts AS source_ts, cod, tss, row_number() OVER (PARTITION BY shock_id ORDER BY cod DESC, f.ts, factory_id) AS k FROM s JOIN f ON cod IS NOT NULL
   AND f.ts BETWEEN backtrack_time - INTERVAL 120 SECOND AND backtrack_time + INTERVAL 120 SECOND),
 bt AS (SELECT s.shock_id, s.ts, s.value, backtrack_time, factory_id AS attributed_factory, source_ts, cod AS factory_cod, tss AS factory_tss FROM s LEFT JOIN h ON h.shock_id = s.shock_id AND k = 1)"""
ALERTS = f"""{GROUPS}, src AS (SELECT group_name AS key, ts, 0 AS tie, * EXCLUDE (ts) FROM b WHERE band >= 1), {KEPT.replace("GAP", "INTERVAL 6 HOUR")},
 al AS (SELECT n.key AS discharge_point_id, n.ts, eri, risk_band, band, CASE band WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' ELSE 'CRITICAL' END AS alert_level, CASE WHEN band >= 2 THEN sensitivity_factor ELSE 0.0 END AS sensitivity_factor,
   CASE WHEN band >= 2 THEN top_contributor ELSE '' END AS top_contributor, CASE WHEN band >= 2 THEN alert_message ELSE '' END AS alert_message FROM n JOIN walk USING (key, k) WHERE kept)"""


#: Scores of readings against the hour before their minute, and how the groups' SQL reads them instead of the events.
MINUTES = """rd AS (SELECT event_type AS sensor_id, date_trunc('minute', ts) AS ts, value, event_id FROM events WHERE event_id % 7 > 0),
 sd AS (SELECT rd.event_id, avg(w.value) AS mean, sqrt(greatest(0.0, avg(w.value * w.value) - avg(w.value) * avg(w.value))) + 1e-9 AS std FROM rd JOIN rd w ON w.sensor_id = rd.sensor_id AND w.ts >= rd.ts - INTERVAL 1 HOUR AND w.ts < rd.ts GROUP BY rd.event_id),
 zd AS (SELECT sensor_id AS sensor, ts, (value - mean) / std AS z FROM rd JOIN sd USING (event_id))"""
READ = "ts, value / 100 AS z, date_trunc('hour', ts) AS bucket FROM events JOIN m ON m.sensor_id = event_type"
READ_SCORES = "ts, z, date_trunc('hour', ts) AS bucket FROM zd JOIN m ON m.sensor_id = sensor"


def oracle_sql() -> dict[str, str]:
    trip = "SELECT event_id, ts, value, round(value - 100, 6) AS breach_mag, CASE WHEN value >= 200 THEN 'HIGH' ELSE 'MEDIUM' END AS alert_level FROM events WHERE value >= 150"
    return {
        "validate_valid": f"WITH {DIRTY} SELECT event_id, sensor_id, timestamp, value FROM v WHERE reason = ''",
        "validate_quarantine": f"WITH {DIRTY} SELECT event_id, sensor_id, timestamp, value, reason AS rejection_reason, true AS received FROM v WHERE reason <> ''",
        "tripwire": f"SELECT * EXCLUDE (ts) FROM ({trip})",
        "rolling_mean": f"WITH {_ends('')} SELECT max(ts) AS ts, round(avg(value), 6) AS rolling_mean FROM w GROUP BY window_end",
        "windowed_stats": f"WITH {STATS} SELECT sensor_id, window_start, window_end, round(mean, 6) AS mean, round(std, 6) AS std, min, max, sample_count FROM s",
        "stream_windowed_stats": f"WITH {STATS} SELECT sensor_id, window_start, window_end, round(mean, 6) AS mean, round(std, 6) AS std, min, max, sample_count FROM s",
        "zscore": f"WITH {SCORES} SELECT sensor_id, ts, value, event_id, round(rolling_mean, 6) AS rolling_mean, round(rolling_std, 6) AS rolling_std, round(CASE WHEN rolling_std <= 1e-6 THEN sign(round(value - rolling_mean, 6)) ELSE z_score END, 6) AS z_score, is_anomaly, round(value - rolling_mean, 6) AS deviation FROM z",
        "persistence": f"WITH {ISLANDS} SELECT sensor_id, ts, event_id, consecutive_count FROM p WHERE is_anomaly AND consecutive_count >= 2",
        "persistence_strict": f"WITH {ISLANDS} SELECT sensor_id, ts, event_id, consecutive_count FROM p WHERE is_anomaly AND consecutive_count >= 3",
        "group_anomalies": f"WITH {GROUPS} SELECT group_name, bucket, ts, n, round(composite_score, 6) AS composite_score, contributing_sensors, missing_sensors, is_group_anomaly, top_contributor, alert_message, attribution_detail FROM g",
        "attribution": f"WITH {GROUPS} SELECT group_name, bucket, CAST(row_number() OVER (PARTITION BY group_name, bucket ORDER BY fraction DESC, pos) - 1 AS INTEGER) AS place, sensor_id, round(fraction, 6) AS fraction FROM f",
        "eri": f"WITH {GROUPS} SELECT group_name AS discharge_point_id, bucket, CAST(sensitivity_factor AS DOUBLE) AS sensitivity_factor, round(eri, 6) AS eri, risk_band, unknown_sensitivity FROM b",
        "alerts": f"WITH RECURSIVE {ALERTS} SELECT discharge_point_id, ts, round(eri, 6) AS eri, risk_band, alert_level, CAST(sensitivity_factor AS DOUBLE) AS sensitivity_factor, top_contributor, alert_message FROM al",
        "cooldown": f"WITH RECURSIVE src AS (SELECT user_id AS key, ts, event_id AS tie, value FROM events WHERE value >= 100), {KEPT.replace('GAP', 'INTERVAL 1 DAY')} SELECT n.key AS user_id, n.ts, tie AS event_id, value FROM n JOIN walk USING (key, k) WHERE kept",
        "backtrack": f"WITH {SHOCKS} SELECT * FROM bt",
        "tamper_zero_variance": f"WITH {ZERO}", "tamper_dilution": f"WITH {DILUTION}", "tamper_blackout": f"WITH {DARK}",
        "tamper_all": f"""SELECT tamper_type, factory_id, window_end, cod_range, NULL::DOUBLE AS mean_cod, NULL::DOUBLE AS blackout_ratio, printf('COD locked @ %.6f mg/L  (range = %.6f)', cod_max, cod_range) AS detail FROM (WITH {ZERO})
            UNION ALL SELECT tamper_type, factory_id, window_end, NULL, mean_cod, NULL, printf('COD dropped to %.6f mg/L (baseline %.6f) | TSS %.6f', mean_cod, baseline_cod, mean_tss) FROM (WITH {DILUTION})
            UNION ALL SELECT tamper_type, factory_id, window_end, NULL, NULL, blackout_ratio, CAST(floor(blackout_ratio * 100) AS BIGINT) || '% null readings  (' || blackout_rows || ' / ' || total_rows || ' rows)' FROM (WITH {DARK})""",
        "kpis": f"""WITH RECURSIVE {ALERTS}, top AS (SELECT max(ts) AS t FROM al), te AS (SELECT max(ts) AS t FROM b)
            SELECT (SELECT count(*) FROM events) AS events_processed_total, (SELECT max(ts) FROM events) AS last_event_timestamp, (SELECT count(*) FROM b WHERE is_group_anomaly) AS anomalies_detected_total,
            (SELECT count(DISTINCT discharge_point_id) FROM al, top WHERE ts > t - INTERVAL 6 HOUR) AS active_alerts_count,
            (SELECT round(avg(eri), 6) FROM b, te WHERE ts > t - INTERVAL 5 MINUTE) AS avg_eri_last_5min,
            (SELECT CASE max(band) WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END FROM al, top WHERE ts > t - INTERVAL 6 HOUR) AS highest_risk_band""",
        "latency_percentiles": "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events",
        "latency_recent": "SELECT p50, p99, n, printf('Latency P50: %.1fms | P99: %.1fms | Alerts/min: %.1f', p50, p99, 2.0::DOUBLE) AS summary FROM (SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000))",
        "alerts_per_minute": "SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 6 HOUR) * 60.0::DOUBLE / 21600 AS per_minute FROM events WHERE value >= 100",
        "stage_unpivot": """WITH a AS (SELECT event_type || '|' || strftime(ts, '%Y-%m-%d %H:%M') AS event_id, CAST(event_id AS DOUBLE) AS t, value FROM events),
            s AS (SELECT event_id, 'ingestion' AS pipeline_stage, t, t AS stage_timestamp FROM a UNION ALL SELECT event_id, 'scoring', t, t + 0.25 FROM a UNION ALL SELECT event_id, 'gate', t, CASE WHEN value >= 50 THEN t + 0.5 END FROM a
              UNION ALL SELECT event_id, 'alert', t, CASE WHEN value >= 100 THEN t + 1.0 END FROM a)
            SELECT event_id, pipeline_stage, CAST(stage_timestamp AS DOUBLE) AS stage_timestamp, CAST(coalesce((stage_timestamp - t) * 1000, -1.0) AS DOUBLE) AS latency_ms FROM s""",
        "factory_summary": f"SELECT factory_id, round(avg(cod), 6) AS mean_cod, max(cod) AS max_cod, round(stddev_samp(cod), 6) AS std_cod FROM ({FACTORY}) WHERE cod IS NOT NULL GROUP BY factory_id",
        "factory_extremes": f"""WITH s AS (SELECT factory_id, max(cod) AS max_cod, stddev_samp(cod) AS std_cod FROM ({FACTORY}) WHERE cod IS NOT NULL GROUP BY factory_id)
            SELECT arg_max(factory_id, {{'m': max_cod, 'f': factory_id}}) AS peak_factory, max(max_cod) AS peak_cod, arg_min(factory_id, {{'m': std_cod, 'f': factory_id}}) AS steady_factory, round(min(std_cod), 6) AS steady_std, min(std_cod) < 1.0 AS tamper_hint FROM s""",
        "top_attributed": f"WITH {SHOCKS} SELECT attributed_factory, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, attributed_factory) AS INTEGER) AS place FROM bt WHERE attributed_factory IS NOT NULL GROUP BY 1",
        "recent_k": f"SELECT event_id, ts, value, alert_level FROM ({trip}) ORDER BY ts DESC, event_id DESC LIMIT 12",
        "window_slice": "SELECT event_id, ts, value, value >= 150 AS is_breach, 150.0::DOUBLE AS threshold FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR",
        "breach_count": "SELECT arg_max(value, {'t': ts, 'e': event_id}) AS current, max(value) AS most, count(*) FILTER (WHERE value >= 150) AS breaches FROM events",
        "slice_figures": "SELECT round(avg(value), 6) AS mean, max(value) AS most, count(*) FILTER (WHERE value >= 150) AS breaches, count(*) FILTER (WHERE value >= 300) AS high, count(DISTINCT event_type) AS sensors FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR",
        "alert_levels": f"SELECT alert_level, count(*) AS n FROM ({trip}) GROUP BY alert_level",
        "tamper_types": f"SELECT tamper_type, count(*) AS n FROM (SELECT tamper_type FROM (WITH {ZERO}) UNION ALL SELECT tamper_type FROM (WITH {DILUTION}) UNION ALL SELECT tamper_type FROM (WITH {DARK})) GROUP BY tamper_type",
        "reset_counts": f"WITH {SCORES}, l AS (SELECT sensor_id, is_anomaly, lag(is_anomaly) OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS before FROM z) SELECT sensor_id, count(*) FILTER (WHERE before AND NOT is_anomaly) AS resets FROM l GROUP BY sensor_id",
        "facade_detect": """WITH e AS (SELECT event_type AS sensor_id, date_trunc('minute', ts) AS ts, value, event_id FROM events),
            s AS (SELECT e.event_id, avg(w.value) AS mean, sqrt(greatest(0.0, avg(w.value * w.value) - avg(w.value) * avg(w.value))) + 1e-9 AS std FROM e JOIN e w ON w.sensor_id = e.sensor_id AND w.ts >= e.ts - INTERVAL 1 HOUR AND w.ts < e.ts GROUP BY e.event_id),
            z AS (SELECT e.*, mean, abs((value - mean) / std) > 1.0 AS hit FROM e JOIN s USING (event_id)),
            i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS island FROM z),
            c AS (SELECT *, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id, island ORDER BY ts, event_id) AS BIGINT) AS consecutive_count FROM i)
            SELECT sensor_id, ts, value, event_id, consecutive_count, round(mean, 6) AS rolling_mean FROM c WHERE hit""",
        "stream_clean_factories": "SELECT event_id AS s_no, strftime(ts, '%Y-%m-%d %H:%M') AS time, CAST(user_id AS VARCHAR) AS factory_id, value AS cod, CAST(length(props) AS DOUBLE) AS tss, 'NORMAL' AS status FROM events WHERE event_id % 7 > 0",
        "factory_full_load": "SELECT CAST(user_id AS VARCHAR) AS factory_id, date_trunc('minute', ts) AS ts, CASE WHEN event_id % 7 > 0 AND event_id % 11 > 0 THEN value END AS cod, CAST(length(props) AS DOUBLE) AS tss FROM events",
        "dashboard_load": "SELECT event_id AS s_no, date_trunc('minute', ts) AS ts, value AS cetp_inlet_cod, 1.5::DOUBLE AS cetp_outlet_ph FROM events WHERE event_id % 7 > 0 AND event_id % 11 > 0 AND event_id % 13 > 0",
        "tamper_log": f"SELECT * REPLACE (CAST(factory_id AS VARCHAR) AS factory_id, strftime(window_end, '%Y-%m-%d %H:%M') AS window_end), true AS logged FROM (SELECT * FROM (WITH {ZERO}) UNION ALL BY NAME SELECT * FROM (WITH {DILUTION}) UNION ALL BY NAME SELECT * FROM (WITH {DARK}))",
        "stream_split": f"WITH {DIRTY} SELECT event_id, reason FROM v",
        "stream_evidence": f"WITH {SHOCKS} SELECT strftime(ts, '%Y-%m-%d %H:%M') AS cetp_event_time, value AS cetp_cod, round(value - 100, 6) AS breach_mag, 'HIGH' AS alert_level, strftime(backtrack_time, '%Y-%m-%d %H:%M') AS backtrack_time, CAST(attributed_factory AS VARCHAR) AS attributed_factory, factory_cod, factory_tss FROM bt",
        "stream_tamper_log": f"SELECT * REPLACE (CAST(factory_id AS VARCHAR) AS factory_id, strftime(window_end, '%Y-%m-%d %H:%M') AS window_end) FROM (SELECT * FROM (WITH {ZERO}) UNION ALL BY NAME SELECT * FROM (WITH {DILUTION}) UNION ALL BY NAME SELECT * FROM (WITH {DARK}))",
        "pipeline_alerts": f"WITH RECURSIVE {MINUTES}, {ALERTS.replace(READ, READ_SCORES)} SELECT discharge_point_id, ts, round(log10(eri), 6) AS log_eri, risk_band, alert_level, CAST(sensitivity_factor AS DOUBLE) AS sensitivity_factor, top_contributor, alert_message FROM al",
        "stream_persistence": f"WITH {ISLANDS} SELECT sensor_id, ts, event_id, consecutive_count FROM p WHERE is_anomaly AND consecutive_count >= 2",
        "stream_cooldown": f"WITH RECURSIVE src AS (SELECT user_id AS key, ts, event_id AS tie, value FROM events WHERE value >= 100), {KEPT.replace('GAP', 'INTERVAL 1 DAY')} SELECT n.key AS user_id, n.ts, tie AS event_id, value FROM n JOIN walk USING (key, k) WHERE kept",
        "stream_tamper": f"SELECT * FROM (WITH {ZERO}) UNION ALL BY NAME SELECT * FROM (WITH {DILUTION}) UNION ALL BY NAME SELECT * FROM (WITH {DARK})",
        "stream_backtrack": f"WITH {SHOCKS} SELECT * FROM bt",
        "stream_late_revisions": f"""WITH b AS (SELECT *, CASE WHEN event_id % 50 = 7 THEN 4 ELSE least(greatest(CAST(floor(epoch(ts) / {BLOCK * DAY}) AS BIGINT) - {int(19723 / BLOCK)}, 0), 2) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END END AS file FROM events),
            t AS (SELECT k AS file, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {LATE} FROM b WHERE file < k - 1) AS mark FROM generate_series(0, 4) AS g(k)),
            w AS (SELECT event_type AS sensor_id, date_trunc('hour', ts) + to_hours(k) AS window_end, value FROM b JOIN t USING (file), generate_series(1, 6) AS g(k) WHERE mark IS NULL OR date_trunc('hour', ts) + to_hours(k) > mark)
            SELECT sensor_id, window_end - INTERVAL 6 HOUR AS window_start, window_end, round(avg(value), 6) AS mean, round(sqrt(greatest(0.0, avg(value * value) - avg(value) * avg(value))) + 1e-9, 6) AS std, min(value) AS min, max(value) AS max, count(*) AS sample_count FROM w GROUP BY sensor_id, window_end""",
        "stream_stages": f"""WITH s AS ({" UNION ALL ".join(f"SELECT event_id, '{n}' AS pipeline_stage, epoch_us(ts) / 1e6 AS t, CASE WHEN value >= {least} THEN epoch_us(ts + to_milliseconds({ms})) / 1e6 END AS stage_timestamp FROM events" for n, (ms, least) in STAGES.items())})
            SELECT event_id, pipeline_stage, stage_timestamp, round(coalesce((stage_timestamp - t) * 1000, -1.0), 6) AS latency_ms FROM s""",
        "stream_active_alerts": f"""WITH RECURSIVE {ALERTS}, w AS (SELECT discharge_point_id, band, date_trunc('hour', ts) + to_hours(k) AS window_end FROM al, generate_series(1, 6) AS g(k))
            SELECT window_end - INTERVAL 6 HOUR AS window_start, window_end, count(DISTINCT discharge_point_id) AS active_alerts_count, CASE max(band) WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS highest_risk_band FROM w GROUP BY window_end""",
        "distinct_sensors": "SELECT DISTINCT event_type AS sensor_id FROM events",
        "csv_roundtrip": "SELECT event_id AS s_no, strftime(ts, '%Y-%m-%d %H:%M') AS time, CAST(user_id AS VARCHAR) AS factory_id, CASE WHEN event_id % 7 > 0 THEN value END AS cod, 7.2::DOUBLE AS ph, CASE WHEN event_id % 7 > 0 THEN 'NORMAL' ELSE 'BLACKOUT' END AS status FROM events",
        "jsonl_scan": f"WITH {SHOCKS} SELECT shock_id, value, attributed_factory, factory_cod FROM bt",
    }
