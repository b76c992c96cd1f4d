import datetime as dt
import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from brinelog import facade, run
from brinelog.config import Config
from brinelog.operators import risk
from brinelog.sources import files, schemas
from brinelog.streaming import jobs
from brinelog.streaming.reporter import Reporter, observed

T0 = dt.datetime(2026, 2, 1, 12, 0)
HEAD = "s_no,time,factory_id,cod,bod,ph,tss\n"


def readings(first, n, seed):
    """Rows of four factories, a minute apart, with blackouts, shocks and two rejects."""
    rng = random.Random(seed)
    rows = []
    for m in range(first, first + n):
        for f in "ABCD":
            cod = "" if rng.random() < 0.1 else f"{rng.gauss(120, 3) if rng.random() < 0.9 else 450:.2f}"
            rows.append(f"{m},{T0 + dt.timedelta(minutes=m):%Y-%m-%d %H:%M},FACTORY_{f},{cod},45.0,7.2,80.0\n")
    rows.append(f"{first},{T0:%Y-%m-%d %H:%M},,100,45,7.2,80\n")
    rows.append(f"{first},soon,FACTORY_A,100,45,7.2,80\n")
    return rows


@pytest.fixture
def places(tmp_path):
    (tmp_path / "factories").mkdir()
    (tmp_path / "plant").mkdir()
    lines = "".join(f"{m},{T0 + dt.timedelta(minutes=m):%Y-%m-%d %H:%M},{250.0 if m % 10 == 5 else 150.0}" + ",1" * 7 + "\n" for m in range(60))
    (tmp_path / "plant" / "cetp_clean.csv").write_text("s_no,time,cetp_inlet_cod,a,b,c,d,e,f,g\n" + lines)
    return tmp_path


@pytest.fixture
def cfg(places):
    return replace(Config(), alert_log_path=str(places / "evidence"), tamper_log_path=str(places / "tamper"), metrics_output_path=str(places / "kpis.json"), window_duration_ms=600_000, window_hop_ms=60_000, group_threshold=1.0, eri_threshold_low=1.0, alert_cooldown_seconds=180)


def test_pipeline_is_resumed_without_losing_or_doubling(spark, places, cfg):
    """Readings come in three lots; after the first, the alerts' second batch fails, and the next runs take up from there."""
    out, src = str(places / "out"), places / "factories"
    (src / "factory_1.csv").write_text(HEAD + "".join(readings(0, 20, 1)))
    run.run_pipeline(spark, str(places / "plant"), str(src), out, cfg)
    first = {tuple(r) for r in run.stored(spark, f"{out}/alerts", run.ALERT).collect()}
    (src / "factory_2.csv").write_text(HEAD + "".join(readings(20, 20, 2)))
    plain, run.put = run.put, lambda df, path, batch: (_ for _ in ()).throw(RuntimeError("cut off")) if path.endswith("alerts") else plain(df, path, batch)
    try:
        with pytest.raises(Exception, match="cut off"):
            run.run_pipeline(spark, str(places / "plant"), str(src), out, cfg)
    finally:
        run.put = plain
    (src / "factory_3.csv").write_text(HEAD + "".join(readings(40, 20, 3)))
    run.run_pipeline(spark, str(places / "plant"), str(src), out, cfg)
    run.run_pipeline(spark, str(places / "plant"), str(src), out, cfg)  # nothing new

    good = spark.read.schema(run.VALID).parquet(f"{out}/valid")
    assert good.count() == 240 and good.distinct().count() == 240
    bad = spark.read.json(f"{out}/quarantine")
    assert sorted(r["rejection_reason"] for r in bad.collect()) == ["invalid 'timestamp' format: 'soon'"] * 3 + ["missing 'sensor_id'"] * 3
    # the same work in one go
    whole = facade.score(facade.readings(good.where("cod IS NOT NULL"), cfg), cfg)
    scored = run.stored(spark, f"{out}/scores", run.SCORED)
    shown = lambda df: sorted(tuple(r) for r in df.select("sensor_id", "ts", "value", F.round("z_score", 6)).collect())
    assert shown(scored) == shown(whole) and scored.count() > 150
    index = risk.risk_index(risk.group_anomalies(whole, cfg), cfg)
    alerts = lambda df: sorted(tuple(r) for r in df.select("discharge_point_id", "ts", F.round("eri", 6), "risk_band", "alert_message").collect())
    told = run.stored(spark, f"{out}/alerts", run.ALERT)
    assert alerts(told) == alerts(risk.alerts(index, cfg)) and told.count() > 3
    assert first <= {tuple(r) for r in told.collect()}
    kpis = json.loads((places / "kpis.json").read_text())
    assert kpis["events_processed_total"] == 240 and kpis["pipeline_uptime_seconds"] > 0
    evidence = files.jsonl(spark, cfg.alert_log_path, schemas.EVIDENCE)
    assert evidence.count() == 6 and {r["backtrack_time"] for r in evidence.collect()} == {f"{T0 + dt.timedelta(minutes=m - 15):%Y-%m-%d %H:%M}" for m in range(5, 60, 10)}


def test_anticheat_in_one_go_and_watched(spark, places, cfg):
    """The detectors over a folder, and over the same rows as a stream of shuffled files that is stopped between batches."""
    rng, src = random.Random(4), places / "factories"
    rows = []
    for m in range(240):
        rows.append((m, "FROZEN", "115.00", "80"))
        rows.append((m, "DARK", "" if 60 <= m < 120 else f"{rng.gauss(120, 3):.2f}", "80"))
        rows.append((m, "THIN", f"{rng.gauss(120 if m < 180 else 12, 1):.2f}", "80"))
    line = lambda r: f"{r[0]},{T0 + dt.timedelta(minutes=r[0]):%Y-%m-%d %H:%M},{r[1]},{r[2]},45,7.2,{r[3]}\n"
    cfg = replace(cfg, watermark="100 minutes")
    lots = [[r for r in rows if min((r[0] + (30 if rng.random() < 0.3 else 0)) // 80, 2) == k] for k in range(3)]
    for k, lot in enumerate(lots[:2]):
        rng.shuffle(lot)
        (src / f"factory_{k}.csv").write_text(HEAD + "".join(map(line, lot)))
        run.watch_anticheat(spark, str(src), str(places / "out"), cfg)
    lots[2].append((2000, "LATER", "1", "1"))  # lets time pass
    (src / "factory_2.csv").write_text(HEAD + "".join(map(line, lots[2])))
    run.watch_anticheat(spark, str(src), str(places / "out"), cfg, files_a_batch=1)
    seen = files.tamper_log(spark, cfg.tamper_log_path)
    watched = sorted(map(str, seen.drop("logged_at").where("factory_id <> 'LATER'").collect()))
    cfg = replace(cfg, tamper_log_path=str(places / "all"))
    whole = run.run_anticheat(spark, str(src), cfg).drop("logged_at").where("factory_id <> 'LATER'").collect()
    assert watched == sorted(map(str, whole))
    assert {r["tamper_type"] for r in whole} == {"ZERO_VARIANCE", "DILUTION_TAMPER", "BLACKOUT_TAMPER"}
    assert run.run_anticheat(spark, str(src), cfg).where("factory_id <> 'LATER'").count() == len(whole)  # written over


def test_missing_folder(spark, tmp_path, cfg):
    with pytest.raises(FileNotFoundError):
        run.run_pipeline(spark, str(tmp_path / "none"), str(tmp_path / "none"), str(tmp_path / "out"), cfg)
    with pytest.raises(ValueError, match="missing columns: cod, time"):
        facade.detect(spark.createDataFrame([("a",)], "factory_id string"), cfg)


def test_reporter(spark, tmp_path):
    """Told by streams over several micro-batches; gated by the interval, silent without rows."""
    now, lines = [0.0], []
    reporter = Reporter(30.0, 60.0, lines.append, lambda: now[0])
    assert not reporter.maybe_report() and lines == []
    df = spark.range(300).select(F.col("id").cast("double").alias("latency_ms"))
    for k in range(3):
        df.where(F.col("latency_ms") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.streams.addListener(reporter)
    try:
        out, late = jobs.drained(observed(jobs.source(spark, df.schema, str(tmp_path / "in"), 1)), str(tmp_path / "run"))
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        assert out.count() == 300 and late == 0
    finally:
        spark.streams.removeListener(reporter)
    assert lines == [] and reporter.fresh == 300 and reporter.per_minute() == 300.0
    now[0] = 31.0
    assert reporter.maybe_report() and not reporter.maybe_report()
    assert lines[0].startswith("Latency P50: 14") and lines[0].endswith("Alerts/min: 300.0") and reporter.uptime() == 31.0
    now[0] = 90.0
    assert reporter.per_minute() == 0.0 and not reporter.maybe_report()


def test_state_of_idle_keys_is_given_up(spark, tmp_path):
    """A run of two goes on after a short pause, and starts anew after a pause longer than the time to live."""
    rows = [("a", T0, 1, True), ("a", T0 + dt.timedelta(minutes=1), 2, True), ("b", T0, 3, True)]
    later = [("b", T0 + dt.timedelta(minutes=30), 4, True), ("c", T0 + dt.timedelta(hours=5), 5, True)]
    last = [("a", T0 + dt.timedelta(hours=6), 6, True), ("z", T0 + dt.timedelta(days=9), 7, True)]
    kind = "sensor_id string, ts timestamp_ntz, event_id long, is_anomaly boolean"
    for lot in (rows, later, last):
        spark.createDataFrame(lot, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    build = lambda s: jobs.persisted(s, 1, "1 minute", idle_s=3600)
    got = jobs.replayed(spark, df.schema, str(tmp_path / "in"), build, str(tmp_path / "run"), files_a_batch=1)
    assert {(r["event_id"], r["consecutive_count"]) for r in got.collect()} == {(1, 1), (2, 2), (3, 1), (4, 2), (5, 1), (6, 1)}


def test_refused_rows_are_counted(spark, tmp_path):
    rows = [[("a", T0, 1.0)], [("a", T0 + dt.timedelta(hours=9), 2.0)], [("a", T0 + dt.timedelta(hours=9), 2.5)], [("a", T0, 9.0), ("a", T0 + dt.timedelta(hours=9), 3.0)]]
    for lot in rows:
        spark.createDataFrame(lot, "sensor_id string, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    out, late = jobs.drained(jobs.sliding_stats(jobs.source(spark, df.schema, str(tmp_path / "in"), 1), "1 hour", "1 hour", "1 hour"), str(tmp_path / "run"), "update")
    got = {r["window_end"]: (r["sample_count"], r["max"]) for r in out.transform(jobs.last_of_each("sensor_id", "window_end")).collect()}
    assert late == 1 and got == {T0 + dt.timedelta(hours=1): (1, 1.0), T0 + dt.timedelta(hours=10): (3, 3.0)}


