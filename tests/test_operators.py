import datetime as dt
import fnmatch
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from brinelog.config import Config
from brinelog.functions import scalars as S
from brinelog.operators import detect, forensics, report, risk
from brinelog.sources import files, schemas
from brinelog.streaming import jobs

T0 = dt.datetime(2026, 2, 1, 12, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize(("field", "value"), [("window_hop_ms", 0), ("zscore_threshold", 0.0), ("epsilon", 1e-3), ("persistence_count", 0), ("alert_min_risk_band", "ODD"), ("cod_threshold", 1.0), ("eri_threshold_low", 6.0), ("sensor_groups", {}), ("river_sensitivity", {"a": 9}), ("sensor_value_range", {"*": [2, 1]})])
def test_config_rejects(field, value):
    with pytest.raises(ValueError, match=field):
        replace(Config(), **{field: value}).checked()
    assert Config.from_env({"PERSISTENCE_COUNT": "5", "ALERT_MIN_RISK_BAND": "high"}).checked().persistence_count == 5


def test_config_environment():
    cfg = Config.from_env({"CETP_DATA_DIR": "/a", "FACTORY_DATA_DIR": "/b", "INPUT_TIME_FORMAT": "%Y-%m-%dT%H:%M"})
    assert (cfg.cetp_dir, cfg.factory_dir, cfg.input_time_format) == ("/a", "/b", "yyyy-MM-dd'T'HH:mm")


def test_glob():
    for pattern in ("*ph*", "a?c", "[ab]*", "[!ab]*", "x.y", "*"):
        for s in ("FACTORY_PH_1", "my_ph_2", "abc", "bcd", "x.y", "xzy"):
            assert bool(re.match(S.glob_regex(pattern), s)) == fnmatch.fnmatchcase(s, pattern)


def test_validation(spark):
    rows = [(None, "2026-02-28 12:00", 1.0, "missing 'sensor_id'"), ("a", None, 1.0, "missing 'timestamp'"), ("a", "1", None, "missing 'value'"), (" ", "1", 1.0, "invalid 'sensor_id type/content: str"),
            ("x" * 65, "1", 1.0, "sensor_id exceeds max length (65 > 64)"), ("a", "1", float("nan"), "value must be finite (got nan)"), ("a", "bad", 1.0, "invalid 'timestamp' format: 'bad'"),
            ("my_ph", "2026-02-28T12:00:00Z", 15.0, "value 15.0 out of range [0.0, 14.0] for pattern '*ph*'"), ("FACTORY_PH_1", "1740743600", 15.0, ""), ("my_ph", "2026-02-28 12:00", 14.0, "")]
    df = spark.createDataFrame(rows, "s string, t string, v double, want string")
    for r in df.withColumn("got", S.rejection(F.col("s"), F.col("t"), F.col("v"), Config())).collect():
        assert r["got"] == r["want"]


def test_bands_and_tripwire(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 2.0, 3.5, 5.0, 7.5, 10.0, 99.9, float("nan"))], "e double")
    assert [r[0] for r in df.select(S.risk_band(F.col("e"), Config())).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL", "CRITICAL"]
    t = spark.createDataFrame([(199.9,), (200.0,), (386.0,), (float("nan"),), (None,)], "cod_value double")
    assert [(r[0], r[2]) for r in detect.tripwire(t, Config()).collect()] == [(200.0, "MEDIUM"), (386.0, "HIGH")]


def _runs(hits):
    n, out = 0, []
    for h in hits:
        n = n + 1 if h else 0
        out.append(n)
    return out


@pytest.mark.parametrize("chunk_s", [300, 3600, 10**9])
@pytest.mark.parametrize("share", [0.6, 0.95])
def test_persistence_against_a_loop(spark, chunk_s, share):
    rnd = random.Random(3)
    rows = [(s, at(i), i, rnd.random() < share) for s in ("a", "b", None) for i in sorted(rnd.sample(range(300), 60))]
    df = spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, event_id long, is_anomaly boolean")
    got = {(r["sensor_id"], r["event_id"]): r["consecutive_count"] for r in detect.persisted(df, 2, "event_id", chunk_s).collect()}
    want = {}
    for s in ("a", "b", None):
        mine = [r for r in rows if r[0] == s]
        want |= {(s, r[2]): n for r, n in zip(mine, _runs([r[3] for r in mine]), strict=True) if n >= 2}
    assert got == want


def test_streams_carry_state_over_batches(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(rnd.choice("ab"), at(i), i, rnd.random() < 0.8) for i in range(90)]
    df = spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, event_id long, is_anomaly boolean")
    for k in range(3):
        df.where(F.col("event_id").between(30 * k, 30 * k + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("", at(10_000), -1, False)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # lets time pass
    runs = jobs.replayed(spark, df.schema, str(tmp_path / "in"), lambda s: jobs.persisted(s, 2), str(tmp_path / "p"), files_a_batch=1)
    same = detect.persisted(df, 2, "event_id")
    assert {(r["event_id"], r["consecutive_count"]) for r in runs.collect()} == {(r["event_id"], r["consecutive_count"]) for r in same.collect()}
    kept = jobs.replayed(spark, df.schema, str(tmp_path / "in"), lambda s: jobs.cooled(s, "sensor_id", 600), str(tmp_path / "c"), files_a_batch=1)
    assert kept.select("_batch").distinct().count() >= 3
    assert {r["event_id"] for r in kept.collect()} == {r["event_id"] for r in risk.cooled(df, "sensor_id", 600, tie="event_id").collect()}


def test_cooldown_of_one_busy_key(spark):
    ts = F.timestamp_seconds(F.col("id") + F.lit(1_700_000_000)).cast("timestamp_ntz").alias("ts")
    df = spark.range(1_000_000).select(F.lit(None).cast("string").alias("k"), ts, F.col("id").alias("event_id"))
    got = risk.cooled(df, "k", 600, tie="event_id").agg(F.count("*"), F.sum(F.col("event_id") % 600)).first()
    assert tuple(got) == (1667, 0)


def test_cooldown_against_a_loop_and_stream(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), at(m), m) for m in sorted(rnd.sample(range(600), 200))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, event_id long")
    want, last = set(), {}
    for k, t, i in rows:
        if k not in last or (t - last[k]).total_seconds() >= 600:
            last[k] = t
            want.add(i)
    assert {r["event_id"] for r in risk.cooled(df, "k", 600).collect()} == want
    assert risk.cooled(df, "k", 0).count() == len(rows)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("", at(10_000), -1)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # lets time pass
    out = jobs.replayed(spark, df.schema, str(tmp_path / "in"), lambda s: jobs.cooled(s, "k", 600), str(tmp_path / "s"))
    assert {r["event_id"] for r in out.collect()} == want


def test_group_scores(spark):
    cfg = replace(Config(), sensor_groups={"g": ["cod", "ph", "flow"]}, sync_tolerance_ms=60_000)
    df = spark.createDataFrame([("cod", at(0), 3.0), ("ph", at(0), -3.0), ("other", at(0), 9.0)], "sensor_id string, ts timestamp_ntz, z_score double")
    r = risk.group_anomalies(df, cfg).first()
    assert (r["composite_score"], r["missing_sensors"], r["contributing_sensors"], r["is_group_anomaly"], r["top_contributor"]) == (3.0, "flow", "cod,ph", True, "cod")
    assert r["alert_message"] == "Anomaly in g: primary driver cod (50% of score)"
    e = risk.risk_index(risk.group_anomalies(df, cfg), cfg).first()
    assert (e["eri"], e["unknown_sensitivity"]) == (6.0, True)


def test_backtrack_takes_the_highest_in_an_inclusive_band(spark):
    shocks = spark.createDataFrame([(1, at(60)), (2, at(600))], "shock_id long, ts timestamp_ntz")
    src = spark.createDataFrame([("a", at(43), 5.0), ("b", at(47), 9.0), ("c", at(45), 7.0), ("d", at(48), 99.0), ("e", at(47), 9.0)], "factory_id string, ts timestamp_ntz, cod double")
    got = {r["shock_id"]: r["attributed_factory"] for r in forensics.backtracked(shocks, src, 900, 120).collect()}
    assert got == {1: "b", 2: None}


@pytest.mark.parametrize(("travel", "tolerance"), [(900, 120), (60, 60), (0, 0), (30, 1)])
def test_backtrack_against_a_loop(spark, travel, tolerance):
    """Shocks that share an id, equal times and readings, NaN, rows without a factory or a reading, times before 1970."""
    rng = random.Random(travel)
    t0 = dt.datetime(1969, 12, 31, 23, 40)
    when = lambda: t0 + dt.timedelta(seconds=rng.randrange(0, 2400, 5), microseconds=rng.choice([0, 0, 1, 999_999]))
    src = [(rng.choice(["a", "b", "c", None]), when(), rng.choice([None, 1.0, 5.0, 5.0, 9.0, float("nan") if rng.random() < 0.1 else 2.0]), float(i)) for i in range(200)]
    shocks = [(i, when()) for i in range(100)] + [(7, when()), (200, None)]
    df = spark.createDataFrame(shocks, "shock_id long, ts timestamp_ntz")
    got = forensics.backtracked(df, spark.createDataFrame(src, "factory_id string, ts timestamp_ntz, cod double, tss double"), travel, tolerance)
    best = {}
    for i, t in shocks:
        for f, s, cod, _ in src:
            if t is not None and cod is not None and abs(t - dt.timedelta(seconds=travel) - s) <= dt.timedelta(seconds=tolerance):
                best.setdefault(i, []).append((cod == cod, -cod if cod == cod else 0.0, s, f is None, f))
    shown = lambda f, s, cod: repr((f, s, cod))
    want = [(i, shown(b[4], b[2], (-b[1] if b[0] else float("nan")))) if (b := min(best.get(i, []), default=None, key=lambda x: x[:4] + (x[4] or "",))) else (i, shown(None, None, None)) for i, _ in shocks]
    assert sorted((r["shock_id"], shown(r["attributed_factory"], r["source_ts"], r["factory_cod"])) for r in got.collect()) == sorted(want)


def test_backtrack_pairs_no_rows(spark):
    """What is shuffled grows with shocks and sources, not with their pairs: 2,000 shocks and 2,000 sources of the same minute."""
    ts = F.timestamp_seconds(F.col("id") * 0.03).cast("timestamp_ntz").alias("ts")
    shocks = spark.range(2000).select(F.col("id").alias("shock_id"), ts)
    src = spark.range(2000).select(F.col("id").alias("factory_id"), ts, F.col("id").cast("double").alias("cod"))
    out = forensics.backtracked(shocks, src, 0, 120)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Join LeftOuter, (shock_id" in plan
    assert out.where("attributed_factory = 1999").count() == 2000


def test_tampering(spark):
    rows = [("f", at(m), 115.0 if m < 5 else None, 80.0) for m in range(15)] + [("g", at(m + 3), 100.0 if m < 60 else 10.0, 50.0) for m in range(120)]
    df = spark.createDataFrame(rows, "factory_id string, ts timestamp_ntz, cod double, tss double")
    assert {(r["factory_id"], r["row_count"]) for r in forensics.zero_variance(df.where("factory_id = 'f'"), 300).collect()} == {("f", 5)}
    assert forensics.dilution(df, 3600, 0.8, 0.2).first()["window_end"] == at(122)
    assert forensics.blackout(df, 600).where("factory_id = 'f'").count() == 0
    assert forensics.blackout(df, 300).where("factory_id = 'f'").count() == 2


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(1, 101)], "latency_ms double, ts long")
    assert report.latency(df).first()[1] == pytest.approx(99.01)
    assert report.latency(df.where("false")).first()[0] == 0.0


def test_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.plant_readings(spark, str(tmp_path / "none")).count()
    (tmp_path / "factory_1.csv").write_text("s_no,time,factory_id,cod,bod,ph,tss\n1,2026-02-28 12:00,A,100,50,7,20\n2,2026-02-28 12:01,A,,50,7,20\n")
    assert [r["status"] for r in files.factory_readings(spark, str(tmp_path)).orderBy("s_no").collect()] == ["NORMAL", "BLACKOUT"]
    assert files.factory_index(spark, str(tmp_path), "yyyy-MM-dd HH:mm").count() == 1
    (tmp_path / "raw.csv").write_text("S. No,Time,CETP_INLET-COD - (mg/l) Raw,odd\n1,2026-02-28 12:00,NA,3\n")
    assert [tuple(r) for r in files.preprocessed(spark, str(tmp_path / "raw.csv")).collect()] == [("1", "2026-02-28 12:00", None)]
    assert files.jsonl(spark, str(tmp_path / "gone"), schemas.EVIDENCE).count() == 0
    files.write_kpis(spark.createDataFrame([(4, "HIGH")], "a long, b string"), str(tmp_path / "k.json"))
    assert (tmp_path / "k.json").read_text() == '{"a": 4, "b": "HIGH"}'
