import datetime as dt
import random

import pytest

from brinelog.functions import scalars as S
from brinelog.operators import detect, report

T0 = dt.datetime(1969, 12, 31, 23, 0)


@pytest.mark.parametrize(("duration", "hop"), [("30 seconds", "5 seconds"), ("7 minutes", "3 minutes"), ("1 hour", "1 hour"), ("90 seconds", "60 seconds")])
def test_windows_put_together_from_panes(spark, duration, hop):
    rng = random.Random(3)
    d, h = S.interval_micros(duration) // 1_000_000, S.interval_micros(hop) // 1_000_000
    rows = [(rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randint(0, 7200)), rng.choice([None, *range(5)])) for _ in range(300)]
    df = spark.createDataFrame([(s, t, None if v is None else float(v)) for s, t, v in rows], "sensor_id string, ts timestamp_ntz, value double")
    want = {}
    for s, t, v in rows:
        sec = int((t - dt.datetime(1970, 1, 1)).total_seconds())
        k = sec // h * h
        while k > sec - d:
            want.setdefault((s, k), []).append(v)
            k -= h
    got = {(r["sensor_id"], int((r["window_start"] - dt.datetime(1970, 1, 1)).total_seconds())): r for r in detect.sliding_stats(df, duration, hop).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        known = [v for v in values if v is not None]
        r = got[key]
        assert r["sample_count"] == len(known) and r["min"] == min(known, default=None) and r["max"] == max(known, default=None)
        assert (r["window_end"] - r["window_start"]).total_seconds() == d
        if known:
            mean = sum(known) / len(known)
            assert r["mean"] == pytest.approx(mean)
            assert r["std"] == pytest.approx((sum((x - mean) ** 2 for x in known) / len(known)) ** 0.5, abs=1e-6)
    means = detect.rolling_mean(df, duration, hop).count()
    assert means == len({k for _, k in want})


def test_no_raw_row_is_copied(spark):
    """Rows are aggregated by pane before anything is made several times."""
    df = spark.createDataFrame([("a", T0, 1.0)], "sensor_id string, ts timestamp_ntz, value double")
    plan = detect.sliding_stats(df, "6 hours", "1 hour")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.index("Generate") < plan.rindex("Aggregate")


def test_durations():
    assert S.interval_micros("1 minute 30 seconds") == 90_000_000 and S.interval_micros("2days") == 172_800_000_000
    for odd in ("", "minute", "1 fortnight", "-1 hour", "1 hour x"):
        with pytest.raises(ValueError):
            S.interval_micros(odd)
    with pytest.raises(ValueError):
        detect._panes("1 hour", "2 hours")


@pytest.mark.parametrize("few", [8, 40, 100_000])
def test_percentiles_by_narrowing(spark, few):
    rng = random.Random(few)
    values = [rng.choice([0.0, 1.5, rng.uniform(-50, 50), 1e300, -1e-300]) for _ in range(4000)] + [7.25] * 2000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    ordered = sorted(values)
    n, got = report.percentiles(df, "x", [0.0, 0.001, 0.25, 0.5, 0.6, 0.99, 1.0], few)
    assert n == len(values)
    for p, g in zip([0.0, 0.001, 0.25, 0.5, 0.6, 0.99, 1.0], got, strict=True):
        k, f = divmod(p * (n - 1), 1)
        assert g == pytest.approx(ordered[int(k)] + (f * (ordered[int(k) + 1] - ordered[int(k)]) if f else 0))
    assert report.percentiles(df.where("x is null"), "x", [0.5]) == (0, [0.0])
    assert report.percentiles(spark.createDataFrame([(42.0,)], "x double"), "x", [0.99]) == (1, [42.0])


def test_percentiles_between_many_equal_values(spark):
    """The sketch's ends are the two frequent values at every cut; what lies between is still told apart."""
    values = [0.0] * 5000 + [1 + i / 100 for i in range(40)] + [9.0] * 5000
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    at = report.at_ranks(df, "x", [0, 4999, 5000, 5020, 5039, 5040, 10_039], len(values), few=8)
    assert len(at) == 7 and at == {r: sorted(values)[r] for r in at}


def test_places(spark):
    rows = [(v,) for v, n in (("a", 3), ("b", 5), ("c", 3), ("d", 1)) for _ in range(n)] + [(None,)]
    got = report.counted(spark.createDataFrame(rows, "v string"), "v").collect()
    assert sorted((r["place"], r["v"], r["n"]) for r in got) == [(1, "b", 5), (2, "a", 3), (3, "c", 3), (4, "d", 1)]


def test_scalars(spark):
    df = spark.createDataFrame([(2e9, "2026-02-28 12:07"), (15.0, "soon"), (1e-4, None), (12345678.25, "2026-02-28 12:59")], "x double, t string")
    got = [tuple(r) for r in df.select(S.plain_number(df.x), S.text_bucket(df.t, "yyyy-MM-dd HH:mm", 600_000)).collect()]
    assert got == [("2000000000.0", "2026-02-28 12:00"), ("15.0", "soon"), ("0.0001", None), ("12345678.25", "2026-02-28 12:50")]
    assert df.select(S.bound_text(S.at_micros(S.micros(S.parsed(df.t, "yyyy-MM-dd HH:mm"))))).first()[0] == "2026-02-28 12:07"
