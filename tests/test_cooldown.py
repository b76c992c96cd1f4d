import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brinelog.operators import cooldown

T0 = dt.datetime(1969, 12, 31, 23, 50)  # chunks before and after 1970


def greedy(rows, gap):
    """Of (key, seconds or None, id), the ids kept."""
    kept, last = set(), {}
    for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            kept.add(i)
    return kept | {i for _, t, i in rows if t is None}


@pytest.mark.parametrize("cooldowns", [1, 2, 5])
@pytest.mark.parametrize("seed", range(2))
def test_chunks_keep_what_a_loop_keeps(spark, seed, cooldowns):
    """Dense stretches, gaps longer than chunks, ties, rows without key or time, and columns named as the operator's own."""
    rng = random.Random(seed)
    rows, n = [], 0
    for key, spread in (("a", 400), ("b", 4000), (None, 900), ("c", 30)):
        t = 0
        for _ in range(150):
            t += rng.choice([0, 1, 1, 2, 7, 10, 10, 25]) if rng.random() < 0.97 else rng.randint(0, spread)
            rows.append((key, t, n))
            n += 1
    rows += [("a", None, n), (None, None, n + 1), ("d", 5, n + 2)]
    df = spark.createDataFrame([(k, None if t is None else T0 + dt.timedelta(seconds=t), i, -1, -2) for k, t, i in rows], "k string, ts timestamp_ntz, event_id long, _time long, _chunk long").repartition(6)
    out = cooldown.cooled(df, "k", 10, tie="event_id", hot_rows=0, cooldowns=cooldowns)
    assert out.columns == df.columns
    got = out.collect()
    assert {r["event_id"] for r in got} == greedy(rows, 10) and len(got) == len(greedy(rows, 10))
    assert {(r["_time"], r["_chunk"]) for r in got} == {(-1, -2)}


def test_a_hot_key_is_spread(spark):
    """A million rows of one key beside small ones: the chunks' walks are shared by many tasks, and give the single walk's rows."""
    ts = F.timestamp_seconds(F.col("id") * 7 % 1_000_003 + F.lit(1_700_000_000)).cast("timestamp_ntz").alias("ts")
    df = spark.range(1_000_000).select(F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), F.col("id") % 1000)).otherwise("hot").alias("k"), ts, F.col("id").alias("event_id"))
    whole = cooldown.cooled(df, "k", 600, tie="event_id", hot_rows=10**9)
    parts = cooldown.cooled(df, "k", 600, tie="event_id", hot_rows=100_000)
    figures = [F.count(F.lit(1)), F.sum("event_id"), F.sum(F.hash("k", "event_id").cast("long"))]
    assert parts.agg(*figures).first() == whole.agg(*figures).first()
    tasks = parts.withColumn("p", F.spark_partition_id()).where("k = 'hot'").groupBy("p").count().collect()
    assert len(tasks) > 1


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, ts timestamp_ntz, event_id long")
    assert cooldown.cooled(df, "k", 10).count() == 0
    assert cooldown.cooled(df, "k", 0).count() == 0
