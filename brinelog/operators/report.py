"""KPIs, latency figures and dashboard aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S


#: Rows, or different values, of which a stretch of ranks is small enough to be looked at on the driver; how finely a stretch is cut at a time.
FEW, FINE = 100_000, 1000


def _sketch_reach(rank: int, n: int) -> tuple[float, float]:
    """Shares of n rows that surely lie around a rank, as approx_percentile may be off by n / (10 * FINE) rows."""
    return max(0.0, rank / n - 1 / FINE), min(1.0, (rank + 1) / n + 1 / FINE)


def at_ranks(df: DataFrame, x: str, ranks: list[int], n: int, few: int = FEW) -> dict[int, float]:
    """The values of a column without nulls at ranks from 0 in ascending order, NaN last, of n rows.

    A rank's stretch of values is narrowed to about a five-hundredth by a mergeable sketch, whose ends are then counted exactly, until few rows or a
    single value are left. Nothing is sorted or shuffled but sketches and counts, and equal values never grow a task.
    """
    v, out = F.col(x), {}
    stretches = {r: (None, None, 0, n) for r in set(ranks)}  # first and last value, rows before it, rows in it
    within = lambda low, high: (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high)
    while stretches:
        for r, (low, high, before, inside) in list(stretches.items()):
            if low is not None and (low == high or (low != low and high != high)):
                out[r] = stretches.pop(r)[0]
            elif inside <= few or df.where(within(low, high)).agg(F.approx_count_distinct(v)).first()[0] <= few // 4:
                counts = df.where(within(low, high)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
                ends = np.cumsum([c.n for c in counts])
                out[r] = counts[int(np.searchsorted(ends, r - before, side="right"))].v
                del stretches[r]
        if not stretches:
            break
        asked = [(r, F.percentile_approx(F.when(within(low, high), v), list(_sketch_reach(r - before, inside)), 10 * FINE).alias(f"r{r}")) for r, (low, high, before, inside) in stretches.items()]
        ends = df.agg(*[a for _, a in asked]).first().asDict()
        counts = df.agg(*[c.alias(f"{k}{r}") for r in stretches for low, high in [ends[f"r{r}"]] for k, c in (("b", F.count_if(v < low)), ("i", F.count_if((v >= low) & (v <= high))))]).first().asDict()
        for r, old in list(stretches.items()):
            stretches[r] = (*ends[f"r{r}"], counts[f"b{r}"], counts[f"i{r}"])
            if stretches[r] == old:  # many equal values at both ends: the rank is one of theirs, or lies between
                low, high, before, inside = old
                e = df.agg(F.count_if(v == low).alias("a"), F.count_if(v == high).alias("z"), F.min(F.when((v > low) & (v < high), v)).alias("first"), F.max(F.when((v > low) & (v < high), v)).alias("last")).first()
                at = r - before
                stretches[r] = (low, low, before, e.a) if at < e.a else (high, high, before + inside - e.z, e.z) if at >= inside - e.z else (e.first, e.last, before + e.a, inside - e.a - e.z)
    return out


def percentiles(df: DataFrame, x: str, shares: list[float], few: int = FEW) -> tuple[int, list[float]]:
    """(number of values, the exact percentiles), linear between ranks; 0 for no values. Nulls don't count."""
    rows = df.select(F.col(x).cast("double").alias(x)).where(F.col(x).isNotNull())
    n = rows.count()
    if not n:
        return 0, [0.0] * len(shares)
    at = [divmod(p * (n - 1), 1) for p in shares]
    values = at_ranks(rows, x, [int(k) + d for k, f in at for d in ((0, 1) if f else (0,))], n, few)
    return n, [values[int(k)] + (f * (values[int(k) + 1] - values[int(k)]) if f else 0.0) for k, f in at]


def latency(df: DataFrame, last: int | None = 1000, order: str = "ts") -> DataFrame:
    """p50 and p99 of latency_ms over the last rows by order (all: None)."""
    rows = df if last is None else df.orderBy(F.desc(order)).limit(last)
    n, (p50, p99) = percentiles(rows, "latency_ms", [0.5, 0.99])
    return df.sparkSession.range(1).select(F.lit(p50).alias("p50"), F.lit(p99).alias("p99"), F.lit(n).cast("long").alias("n"))


def per_minute(df: DataFrame, now: Column, window_s: float, ts: str = "ts") -> DataFrame:
    """Rows a minute over the last window_s seconds; 0 for no window."""
    if window_s <= 0:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("per_minute"))
    recent = S.micros(F.col(ts)) >= S.micros(now) - int(window_s * 1_000_000)
    return df.agg((F.count_if(recent) * 60.0 / window_s).alias("per_minute"))


def kpis(events: DataFrame, anomalies: DataFrame, eri: DataFrame, alerts: DataFrame, uptime_s: float = 0.0, cooldown_s: int = 60, eri_s: int = 300) -> DataFrame:
    """One row of figures. The index is averaged over its last eri_s seconds, alerts count over their last cooldown_s.

    A window ends with the newest row and leaves out what is just its length older; a length of 0 keeps the newest rows only.
    eri and alerts are read twice each, so write them first if they are costly.
    """

    def latest(df: DataFrame, seconds: int, *aggs: Column) -> DataFrame:
        t = S.micros(F.col("ts"))
        top = df.agg(F.max(t).alias("_top"))
        return df.crossJoin(F.broadcast(top)).where(t > F.col("_top") - max(seconds * 1_000_000, 1)).agg(*aggs)

    one = [
        events.agg(F.count(F.lit(1)).alias("events_processed_total"), F.max("ts").alias("last_event_timestamp")),
        anomalies.agg(F.count(F.lit(1)).alias("anomalies_detected_total")),
        latest(alerts, cooldown_s, F.countDistinct("discharge_point_id").alias("active_alerts_count"), S.rank_band(F.max(S.band_rank(F.col("risk_band")) + 1)).alias("highest_risk_band")),
        latest(eri, eri_s, F.coalesce(F.avg("eri"), F.lit(0.0)).alias("avg_eri_last_5min")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(F.broadcast(x))
    return out.withColumn("pipeline_uptime_seconds", F.lit(float(uptime_s)))


def stage_rows(df: DataFrame, stages: list[str]) -> DataFrame:
    """A row per event and stage of df (event_id, one epoch-seconds column per stage), latency counted from the first stage."""
    cells = F.array(*[F.struct(F.lit(s).alias("pipeline_stage"), F.col(s).alias("stage_timestamp"), S.latency_ms(F.col(stages[0]), F.col(s)).alias("latency_ms")) for s in stages])
    return df.select("event_id", F.inline(cells))


def factory_summary(df: DataFrame) -> DataFrame:
    return df.where("cod IS NOT NULL").groupBy("factory_id").agg(F.avg("cod").alias("mean_cod"), F.max("cod").alias("max_cod"), F.stddev_samp("cod").alias("std_cod"))


def extremes(summary: DataFrame) -> DataFrame:
    """The factory with the peak and the one with least spread, which is suspect under 1."""
    return summary.agg(F.max_by("factory_id", F.struct("max_cod", "factory_id")).alias("peak_factory"), F.max("max_cod").alias("peak_cod"), F.min_by("factory_id", F.struct("std_cod", "factory_id")).alias("steady_factory"), F.min("std_cod").alias("steady_std"), (F.min("std_cod") < 1.0).alias("tamper_hint"))


def counted(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most first, ties by value, with its place.

    Values are dealt by range of (count, value) and numbered within their task; what comes before a task is added from one count a task.
    """
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc(column)]
    dealt = g.repartitionByRange(*order).sortWithinPartitions(*order)
    task, at = scratch.spare("task", g), scratch.spare("at", g)
    rows = scratch.written(dealt.withColumns({task: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = rows.groupBy(task).agg(F.count(F.lit(1)).alias("size"), F.min(at).alias("least"))
    before = F.coalesce(F.sum("size").over(Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    sizes = sizes.select(F.col(task).alias("_of"), (before - F.col("least")).alias("_before"))
    return rows.join(F.broadcast(sizes), F.col(task) == F.col("_of")).select(column, "n", (F.col(at) + F.col("_before") + 1).cast("int").alias("place"))


def recent(df: DataFrame, k: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)


def tally(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null too."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def slice_figures(df: DataFrame, hours: float, threshold: float, ts: str = "ts") -> DataFrame:
    """Mean, maximum, breaches and high breaches (twice the threshold) of the last hours, and the number of distinct sensors there."""
    rows = window_slice(df, hours, threshold, ts)
    return rows.agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.count_if("is_breach").alias("breaches"), F.count_if(F.col("value") >= 2 * F.col("threshold")).alias("high"), F.countDistinct("sensor_id").alias("sensors"))


def window_slice(df: DataFrame, hours: float, threshold: float, ts: str = "ts") -> DataFrame:
    """Rows of the last hours before the newest one, each marked as a breach or not."""
    top = df.agg(F.max(S.micros(F.col(ts))).alias("_top"))
    return df.crossJoin(F.broadcast(top)).where(S.micros(F.col(ts)) >= F.col("_top") - int(hours * 3_600_000_000)).drop("_top").withColumn("is_breach", F.col("value") >= threshold).withColumn("threshold", F.lit(float(threshold)))


def breach_figures(df: DataFrame, threshold: float) -> DataFrame:
    return df.agg(F.max_by("value", F.struct("ts", "event_id")).alias("current"), F.max("value").alias("most"), F.count_if(F.col("value") >= threshold).alias("breaches"))
