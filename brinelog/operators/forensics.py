"""Tracing shocks back to their source, and tampering detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S


def backtracked(shocks: DataFrame, sources: DataFrame, travel_s: int, tolerance_s: int) -> DataFrame:
    """shocks (shock_id, ts, ...) with the highest-COD source row (factory_id, ts, cod, ...) in ts - travel +- tolerance.

    Both ends count; ties by earlier ts, then factory_id; no match leaves nulls. Time is cut into buckets as long as a band, so a band is the
    end of one bucket and the start of the next. The best row up to each time of a bucket, and from each time on, is kept while its times
    are passed in order, so no shock is paired with its sources and the work grows with the rows, however many a band holds.
    """
    reach = tolerance_s * 1_000_000
    width = max(2 * reach, 1)
    bucket = lambda t: S.floor_div(t, width)
    center = S.micros(F.col("ts")) - travel_s * 1_000_000
    ends = F.array(*[F.struct((center + d * reach).alias("_t"), F.lit(d).alias("_end")) for d in (-1, 1)])
    asked = shocks.where("ts IS NOT NULL").select("shock_id", F.explode(ends).alias("_e")).select("shock_id", "_e._t", "_e._end")
    told = [c for c in ("bod", "tss") if c in sources.columns]
    # the smallest is the best: NaN is the highest COD, and rows without a factory come last
    rank = F.struct(~F.isnan(F.col("cod").cast("double")), (-F.col("cod")).alias("down"), "ts", F.col("factory_id").isNull().alias("none"), "factory_id", *told)
    offered = sources.where("cod IS NOT NULL AND ts IS NOT NULL").select(S.micros(F.col("ts")).alias("_t"), rank.alias("_best"))
    rows = offered.unionByName(asked, allowMissingColumns=True).withColumn("_b", bucket(F.col("_t")))
    upto, since = (F.min("_best").over(Window.partitionBy("_b").orderBy(o)) for o in (F.asc("_t"), F.desc("_t")))  # rows of the same time count
    found = rows.select("shock_id", "_end", upto.alias("_upto"), since.alias("_since")).where("_end IS NOT NULL")
    row = scratch.spare("_row", shocks)
    top = found.groupBy("shock_id").agg(F.min(F.when(F.col("_end") < 0, F.col("_since")).otherwise(F.col("_upto"))).alias(row))
    out = shocks.join(top, "shock_id", "left")
    back = F.timestamp_add("SECOND", F.lit(-travel_s), F.col("ts")).alias("backtrack_time")
    return out.select(*shocks.columns, back, F.col(f"{row}.factory_id").alias("attributed_factory"), F.col(f"{row}.ts").alias("source_ts"), (-F.col(f"{row}.down")).alias("factory_cod"), *[F.col(f"{row}.{c}").alias(f"factory_{c}") for c in told])


def _anchored(df: DataFrame, width_s: int) -> DataFrame:
    """df with _b, the tumbling window's number since the factory's own first row. First times are aggregated and joined, so no task gets all of a factory's rows."""
    t, own, start = S.seconds(F.col("ts")), scratch.spare("_factory", df), scratch.spare("_first", df)
    first = df.groupBy(F.col("factory_id").alias(own)).agg(F.min(t).alias(start))
    return df.join(first, F.col("factory_id").eqNullSafe(F.col(own))).withColumn("_b", F.floor((t - F.col(start)) / width_s)).drop(own, start)


def zero_variance(df: DataFrame, width_s: int, least: float = 1e-4, min_rows: int = 2, tie: str = "ts") -> DataFrame:
    """Windows of (factory_id, ts, cod) with hardly any spread."""
    rows = df.where("cod IS NOT NULL AND ts IS NOT NULL")
    g = _anchored(rows, width_s).groupBy("factory_id", "_b").agg(F.max("cod").alias("cod_max"), F.min("cod").alias("cod_min"), F.count("cod").alias("row_count"), F.max_by("ts", F.struct("ts", tie)).alias("window_end"))
    g = g.withColumn("cod_range", F.col("cod_max") - F.col("cod_min")).where((F.col("row_count") >= min_rows) & (F.col("cod_range") < least))
    return g.select(F.lit("ZERO_VARIANCE").alias("tamper_type"), "factory_id", "window_end", "cod_max", "cod_min", "cod_range", "row_count")


def dilution(df: DataFrame, width_s: int, drop: float, stable: float, min_rows: int = 3, min_total: int = 6, tie: str = "ts") -> DataFrame:
    """Windows of (factory_id, ts, cod, tss) in which cod falls by drop against the last qualifying window while tss holds."""
    rows = df.where("cod IS NOT NULL AND tss IS NOT NULL AND ts IS NOT NULL")
    own = scratch.spare("_factory", df)
    enough = rows.groupBy(F.col("factory_id").alias(own)).agg(F.count(F.lit(1)).alias("_total")).where(F.col("_total") >= min_total)
    rows = rows.join(enough, F.col("factory_id").eqNullSafe(F.col(own)), "left_semi")
    g = _anchored(rows, width_s).groupBy("factory_id", "_b").agg(F.avg("cod").alias("mean_cod"), F.avg("tss").alias("mean_tss"), F.count(F.lit(1)).alias("_n"), F.max_by("ts", F.struct("ts", tie)).alias("window_end")).where(F.col("_n") >= min_rows)
    w = Window.partitionBy("factory_id").orderBy("_b")
    g = g.withColumn("baseline_cod", F.lag("mean_cod").over(w)).withColumn("baseline_tss", F.lag("mean_tss").over(w))
    g = g.where((F.col("mean_cod") <= F.col("baseline_cod") * (1 - drop)) & (F.col("mean_tss") >= F.col("baseline_tss") * (1 - stable)))
    return g.select(F.lit("DILUTION_TAMPER").alias("tamper_type"), "factory_id", "window_end", "mean_cod", "mean_tss", "baseline_cod", "baseline_tss")


def blackout(df: DataFrame, width_s: int, ratio: float = 0.80, min_rows: int | None = None, tie: str = "ts") -> DataFrame:
    """Windows in which at least ratio of the cod readings are null; min_rows: a row a minute unless given."""
    need = max(1, width_s // 60) if min_rows is None else min_rows
    rows = df.where("ts IS NOT NULL")
    g = _anchored(rows, width_s).groupBy("factory_id", "_b").agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("cod").isNull()).alias("blackout_rows"), F.max_by("ts", F.struct("ts", tie)).alias("window_end"))
    g = g.withColumn("blackout_ratio", F.col("blackout_rows") / F.col("total_rows")).where((F.col("total_rows") >= need) & (F.col("blackout_ratio") >= ratio))
    return g.select(F.lit("BLACKOUT_TAMPER").alias("tamper_type"), "factory_id", "window_end", "total_rows", "blackout_rows", "blackout_ratio")


def all_tampering(zero: DataFrame, diluted: DataFrame, dark: DataFrame) -> DataFrame:
    return zero.unionByName(diluted, allowMissingColumns=True).unionByName(dark, allowMissingColumns=True)
