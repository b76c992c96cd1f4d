"""Column functions; every one is a Catalyst expression."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BANDS, Config


def glob_regex(pattern: str) -> str:
    """A case-sensitive file glob (* ? [seq] [!seq]) as a Java regex for the whole string."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def rejection(sensor: Column, timestamp: Column, value: Column, cfg: Config) -> Column:
    """Why a record is rejected, "" if it is valid; the first failing rule counts. The messages are fixed values."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    iso = timestamp.rlike(r"^\d{4}-\d{2}-\d{2}") & timestamp.try_cast("timestamp").isNotNull()
    ranges = F.lit("")
    for pattern, (low, high) in reversed(cfg.sensor_value_range.items()):
        out = F.concat(F.lit("value "), plain_number(value.cast("double")), F.lit(f" out of range [{low}, {high}] for pattern {pattern!r}"))
        ranges = F.when(sensor.rlike(glob_regex(pattern)), F.when((value < low) | (value > high), out).otherwise("")).otherwise(ranges)
    return (
        F.when(sensor.isNull(), "missing 'sensor_id'")
        .when(timestamp.isNull(), "missing 'timestamp'")
        .when(value.isNull(), "missing 'value'")
        .when(F.trim(sensor) == "", "invalid 'sensor_id type/content: str")
        .when(F.length(sensor) > cfg.max_sensor_id_length, F.concat(F.lit("sensor_id exceeds max length ("), F.length(sensor).cast("string"), F.lit(f" > {cfg.max_sensor_id_length})")))
        .when(~finite, F.concat(F.lit("value must be finite (got "), F.when(F.isnan(value), "nan").when(value > 0, "inf").otherwise("-inf"), F.lit(")")))
        .when(~(iso | timestamp.try_cast("double").isNotNull()), F.concat(F.lit("invalid 'timestamp' format: '"), timestamp, F.lit("'")))
        .otherwise(ranges)
    )


def parsed(time: Column, fmt: str) -> Column:
    """A time string as timestamp_ntz, null if it doesn't fit."""
    return F.try_to_timestamp(time, F.lit(fmt)).cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970, of a timestamp_ntz, whatever the session's time zone."""
    return F.floor(micros(ts) / 1_000_000).cast("long")


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def floor_div(x: Column, by: int) -> Column:
    """Whole numbers divided exactly, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def at_micros(x: Column) -> Column:
    """The timestamp_ntz that is x microseconds after 1970."""
    none = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(none, none, none, (x.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


#: Microseconds of each unit of time.
UNITS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def interval_micros(text: str) -> int:
    """Microseconds of a duration such as "6 hours" or "1 minute 30 seconds"."""
    parts = [(int(n), u.rstrip("s")) for n, u in re.findall(r"(\d+)\s*([a-z]+)", text.lower())]
    if not re.fullmatch(r"(\s*\d+\s*[a-z]+)+\s*", text.lower()) or any(u not in UNITS for _, u in parts):
        raise ValueError(f"not a duration: {text!r}")
    return sum(n * UNITS[u] for n, u in parts)


def bound_text(ts: Column) -> Column:
    """A window's bound as text, to the minute."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def text_bucket(time: Column, fmt: str, width_ms: int) -> Column:
    """The bucket of a time given as text, as text of the same form; what can't be read as a time stays as it is."""
    return F.coalesce(F.date_format(time_bucket(parsed(time, fmt), width_ms), fmt), time)


def plain_number(x: Column) -> Column:
    """A double as text with a point and no exponent from 1e-4 to under 1e16, as 2000000000.0; beyond that in Spark's form."""
    size = F.abs(x)
    digits = F.regexp_replace(x.cast("decimal(38,16)").cast("string"), r"(\.\d+?)0+$", "$1")
    wide = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(wide, digits).otherwise(x.cast("string"))


def population_std(mean: Column, mean_square: Column, eps: float) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), mean_square - mean * mean)) + eps


def time_bucket(ts: Column, width_ms: int) -> Column:
    """The start, as timestamp_ntz, of the width's multiple since 1970 that holds ts."""
    steps = F.floor(micros(ts) / F.lit(width_ms * 1000)) * width_ms
    return F.timestamp_add("SECOND", F.floor(steps / 1000).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def rms(sum_squares: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(sum_squares / n)).otherwise(0.0)


def risk_band(eri: Column, cfg: Config) -> Column:
    """Upper bounds are exclusive; NaN is CRITICAL."""
    return F.when(eri < cfg.eri_threshold_low, BANDS[0]).when(eri < cfg.eri_threshold_medium, BANDS[1]).when(eri < cfg.eri_threshold_high, BANDS[2]).otherwise(BANDS[3])


def band_rank(band: Column) -> Column:
    """0 to 3; -1 for anything else."""
    out = F.lit(-1)
    for k, name in enumerate(BANDS):
        out = F.when(band == name, k).otherwise(out)
    return out


def rank_band(rank: Column) -> Column:
    """The KPI's band of a rank that counts from 1; NONE for 0 or null."""
    out = F.lit("NONE")
    for k, name in enumerate(BANDS, 1):
        out = F.when(rank == k, name).otherwise(out)
    return out


def alert_level(band: Column) -> Column:
    return F.when(band == "MEDIUM", "INFO").when(band == "HIGH", "WARNING").when(band == "CRITICAL", "CRITICAL").otherwise("")


def event_id(sensor: Column, time: Column) -> Column:
    return F.concat(sensor, F.lit("|"), time)


def latency_ms(begin: Column, end: Column) -> Column:
    """Of epoch seconds; -1 if either is missing."""
    return F.coalesce((end - begin) * 1000, F.lit(-1.0))


def attribution_detail(shares: Column) -> Column:
    """Compact JSON of shares to three places, in their order."""
    return F.coalesce(F.to_json(F.map_from_entries(F.transform(shares, lambda x: F.struct(x["sensor"], F.bround(x["fraction"], 3))))), F.lit("{}"))


# the texts of the next three functions are fixed values


def attribution_message(group: Column, shares: Column) -> Column:
    """Percentages round half to even."""
    top = F.get(shares, F.lit(0))
    return F.format_string("Anomaly in %s: primary driver %s (%d%% of score)", group, F.coalesce(top["sensor"], F.lit("")), F.bround(F.coalesce(top["fraction"], F.lit(0.0)) * 100, 0).cast("int"))


def latency_summary(p50: Column, p99: Column, per_minute: Column) -> Column:
    return F.format_string("Latency P50: %.1fms | P99: %.1fms | Alerts/min: %.1f", p50, p99, per_minute)


def tamper_detail(row: Mapping[str, Column]) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    kind = row["tamper_type"]
    return (
        F.when(kind == "ZERO_VARIANCE", F.concat(F.lit("COD locked @ "), text(row["cod_max"]), F.lit(" mg/L  (range = "), text(row["cod_range"]), F.lit(")")))
        .when(kind == "DILUTION_TAMPER", F.concat(F.lit("COD dropped to "), text(row["mean_cod"]), F.lit(" mg/L (baseline "), text(row["baseline_cod"]), F.lit(") | TSS "), text(row["mean_tss"])))
        .when(kind == "BLACKOUT_TAMPER", F.concat(F.floor(F.coalesce(row["blackout_ratio"], F.lit(0.0)) * 100).cast("string"), F.lit("% null readings  ("), text(row["blackout_rows"]), F.lit(" / "), text(row["total_rows"]), F.lit(" rows)")))
    )


def require(columns: Sequence[str], needed: Sequence[str]) -> None:
    if missing := [c for c in needed if c not in columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
