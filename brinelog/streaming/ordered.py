"""Operators that depend on order, on streams whose rows come in any order within the watermark.

Keys are dealt to cells by their hash, and a cell's rows are worked on together as arrays, so that what a batch costs grows with its rows and hardly with
its keys. A cell's rows wait in state, as Arrow streams, until the watermark has passed them; an event-time timer then releases them, sorted by key and
time. What comes later than the watermark is refused by Spark before it gets here. So each operator sees a key's rows in order of
event time, whatever files and batches they came in, and gives what its batch twin gives. A key's state is forgotten
in a pause of more than idle_s seconds of event time, if that is set, and given up once the watermark has passed that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Columns of the rows: time as microseconds, the key as a text (see _run), and the cell of keys.
AT, KEY, CELL = "at_us", "key_text", "cell"
#: Cells of a stream; a query's checkpoint holds them, so they are the same for all sizes.
CELLS = 64


def _packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class Runs:
    """Released rows, sorted by key, time and event_id, cut into runs at other keys and at pauses longer than the time to live.

    runs: key, first and end of each; news: it begins without its key's state; last: it is its key's last one.
    """

    def __init__(self, rows: pd.DataFrame, newest: pd.Series | None, idle_us: int | None):
        self.rows = rows
        at, key = rows[AT].to_numpy(np.int64), rows[KEY].to_numpy(object)
        other = np.concatenate([[True], key[1:] != key[:-1]])
        cut = other.copy()
        if idle_us is not None:
            cut |= np.diff(at, prepend=at[0]) > idle_us
        first = np.flatnonzero(cut)
        self.number = np.cumsum(cut) - 1
        self.runs = pd.DataFrame({KEY: key[first], "first": first, "end": [*first[1:], len(at)]})
        self.runs["news"] = ~other[first]
        if newest is not None:
            paused = at[first] - newest.reindex(key[first]).to_numpy(float) > idle_us
            self.runs["news"] |= paused
        self.runs["last"] = np.concatenate([other[first][1:], [True]])


class Ordered(StatefulProcessor):
    """Rows in order of (at_us, event_id) by key. A subclass has a table of state, a row a key, and gives what released rows lead to."""

    def __init__(self, names: list[str], idle_s: int | None = None):
        self.names, self.idle_us = names, None if idle_s is None else idle_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.told = handle.getValueState("told", "rows binary")
        self.seen = handle.getValueState("seen", "rows binary") if self.idle_us is not None else None

    def release(self, runs: Runs | None, state: pd.DataFrame | None, watermark_us: int) -> tuple[pd.DataFrame | None, pd.DataFrame | None]:
        """(what is told, the new state) of released rows and of time that has passed."""
        raise NotImplementedError

    def due(self, state: pd.DataFrame) -> pd.Series:
        """Microseconds at which release() has to be called again, by key."""
        return pd.Series(dtype="int64")

    def _step(self, fresh: list[pd.DataFrame], watermark_ms: int) -> Iterator[pd.DataFrame]:
        mark = watermark_ms * 1000
        old = [_unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.concat([*old, *fresh], ignore_index=True) if old or fresh else pd.DataFrame(columns=self.names)
        ready = rows[AT].to_numpy(np.int64) <= mark
        kept, runs = rows[~ready], None
        newest = _unpacked(self.seen.get()[0]).set_index(KEY)[AT] if self.seen is not None and self.seen.exists() else None
        if ready.any():
            now = rows[ready].sort_values([KEY, AT, "event_id"], kind="stable", ignore_index=True)
            runs = Runs(now, newest, self.idle_us)
            if self.idle_us is not None:
                last = now.groupby(KEY)[AT].max()
                newest = last if newest is None else last.combine_first(newest).astype("int64")
        if len(kept):
            self.waiting.put([(_packed(kept),)])
        elif self.waiting.exists():
            self.waiting.clear()
        state = _unpacked(self.told.get()[0]) if self.told.exists() else None
        out, state = self.release(runs, state, mark)
        due = self.due(state) if state is not None else pd.Series(dtype="int64")
        due = due[due > mark]
        times = [int(x.min()) for x in (kept[AT], due) if len(x)]
        if newest is not None:
            gone = newest.index[(newest + self.idle_us <= mark) & ~newest.index.isin(due.index)]
            newest = newest.drop(gone)
            state = state[~state[KEY].isin(gone)] if state is not None else None
            times += [max(int(newest.min()) + self.idle_us, mark)] if len(newest) else []
        self._keep(self.told, state)
        if self.seen is not None:
            self._keep(self.seen, None if newest is None else newest.rename_axis(KEY).reset_index(name=AT))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(max(min(times), mark) // 1000 + 1)
        if out is not None and len(out):
            yield out

    @staticmethod
    def _keep(held, table: pd.DataFrame | None) -> None:
        if table is not None and len(table):
            held.update((_packed(table),))
        elif held.exists():
            held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step([r[self.names] for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _run(df: DataFrame, key: str, ts: str, late: str, processor, columns: list[str], out: str) -> DataFrame:
    """processor over df by cells of keys; rows carry their time as microseconds beside the watermarked timestamp. out: columns that are told beside the key.

    A key is told as a text, "" for null and else the value behind "=", so that keys of all types compare and null is one of them.
    """
    kind = dict(df.dtypes)[key]
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(CELLS)).alias(CELL), text.alias(KEY), F.col(ts).cast("timestamp").alias("event_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias(AT), *columns).withWatermark("event_time", late)
    told = rows.groupBy(CELL).transformWithStateInPandas(processor([KEY, AT, *columns]), f"{KEY} string, {out}", "append", "eventTime")
    return told.withColumn(KEY, F.when(F.col(KEY) != "", F.substring(KEY, 2, 1 << 30)).cast(kind)).withColumnRenamed(KEY, key)


def _times(us: pd.Series) -> pd.Series:
    return pd.to_datetime(us.astype("int64"), unit="us")


class Persistence(Ordered):
    """The length of a key's run of anomalies, told once it has reached count; a null flag ends it."""

    def __init__(self, names: list[str], count: int, idle_s: int | None = None):
        super().__init__(names, idle_s)
        self.count = count

    def release(self, runs, state, watermark_us):
        if runs is None:
            return None, state
        rows, cut = runs.rows, runs.runs
        hit = (rows["is_anomaly"] == True).to_numpy(bool)  # noqa: E712
        place, first = np.arange(len(hit)), cut["first"].to_numpy()[runs.number]
        last_miss = np.maximum.accumulate(np.where(hit, first - 1, place))
        before = np.zeros(len(cut), np.int64) if state is None else state.set_index(KEY)["run"].reindex(cut[KEY]).fillna(0).to_numpy(np.int64)
        before[cut["news"].to_numpy(bool)] = 0
        counts = np.where(hit, place - last_miss + np.where(last_miss < first, before[runs.number], 0), 0)
        ends = cut[cut["last"]]
        shown = hit & (counts >= self.count)
        out = pd.DataFrame({KEY: rows[KEY][shown], "ts": _times(rows[AT][shown]), "event_id": rows["event_id"][shown].astype("int64"), "consecutive_count": counts[shown]})
        return out, _renewed(state, pd.DataFrame({KEY: ends[KEY], "run": counts[ends["end"] - 1]}))


class Cooldown(Ordered):
    """Rows whose time is at least width after the last one kept."""

    def __init__(self, names: list[str], width_us: int, idle_s: int | None = None):
        super().__init__(names, idle_s)
        self.width = width_us

    def release(self, runs, state, watermark_us):
        if runs is None:
            return None, state
        cut = runs.runs
        at = runs.rows[AT].to_numpy(np.int64)
        before = {} if state is None else dict(zip(state[KEY], state["opens"].tolist(), strict=True))
        kept, after = [], {}
        for key, first, end, news in zip(cut[KEY], cut["first"].tolist(), cut["end"].tolist(), cut["news"].tolist(), strict=True):
            t = at[first:end]
            opens = t[0] if news or key not in before else before[key]
            k = int(np.searchsorted(t, opens))
            while k < len(t):
                kept.append(first + k)
                opens = t[k] + self.width
                k += int(np.searchsorted(t[k:], opens))
            after[key] = int(opens)
        out = runs.rows.iloc[kept]
        return out.drop(columns=[AT]).assign(ts=_times(out[AT])), _renewed(state, pd.DataFrame({KEY: list(after), "opens": list(after.values())}))


def _renewed(state: pd.DataFrame | None, fresh: pd.DataFrame) -> pd.DataFrame:
    return fresh if state is None else pd.concat([state[~state[KEY].isin(fresh[KEY])], fresh], ignore_index=True)


def persisted(df: DataFrame, count: int, late: str = "10 minutes", idle_s: int | None = None) -> DataFrame:
    """Stream of (sensor_id, ts, event_id, is_anomaly) to rows whose run has reached count, once the watermark has passed them. Rows without ts are refused."""
    return _run(df.where("ts IS NOT NULL"), "sensor_id", "ts", late, lambda names: Persistence(names, count, idle_s), ["event_id", "is_anomaly"], "ts timestamp_ntz, event_id long, consecutive_count long")


def cooled(df: DataFrame, key: str, seconds: int, late: str = "10 minutes", idle_s: int | None = None) -> DataFrame:
    """Stream of (key, ts, event_id, more columns), gated per key in order of event time. Rows without ts, which the batch twin keeps, are refused."""
    if seconds <= 0:
        return df
    if idle_s is not None and idle_s < seconds:
        raise ValueError("state must outlive the cooldown")
    columns = [c for c in df.columns if c not in (key, "ts")]
    kinds = dict(df.dtypes)
    shown = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "ts timestamp_ntz"])
    return _run(df.where("ts IS NOT NULL"), key, "ts", late, lambda names: Cooldown(names, seconds * 1_000_000, idle_s), columns, shown).select(*df.columns)


#: What is told of a window beside its factory.
TAMPER = "tamper_type string, window_end timestamp_ntz, cod_max double, cod_min double, cod_range double, row_count long, mean_cod double, mean_tss double, baseline_cod double, baseline_tss double, total_rows long, blackout_rows long, blackout_ratio double"
#: A window's figures, and how those of its parts are put together.
FIGURES = {"n": np.add, "dark": np.add, "most": np.fmax, "least": np.fmin, "cod": np.add, "tss": np.add, "last": np.maximum}
EMPTY = pd.DataFrame({KEY: pd.Series(dtype=object)} | {c: pd.Series(dtype="int64") for c in ("number", "anchor", "n", "dark", "last")} | {c: pd.Series(dtype=float) for c in ("most", "least", "cod", "tss", "before_cod", "before_tss")})


class Tampering(Ordered):
    """The three detectors over windows that start with a factory's own first row; a window closes with a row behind it, with time, or in a pause that ends its factory's state.

    State is a row a factory and detector: its anchor, its open window (n is 0 if there is none) and, for dilution, the means of the last window that had enough rows.
    """

    def __init__(self, names: list[str], zero: dict, dilution: dict, blackout: dict, idle_s: int | None = None):
        super().__init__(names, idle_s)
        self.zero, self.dilution, self.blackout = zero, dilution, blackout
        self.width = {"ZERO_VARIANCE": zero["width_s"], "DILUTION_TAMPER": dilution["width_s"], "BLACKOUT_TAMPER": blackout["width_s"]}

    def due(self, state):
        opened = state[state["n"] > 0]
        ends = (opened["anchor"] + (opened["number"] + 1) * opened["kind"].map(self.width)) * 1_000_000
        return pd.Series(ends.to_numpy("int64"), index=opened[KEY])

    def release(self, runs, state, watermark_us):
        told, kept = [], []
        for kind in self.width:
            own = EMPTY if state is None else state[state["kind"] == kind]
            own, closed = self._windows(kind, runs, own, watermark_us)
            told.append(self._suspect(kind, closed))
            kept.append(own.assign(kind=kind))
        return self._frame(told), pd.concat([k for k in kept if len(k)] or kept[:1], ignore_index=True)

    def _parts(self, kind: str, runs: Runs, going: np.ndarray, anchors: np.ndarray) -> dict[str, np.ndarray]:
        """Each released row that the detector looks at, as a window's part. going: runs that go on from a state, with its anchor."""
        cod, tss = (runs.rows[c].to_numpy(float, na_value=np.nan) for c in ("cod", "tss"))
        takes = {"ZERO_VARIANCE": ~np.isnan(cod), "DILUTION_TAMPER": ~np.isnan(cod) & ~np.isnan(tss), "BLACKOUT_TAMPER": np.ones(len(cod), bool)}[kind]
        us, run, cod, tss = runs.rows[AT].to_numpy(np.int64)[takes], runs.number[takes], cod[takes], tss[takes]
        sec, dark = us // 1_000_000, np.isnan(cod)
        anchor = np.zeros(len(runs.runs), np.int64)
        anchor[run[::-1]] = sec[::-1]  # each run's first one stays
        anchor[going] = anchors
        number = (sec - anchor[run]) // self.width[kind]
        return {"run": run, "number": number, "anchor": anchor[run], "n": np.ones(len(run), np.int64), "dark": dark.astype(np.int64), "most": cod, "least": cod, "cod": np.where(dark, 0.0, cod), "tss": np.nan_to_num(tss), "last": us}

    def _windows(self, kind: str, runs: Runs | None, own: pd.DataFrame, mark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(the detector's new state, the windows that have closed, by factory and time, with the means of the last one before that had enough rows)."""
        cut = None if runs is None else runs.runs
        code, keys = pd.factorize(own[KEY].to_numpy(object) if cut is None else np.concatenate([own[KEY].to_numpy(object), cut[KEY].to_numpy(object)]))
        of_own, of_run = code[: len(own)], code[len(own) :]
        place = np.arange(len(of_run))
        first, last = (np.full(len(keys), -1) for _ in range(2))
        first[of_run[::-1]], last[of_run] = place[::-1], place
        goes = first[of_own]  # the run in which a state goes on: its factory's first one, unless that begins anew
        if cut is not None:
            goes = np.where((goes >= 0) & ~cut["news"].to_numpy(bool)[goes], goes, -1)
        opened = own["n"].to_numpy() > 0
        w = {"run": goes[opened]} | {c: own[c].to_numpy()[opened] for c in ("number", "anchor", *FIGURES)}
        code = of_own[opened]
        if runs is not None:
            fresh = self._parts(kind, runs, goes[goes >= 0], own["anchor"].to_numpy(np.int64)[goes >= 0])
            w, code = {c: np.concatenate([w[c], fresh[c]]) for c in w}, np.concatenate([code, of_run[fresh["run"]]])
        order = np.lexsort((w["number"], w["run"], code))
        w = {"code": code[order]} | {c: x[order] for c, x in w.items()}
        size = len(order)
        begins = np.ones(size, bool)
        begins[1:] = np.logical_or.reduce([np.diff(w[c]) != 0 for c in ("code", "run", "number")])
        at = np.flatnonzero(begins)
        w |= {c: w[c].astype(np.longdouble) for c in ("cod", "tss")}  # so that the order of work hardly shows in sums
        w = {c: FIGURES[c].reduceat(x, at) if c in FIGURES and size else x[at] for c, x in w.items()}
        w |= {c: w[c].astype(float) for c in ("cod", "tss")}
        code, run, n, size = w["code"], w["run"], w["n"], len(at)
        newest = np.append(code[1:] != code[:-1], True)[:size]
        stays = run == last[code]  # what the factory's state goes on from
        is_open = newest & stays & ((w["anchor"] + (w["number"] + 1) * self.width[kind]) * 1_000_000 > mark)
        place, group = np.arange(size), np.ones(size, bool)
        group[1:] = (code[1:] != code[:-1]) | (run[1:] != run[:-1])
        start = np.maximum.accumulate(np.where(group, place, 0))
        full = np.maximum.accumulate(np.where(~is_open & (n >= self.dilution["min_rows"]), place, -1))
        held = np.full(len(keys), -1)
        held[of_own] = np.arange(len(own))
        held = held[code]
        known = (held >= 0) & (np.append(goes, -2)[held] == run)
        before = np.append(-1, full)[:size]
        after = {}
        for c in ("cod", "tss"):
            mean, told = w[c] / n, np.where(known, np.append(own[f"before_{c}"].to_numpy(float), np.nan)[held], np.nan)
            w[f"before_{c}"] = np.where(before >= start, mean[before], told)
            after[f"before_{c}"] = np.where(full >= start, mean[full], told)
        w = pd.DataFrame({KEY: keys[code]} | {c: x for c, x in w.items() if c not in ("code", "run")})
        new = w.assign(**after)[newest & stays]
        new.loc[~is_open[newest & stays], list(FIGURES)[:-1]] = [0, 0, np.nan, np.nan, 0.0, 0.0]
        calm = (goes == last[of_own]) & ~np.isin(of_own, code[newest & stays])
        return pd.concat([p for p in (own[calm][list(EMPTY)], new) if len(p)] or [EMPTY], ignore_index=True), w[~is_open]

    def _suspect(self, kind: str, w: pd.DataFrame) -> pd.DataFrame:
        """The closed windows that are to be told, with the columns of their kind."""
        n, own = w["n"], {}
        if kind == "ZERO_VARIANCE":
            hit = (n >= self.zero["min_rows"]) & (w["most"] - w["least"] < self.zero["least"])
            own = {"cod_max": w["most"], "cod_min": w["least"], "cod_range": w["most"] - w["least"], "row_count": n}
        elif kind == "BLACKOUT_TAMPER":
            hit = (n >= self.blackout["min_rows"]) & (w["dark"] / n >= self.blackout["ratio"])
            own = {"total_rows": n, "blackout_rows": w["dark"], "blackout_ratio": w["dark"] / n}
        else:
            cod, tss = w["cod"] / n, w["tss"] / n
            hit = (n >= self.dilution["min_rows"]) & (cod <= w["before_cod"] * (1 - self.dilution["drop"])) & (tss >= w["before_tss"] * (1 - self.dilution["stable"]))
            own = {"mean_cod": cod, "mean_tss": tss, "baseline_cod": w["before_cod"], "baseline_tss": w["before_tss"]}
        return pd.DataFrame({KEY: w[KEY], "tamper_type": kind, "window_end": w["last"]} | own)[hit]

    def _frame(self, told: list[pd.DataFrame]) -> pd.DataFrame | None:
        told = [t for t in told if len(t)]
        if not told:
            return None
        names = [c.split()[0] for c in TAMPER.split(", ")]
        out = pd.concat(told, ignore_index=True).reindex(columns=[KEY, *names])
        out["window_end"] = _times(out["window_end"])
        return out.astype({c.split()[0]: {"long": "Int64", "double": float}[c.split()[1]] for c in TAMPER.split(", ")[2:]})


def tampering(df: DataFrame, late: str, zero: dict, dilution: dict, blackout: dict, idle_s: int | None = None) -> DataFrame:
    """Stream of (factory_id, ts, cod, tss, event_id) to tamper records of all three kinds, each once its window is over.

    zero: width_s, least, min_rows; dilution: width_s, drop, stable, min_rows; blackout: width_s, ratio, min_rows; as in operators.forensics.
    """
    return _run(df.where("ts IS NOT NULL"), "factory_id", "ts", late, lambda names: Tampering(names, zero, dilution, blackout, idle_s), ["event_id", "cod", "tss"], TAMPER)


class Strongest(StatefulProcessor):
    """The best reading of a time bucket for each shock whose band touches it, told once the watermark has passed the last shock that can ask.

    A row with a shock_id asks; the others are readings. They wait as Arrow streams, one a micro-batch.
    """

    def __init__(self, names: list[str], travel_us: int, reach_us: int, width_us: int):
        self.names, self.travel, self.reach, self.width = names, travel_us, reach_us, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            self.handle.registerTimer(((key[0] + 1) * self.width + self.travel + self.reach) // 1000 + 1)
        self.waiting.appendList([(_packed(r[self.names]),) for r in rows])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.concat([_unpacked(r[0]) for r in self.waiting.get()], ignore_index=True)
        self.waiting.clear()
        asks = rows["shock_id"].notna()
        if asks.any():
            yield self.best(rows[asks], rows[~asks])

    def best(self, shocks: pd.DataFrame, readings: pd.DataFrame) -> pd.DataFrame:
        """shocks with the reading of the highest COD in their band, ties by earlier time, then factory; else nulls."""
        readings = readings.assign(nan=readings["cod"].isna(), none=readings["factory_id"].isna()).sort_values(["cod", AT, "none", "factory_id"], ascending=[False, True, True, True], na_position="first", kind="stable", ignore_index=True)
        by_time = np.argsort(readings[AT].to_numpy(np.int64), kind="stable")
        at, least = readings[AT].to_numpy(np.int64)[by_time], [by_time]  # least[k]: the best place of the 2^k rows from each on
        while 2 << (len(least) - 1) <= len(at):
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        center = shocks[AT].to_numpy(np.int64) - self.travel
        low, high = np.searchsorted(at, center - self.reach, "left"), np.searchsorted(at, center + self.reach, "right")
        place = np.full(len(shocks), -1)
        step = np.frexp(np.maximum(high - low, 1))[1] - 1  # of the largest power of two in the band
        for k in np.unique(step[high > low]):
            mine = (high > low) & (step == k)
            place[mine] = np.minimum(least[k][low[mine]], least[k][high[mine] - (1 << k)])
        found = readings.reindex(place).reset_index(drop=True)
        told = {"shock_id": shocks["shock_id"].to_numpy(), "shock_ts": _times(shocks[AT]).to_numpy(), "value": shocks["value"].to_numpy()}
        return pd.DataFrame(told | {"factory_id": found["factory_id"], "source_ts": pd.to_datetime(found[AT].astype("Int64"), unit="us"), "cod": found["cod"], "tss": found["tss"], "nan": found["nan"] == True})  # noqa: E712


def strongest_of_buckets(df: DataFrame, travel_us: int, reach_us: int, width_us: int, late: str) -> DataFrame:
    """Stream of (bucket, ts, shock_id, value, factory_id, cod, tss), shocks and readings by time bucket, to shocks with their bucket's best reading."""
    kinds = dict(df.dtypes)
    columns = ["shock_id", "value", "factory_id", "cod", "tss"]
    rows = df.where("ts IS NOT NULL").select("bucket", F.col("ts").cast("timestamp").alias("event_time"), F.unix_micros(F.col("ts").cast("timestamp")).alias(AT), *columns).withWatermark("event_time", late)
    out = f"shock_id {kinds['shock_id']}, shock_ts timestamp_ntz, value {kinds['value']}, factory_id {kinds['factory_id']}, source_ts timestamp_ntz, cod {kinds['cod']}, tss {kinds['tss']}, nan boolean"
    told = rows.groupBy("bucket").transformWithStateInPandas(Strongest([AT, *columns], travel_us, reach_us, width_us), out, "append", "eventTime")
    cod = F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("cod"))  # pandas has nulls and NaN as one
    return told.withColumns({"cod": cod} | {c: F.col(c).cast("timestamp") for c in ("shock_ts", "source_ts")}).drop("nan")


class Timeline(StatefulProcessor):
    """Rows of the first stage (0, or -1 for one that meets nothing) with those of the others that have its event_id and come within a time of it.

    A row of the first stage is told once the watermark has passed that time, and a row of another stage is given up then.
    """

    def __init__(self, stages: int, within_us: int):
        self.stages, self.within = stages, within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def _step(self, fresh: list[pd.DataFrame], watermark_ms: int) -> Iterator[pd.DataFrame]:
        mark = watermark_ms * 1000
        rows = pd.concat([*([_unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []), *fresh], ignore_index=True)
        over = rows[AT].to_numpy(np.int64) + self.within <= mark
        first = rows["stage"].to_numpy() <= 0
        if (over & first).any():
            yield self.joined(rows[over & first], rows[~first])
        kept = rows[~over]
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if len(kept):
            self.waiting.put([(_packed(kept),)])
            self.handle.registerTimer((int(kept[AT].min()) + self.within) // 1000 + 1)
        elif self.waiting.exists():
            self.waiting.clear()

    def joined(self, first: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = first.rename(columns={AT: "stage_0"})
        for k in range(1, self.stages):
            out = out.assign(row=np.arange(len(out)))
            there = others.loc[others["stage"] == k, ["event_id", AT]].rename(columns={AT: f"stage_{k}"})
            pairs = out.loc[out["stage"] == 0, ["row", "event_id", "stage_0"]].merge(there, on="event_id")
            pairs = pairs[(pairs[f"stage_{k}"] - pairs["stage_0"]).between(0, self.within)]
            out = out.merge(pairs[["row", f"stage_{k}"]], how="left", on="row").drop(columns="row")
        return out.astype({f"stage_{k}": "Int64" for k in range(self.stages)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step([r[["event_id", "stage", AT]] for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step([], timerValues.getCurrentWatermarkInMs())


def timeline(df: DataFrame, stages: int, within_us: int, late: str) -> DataFrame:
    """Stream of (event_id, ts, stage) to (event_id, stage, stage_0, stage_1, ...), a row of the first stage with each stage's microseconds."""
    rows = df.select(F.pmod(F.xxhash64("event_id"), F.lit(CELLS)).alias(CELL), F.col("ts").alias("event_time"), F.unix_micros("ts").alias(AT), "event_id", "stage").withWatermark("event_time", late)
    out = ", ".join([f"event_id {dict(df.dtypes)['event_id']}", "stage int", *(f"stage_{k} long" for k in range(stages))])
    return rows.groupBy(CELL).transformWithStateInPandas(Timeline(stages, within_us), out, "append", "eventTime")
