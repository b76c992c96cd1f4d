"""The cooldown gate: of each key's rows, those at least so long after the last one kept.

A row's fate depends on the row kept before it. A key's rows are sorted and walked with one remembered time, from one kept row to
the next by binary search. For a key with many rows that walk is cut up: time is divided into chunks of several cooldowns, and what
a chunk does depends on nothing but the time until which it is still closed when it begins. That time lies in the chunk's first
cooldown, so only rows there (and the first one after) can be the first one kept. From each of these a task walks to the end of its chunk
and tells until when the next one is closed. Entries are then linked over chunk borders, and those really entered are found from
a key's first row by doubling pointers. A second walk, with each chunk's entry known, keeps the rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S

#: Keys of more rows than this are walked in chunks; a chunk is this many cooldowns long.
HOT_ROWS, COOLDOWNS = 1_000_000, 64


def _segments(batch: pa.RecordBatch, names: list[str]) -> list[tuple[int, int]]:
    """Stretches of equal values of the named columns."""
    if not batch.num_rows:
        return []
    change = np.zeros(batch.num_rows - 1, bool)
    for c in names:
        change |= np.diff(batch.column(c).dictionary_encode("encode").indices.to_numpy()) != 0
    return list(itertools.pairwise([0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]))


def _walk(names: list[str], time: str, width: int, begin: str | None = None):
    """For mapInArrow, over rows sorted by names, then time: those kept. begin: a column with the time from which a stretch is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_key, opens = None, None
        for batch in batches:
            t, kept = batch.column(time).to_numpy(), []
            for first, end in _segments(batch, names):
                key = [batch.column(c)[first].as_py() for c in names]
                if key != at_key:
                    at_key, opens = key, t[first] if begin is None else batch.column(begin)[first].as_py()
                at = first + int(np.searchsorted(t[first:end], opens))
                while at < end:
                    kept.append(at)
                    opens = t[at] + width
                    at += int(np.searchsorted(t[at:end], opens))
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def _exits(names: list[str], time: str, chunk: str, length: int, width: int):
    """For mapInArrow, over rows sorted by names (chunk among them), then time: (names, entry, until) of each chunk's possible entries.

    All entries of a chunk walk side by side, each with the time of its last row kept, so a chunk of any size takes the memory of
    its first cooldown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries, last, edge = None, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        kinds: pa.Schema | None = None

        def told() -> pa.RecordBatch:
            cells = [pa.array([v] * len(entries), kinds.field(c).type) for c, v in zip(names, key, strict=True)]
            return pa.record_batch([*cells, pa.array(entries), pa.array(last + width)], names=[*names, "entry", "until"])

        for batch in batches:
            kinds = batch.schema
            t = batch.column(time).to_numpy()
            for first, end in _segments(batch, names):
                now = [batch.column(c)[first].as_py() for c in names]
                if now != key:
                    if key is not None:
                        yield told()
                    key, entries, last = now, np.zeros(0, np.int64), np.zeros(0, np.int64)
                    edge = batch.column(chunk)[first].as_py() * length + width
                here = t[first:end]
                early = int(np.searchsorted(here, edge))
                fresh = np.unique(here[:early] if len(entries) and entries[-1] >= edge else here[: early + 1])
                fresh = fresh[fresh > entries[-1]] if len(entries) else fresh
                entries, last = np.concatenate([entries, fresh]), np.concatenate([last, fresh])
                walking = np.arange(len(entries))
                while len(walking):
                    at = np.searchsorted(here, last[walking] + width)
                    inside = at < len(here)
                    walking = walking[inside]
                    last[walking] = here[at[inside]]
        if key is not None:
            yield told()

    return run


def _equal(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    cond = F.lit(True)
    for a, b in pairs.items():
        cond &= left[a].eqNullSafe(right[b])
    return cond


def _entered(exits: DataFrame, key: str, chunk: str) -> DataFrame:
    """(key, chunk, entry) of the entries that are really taken, of all possible ones (key, chunk, entry, until)."""
    # the next entry: the first one of the chunk behind that isn't closed any more, else that of the first chunk after it
    asked = exits.select(key, (F.col(chunk) + 1).alias(chunk), F.col("until").alias("t"), F.lit(1).alias("asks"), "entry")
    offered = exits.select(key, chunk, F.col("entry").alias("t"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("entry"))
    down = Window.partitionBy(key, chunk).orderBy(F.desc("t"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    near = asked.unionByName(offered).withColumn("next", F.last(F.when(F.col("asks") == 0, F.col("t")), ignorenulls=True).over(down))
    near = near.where("asks = 1").select(F.col(key).alias("_key"), F.col("entry").alias("_entry"), "next")
    heads = exits.groupBy(key, chunk).agg(F.min("entry").alias("head"))
    on = Window.partitionBy(key).orderBy(chunk)  # a row a chunk
    behind = F.when(F.lead(chunk).over(on) == F.col(chunk) + 1, F.lead("head", 2).over(on)).otherwise(F.lead("head").over(on))
    heads = heads.withColumns({"behind": behind, "rank": F.row_number().over(on)})
    told = heads.select(F.col(key).alias("_of"), F.col(chunk).alias("_chunk"), "behind")
    links = exits.join(near, _equal(exits, near, {key: "_key", "entry": "_entry"}), "left")
    links = links.join(told, _equal(links, told, {key: "_of", chunk: "_chunk"}), "left")
    links = links.select(F.col(key).alias("_key"), F.col("entry").alias("_entry"), F.coalesce("next", "behind").alias("_next")).where("_next IS NOT NULL")
    rounds = (heads.agg(F.max("rank")).first()[0] or 1).bit_length()
    reached = heads.where("rank = 1").select(key, F.col("head").alias("entry"))
    jump = scratch.written(links)
    for r in range(rounds):  # reached: fewer than 2^r chunks on; jump: 2^r chunks on
        more = reached.join(jump, _equal(reached, jump, {key: "_key", "entry": "_entry"})).select(key, F.col("_next").alias("entry"))
        reached = scratch.written(reached.unionByName(more))
        if r + 1 < rounds:
            far = jump.select(F.col("_key").alias("_far"), F.col("_entry").alias("_at"), F.col("_next").alias("_to"))
            jump = scratch.written(jump.join(far, _equal(jump, far, {"_key": "_far", "_next": "_at"})).select("_key", "_entry", F.col("_to").alias("_next")))
    return reached


def cooled(df: DataFrame, key: str, cooldown: int, ts: str = "ts", tie: str | None = None, hot_rows: int = HOT_ROWS, cooldowns: int = COOLDOWNS) -> DataFrame:
    """Rows of df at least cooldown seconds after the last row kept of their key.

    Rows without ts are always kept and count for nothing; rows without a key are a key of their own; of rows at the same time the first by tie
    is looked at first. Keys with more than hot_rows rows are worked on in chunks of so many cooldowns, with the same result.
    df is written once, as it is counted before it is walked.
    """
    if cooldown <= 0:
        return df
    width, length = cooldown * 1_000_000, cooldown * 1_000_000 * max(cooldowns, 1)
    time, chunk, begin = (scratch.spare(c, df) for c in ("_time", "_chunk", "_begin"))
    rows = scratch.written(df)
    dated = rows.where(F.col(ts).isNotNull()).withColumn(time, S.micros(F.col(ts)))
    order = [time, *([tie] if tie else [])]
    busy = dated.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = scratch.written(busy.select(F.col(key).alias("_hot")))
    calm, kept = dated, rows.where(F.col(ts).isNull())
    if hot.limit(1).count():
        hot = scratch.small(hot)
        calm = dated.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left_anti")
        warm = dated.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left_semi").withColumn(chunk, F.floor(F.col(time) / length))
        warm = warm.withColumn(chunk, F.expr(f"`{time}` div {length}") - (F.col(time) % length < 0).cast("long"))
        dealt = warm.repartition(key, chunk).sortWithinPartitions(key, chunk, *order)
        kind = dict(warm.dtypes)[key]
        exits = scratch.written(dealt.select(key, chunk, time).mapInArrow(_exits([key, chunk], time, chunk, length, width), f"`{key}` {kind}, `{chunk}` long, entry long, until long"))
        entered = _entered(exits, key, chunk).select(F.col(key).alias("_hot"), F.expr(f"entry div {length}").alias("_at"), F.col("entry").alias(begin))
        entered = entered.withColumn("_at", F.expr(f"`{begin}` div {length}") - (F.col(begin) % length < 0).cast("long"))
        opened = warm.join(entered, F.col(key).eqNullSafe(F.col("_hot")) & (F.col(chunk) == F.col("_at"))).drop("_hot", "_at")
        opened = opened.repartition(key, chunk).sortWithinPartitions(key, chunk, *order)
        kept = kept.unionByName(opened.mapInArrow(_walk([key, chunk], time, width, begin), opened.schema).select(*df.columns))
    calm = calm.repartition(key).sortWithinPartitions(key, *order)
    return kept.unionByName(calm.mapInArrow(_walk([key], time, width), calm.schema).select(*df.columns))
