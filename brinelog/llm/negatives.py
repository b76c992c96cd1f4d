"""Hard negatives by distributed radix selection.

A window is an anchor, a range of scores and a number k of rows wanted from its top: first each anchor's positives (any score,
same label), then, for each anchor and positive, rows of other labels whose score is a given share of the positive's. Nothing is
sorted to find a window's k-th row. Each task counts scores into 2^BITS equal steps of the window; Spark adds the counts up, the
bucket with the k-th row is cut into steps again, until it is one score wide or ends just at the k-th row. If more rows than
wanted tie at that score, the same is done with bits of their ids. Then one pass gathers the rows that qualify, k a window.

Scores are worked on in blocks of a grid: rows are dealt to cells, anchors to groups, each cell meets each group in one task, as
matrices. Rows are copied once a group, anchors once a cell; both are bounded (CELL, GROUP), and copies of one vector are spread
over cells like any others. A task reports no more than the buckets with its own first k rows, since what lies below them is
below the k-th row of all, so k counts a window and cell are shuffled at most. Scoring all rows against all anchors is what is
asked for: rows / 100 anchors make that work quadratic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

#: A window is cut into 2^BITS steps at a time, and as many bits of ids are looked at together.
BITS = 9
#: Most rows of a cell and anchors of a group; small tables are cut finer, into at most PARTS cells of at least LEAST rows.
CELL, GROUP, LEAST, PARTS = 65_536, 65_536, 2048, 64
#: Rows and anchors that are multiplied together.
ROWS, ANCHORS = 2048, 128
LAST = (1 << 63) - 1

#: A window's state: rows are wanted from high down to low, need of them; those over high are taken. Below wide bits of
#: ids, from first_id on, rows of score low are told apart (tie) where not all are wanted. done: all rows over low are taken, and those of low up to id last_id.
STATE = "top long, high long, low long, need long, tie boolean, first_id long, wide int, done boolean, last_id long"
STATES = [c.split()[0] for c in STATE.split(", ")]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of 64-bit integers; components that a vector lacks are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point only where every sum stays under 2^53."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class _Block:
    """Anchors of a group with their windows, as arrays. Windows are numbered through; ``of`` is a window's anchor in the block."""

    def __init__(self, table: pa.Table, dims: int):
        self.x = _matrix(table["asking"], dims)
        self.row, self.label = (table[c].to_numpy() for c in ("anchor", "own"))
        windows = table["windows"].combine_chunks()
        self.of = pc.list_parent_indices(windows).to_numpy()
        flat = windows.flatten()
        self.state = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _met(rows: pa.Table, anchors: pa.Table, dims: int, positives: bool, see: Callable, close: Callable) -> list[dict]:
    """Every slice of anchors against every slice of rows: see(block, scores, allowed, ids, at) each time, close(block) once a block."""
    out = []
    x, row, label, ids = _matrix(rows["vector"], dims), *(rows[c].to_numpy() for c in ("row", "label", "id"))
    for first in range(0, anchors.num_rows, ANCHORS):
        block = _Block(anchors.slice(first, ANCHORS), dims)
        for at in range(0, len(x), ROWS):
            part = slice(at, at + ROWS)
            same = block.label[:, None] == label[None, part]
            allowed = same & (block.row[:, None] != row[None, part]) if positives else ~same
            see(block, _products(block.x, x[part]), allowed, ids[part], row[part])
        out.append(close(block))
    return out


def _counting(dims: int, positives: bool, buckets: int, bits: int):
    """For cogroup().applyInArrow: (anchor, place, bucket, n) of a cell, down to the bucket with its own k-th row."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        counts: list[np.ndarray] = []

        def see(block: _Block, scores, allowed, ids, row) -> None:
            if not counts:
                counts.append(np.zeros(len(block.of) * buckets, np.int64))
            s = block.state
            here, ok = scores[block.of], allowed[block.of]
            w, r = np.nonzero(ok & (here <= s["high"][:, None]) & (here >= s["low"][:, None]))
            low, high, tie = s["low"][w], s["high"][w], s["tie"][w]
            step = (high - low) // buckets + 1
            bucket = (high - here[w, r]) // step
            if tie.any():
                shift = np.minimum(np.maximum(s["wide"][w] - bits, 0), 63).astype(np.int64)
                from_id = s["first_id"][w]
                of_id = (ids[r] >> shift) - (from_id >> shift)
                inside = ~tie | ((of_id >= 0) & (of_id < buckets))
                w, bucket = w[inside], np.where(tie, of_id, bucket)[inside]
            counts[0] += np.bincount(w * buckets + bucket, minlength=len(counts[0]))

        def close(block: _Block) -> dict:
            n = counts.pop().reshape(-1, buckets) if counts else np.zeros((len(block.of), buckets), np.int64)
            before = np.cumsum(n, axis=1) - n
            w, bucket = np.nonzero((n > 0) & (before < block.state["need"][:, None]))
            return {"anchor": block.row[block.of[w]], "place": block.state["place"][w], "bucket": bucket, "n": n[w, bucket]}

        return _table(_met(rows, anchors, dims, positives, see, close), {"anchor": pa.int64(), "place": pa.int32(), "bucket": pa.int32(), "n": pa.int64()})

    return run


def _gathering(dims: int, positives: bool, k: int):
    """For cogroup().applyInArrow: (anchor, place, score, id, row) of a cell's rows that qualify; of rows equal in both, k a window at most."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []

        def see(block: _Block, scores, allowed, ids, row) -> None:
            s = block.state
            here, ok = scores[block.of], allowed[block.of]
            w, r = np.nonzero(ok & (here <= s["top"][:, None]) & (here >= s["low"][:, None]))
            good = (here[w, r] > s["low"][w]) | (ids[r] <= s["last_id"][w])
            w, r = w[good], r[good]
            found.append([w, here[w, r], ids[r], row[r]])

        def close(block: _Block) -> dict:
            w, score, id, row = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
            found.clear()
            order = np.lexsort((row, id, -score, w))
            w, score, id, row = w[order], score[order], id[order], row[order]
            nth = np.arange(len(w)) - np.searchsorted(w, w, side="left")
            w, score, id, row = (c[nth < k] for c in (w, score, id, row))
            return {"anchor": block.row[block.of[w]], "place": block.state["place"][w], "score": score, "id": id, "row": row}

        return _table(_met(rows, anchors, dims, positives, see, close), {"anchor": pa.int64(), "place": pa.int32(), "score": pa.int64(), "id": pa.int64(), "row": pa.int64()})

    return run


def _table(parts: list[dict], kinds: dict) -> pa.Table:
    return pa.table({c: pa.array(np.concatenate([p[c] for p in parts]) if parts else [], t) for c, t in kinds.items()})


class Grid:
    """All rows against all anchors. rows: a stored table (row, id, label, vector); anchors: those of them that ask."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, dims: int, ids: tuple[int, int], bits: int = BITS):
        self.bits, self.buckets = bits, 1 << bits
        self.rows, self.anchors, self.dims = rows, anchors, dims
        self.cells = max(-(-n // CELL), min(-(-n // LEAST), PARTS))
        self.groups = -(-n_anchors // GROUP)
        apart = (ids[0] ^ ids[1]) & ((1 << 64) - 1)
        self.wide = apart.bit_length()
        self.first_id = -(1 << 63) if self.wide == 64 else (ids[0] >> self.wide) << self.wide

    def met(self, windows: DataFrame, run: Callable, schema: str) -> DataFrame:
        """run over each cell and group. windows: (anchor, place, STATE)."""
        asked = windows.groupBy("anchor").agg(F.collect_list(F.struct("place", *STATES)).alias("windows"))  # few an anchor
        right = self.anchors.join(asked, F.col("row") == F.col("anchor")).select("anchor", F.col("label").alias("own"), F.col("vector").alias("asking"), "windows")
        right = right.withColumn("_group", F.pmod(F.xxhash64("anchor"), F.lit(self.groups)).cast("int")).withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(self.cells - 1))))
        left = self.rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(self.cells)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        tasks = self.cells * self.groups  # a number of its own, since the work isn't seen in bytes
        left = left.repartition(tasks, "cell", "group").groupBy("cell", "group")
        right = right.repartition(tasks, "_cell", "_group").groupBy("_cell", "_group")
        return left.cogroup(right).applyInArrow(run, schema)

    def select(self, windows: DataFrame, k: int, positives: bool) -> DataFrame:
        """(anchor, place, score, id, row) of the first k rows of each window (anchor, place, low, high), by score down, then id."""
        now = windows.select("anchor", "place", F.col("high").alias("top"), "high", "low", F.lit(k).cast("long").alias("need"), F.lit(False).alias("tie"), F.lit(self.first_id).cast("long").alias("first_id"), F.lit(self.wide).alias("wide"), F.lit(False).alias("done"), F.lit(LAST).alias("last_id"))
        now = common.stored(now, "windows")
        over = []
        while now.where("NOT done").limit(1).count():
            over.append(now.where("done"))
            now = common.stored(self._finer(now.where("NOT done"), positives), "windows")
        for part in over:
            now = now.unionByName(part)
        return self.met(now, _gathering(self.dims, positives, k), "anchor long, place int, score long, id long, row long")

    def _finer(self, now: DataFrame, positives: bool) -> DataFrame:
        """Windows cut down to the bucket that has their last wanted row; done where the bucket can be taken whole or isn't there."""
        counts = self.met(now, _counting(self.dims, positives, self.buckets, self.bits), "anchor long, place int, bucket int, n long").groupBy("anchor", "place", "bucket").agg(F.sum("n").alias("n"))
        per = counts.groupBy("anchor", "place").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts"))  # as many as buckets a window at most
        both = now.join(per.withColumnsRenamed({"anchor": "_anchor", "place": "_place"}), (F.col("anchor") == F.col("_anchor")) & (F.col("place") == F.col("_place")), "left")
        start = F.struct(F.lit(-1).alias("bucket"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("n"))

        def walk(acc: Column, x: Column) -> Column:
            return F.when(acc["before"] + acc["n"] >= F.col("need"), acc).otherwise(F.struct(x["bucket"].alias("bucket"), (acc["before"] + acc["n"]).alias("before"), x["n"].alias("n")))

        both = both.withColumn("_at", F.aggregate(F.coalesce("counts", F.array().cast("array<struct<bucket:int,n:bigint>>")), start, walk))
        enough = F.col("_at.before") + F.col("_at.n") >= F.col("need")
        bucket, need = F.col("_at.bucket").cast("long"), F.col("need") - F.col("_at.before")
        step = F.expr(f"(high - low) div {self.buckets}") + 1
        high = F.col("high") - bucket * step
        low = F.greatest(high - step + 1, F.col("low"))
        whole = need == F.col("_at.n")
        bits = F.greatest(F.col("wide") - self.bits, F.lit(0))
        first_id = F.call_function("shiftleft", F.call_function("shiftright", "first_id", bits) + bucket, bits)
        last_id = first_id.bitwiseOR(F.when(bits > 0, F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - bits)).otherwise(F.lit(0).cast("long")))
        by_score = F.struct(high.alias("high"), low.alias("low"), need.alias("need"), (low == high).alias("tie"), F.col("first_id"), F.col("wide"), whole.alias("done"), F.lit(LAST).alias("last_id"))
        by_id = F.struct(F.col("high"), F.col("low"), need.alias("need"), F.lit(True).alias("tie"), first_id.alias("first_id"), bits.alias("wide"), (whole | (bits == 0)).alias("done"), last_id.alias("last_id"))
        none = F.struct(F.col("high"), F.col("low"), F.col("need"), F.col("tie"), F.col("first_id"), F.col("wide"), F.lit(True).alias("done"), F.lit(LAST).alias("last_id"))
        new = both.withColumn("_new", F.when(~enough, none).when(F.col("tie"), by_id).otherwise(by_score))
        return new.select("anchor", "place", "top", *[F.col(f"_new.{c}").alias(c) for c in STATES if c != "top"])


def _share(score: Column, percent: int, up: bool) -> Column:
    """score * percent / 100, rounded to a whole number up or down."""
    x = score * (-percent if up else percent)
    down = F.floor(x / F.lit(100).cast("decimal(3,0)")).cast("long")
    return -down if up else down


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id: str = "vec_id", vector: str = "embedding", label: str = "label", bits: int = BITS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive of df the first negatives.

    Anchors are rows whose id is divisible by every. A row's score is the inner product with the anchor of components floor(256 * x)
    (see vectors.whole; components that one of two vectors lacks count as 0). An anchor's positives are the first other
    rows of its label; negatives are the first rows of another label with a score of least to most percent of the positive's,
    both included. First means by score down, then id up, rows without id last. For a positive score below 0 there are none.

    Rows with a null label, a null vector or a null or non-finite component take no part. Repeated rows are rows like any
    other: a repeated anchor asks once a row, and a copy of the anchor may be its positive. Other columns are left out. An id
    of 2^63 - 1 can't be told from none.
    """
    most_size = df.agg(F.max(F.size(vector)).alias("n")).first().n or 0
    dims = max(most_size, 1)
    shown = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    named = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("given"))
    rows = named.where(F.col("label").isNotNull() & vectors.finite("given")).select(F.monotonically_increasing_id().alias("row"), "id", "label", vectors.whole("given", dims).alias("vector"))
    rows = common.stored(rows, "vectors")  # row numbers must stay as they are
    asks = F.coalesce(F.col("id") % every == 0, F.lit(False))
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("anchors"), F.max(square).alias("reach"), F.min("id").alias("first"), F.max("id").alias("last")).first()
    if not told.anchors:
        return df.sparkSession.createDataFrame([], shown)
    none = min(told.last + 1, LAST)  # the id of rows without one, behind all others
    rows = rows.select("row", F.coalesce("id", F.lit(none)).alias("id"), "label", "vector", asks.alias("asks"))
    anchors = rows.where("asks").drop("asks")
    grid = Grid(rows.drop("asks"), anchors, told.n, told.anchors, dims, (told.first, none), bits)
    whole = anchors.select(F.col("row").alias("anchor"), F.lit(0).alias("place"), F.lit(-told.reach).cast("long").alias("low"), F.lit(told.reach).cast("long").alias("high"))
    found = _first(grid.select(whole, positives, True), positives).select("anchor", F.col("nth").alias("place"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    found = common.stored(found, "positives")
    windows = found.select("anchor", "place", _share(F.col("positive_score"), least, True).alias("low"), _share(F.col("positive_score"), most, False).alias("high")).where("low <= high")
    chosen = _first(grid.select(windows, negatives, False), negatives)
    chosen = chosen.select("anchor", "place", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = chosen.join(found, ["anchor", "place"]).join(named, "anchor")
    shown_id = lambda c: F.when(F.col(c) != none, F.col(c)).alias(c)
    return out.select("anchor_id", shown_id("positive_id"), "rank", shown_id("negative_id"), "positive_score", "negative_score")


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window, numbered from 1. What was gathered is k rows a window, but for copies equal in id and score."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def relabelled(df: DataFrame) -> DataFrame:
    """The contract's noise: the label of every seventh id is moved on by one."""
    return df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


OP13_SQL = """WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score FROM k a JOIN k r ON a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
   FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
 SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
