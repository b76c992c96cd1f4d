"""Packing all documents into as few sequences as possible: dominance reduction, then best fit, on counts by length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ranked, stored, tidy
from .tokens import coder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Token pieces of (doc_id, text): ids of the whole text, then id 0, cut only where longer than capacity."""

    def cut(batches):
        code = coder(tokenizer)
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [[], [], [], [], []]
            for lo in range(0, len(ids), 256):  # the words of a whole batch at once would take hundreds of MB
                for doc, raw in zip(ids[lo : lo + 256], code.encode(texts[lo : lo + 256]), strict=True):
                    raw += bytes(4)
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return lean(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidy(cut), PIECES)


Pattern = tuple[tuple[int, int], ...]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix sets of lengths that provably dominate all others holding their longest member; counts keeps the rest.

    For the longest length w and what is left of a sequence beside it, rest = capacity - w:
    nothing else fits: {w}. One piece fills rest exactly: {w, rest}, as all that could stand beside w could stand in
    that piece's place. At most one more piece fits: {w, longest that fits}. At most two fit: {w, longest that fits}
    if no two sum to more than it; {w, a, b} with a the longest that fits and b the longest beside it, if no fitting pair
    has a shorter member over b. Pieces that are fixed only take others away, so what held for one such set holds for as many as
    there are: they are fixed in bulk, and the steps don't grow with the number of pieces.
    """
    fixed: list[tuple[Pattern, int]] = []
    lengths = sorted(k for k, n in counts.items() if n)

    def take(members: list[int], times: int) -> None:
        group: dict[int, int] = defaultdict(int)
        for m in members:
            group[m] += 1
        fixed.append((tuple(group.items()), times))
        for m, c in group.items():
            counts[m] -= c * times
            if not counts[m]:
                del counts[m]
                lengths.pop(bisect_left(lengths, m))

    def smallest(but: int, k: int) -> list[int]:
        """The k shortest pieces, one piece of length but aside."""
        out: list[int] = []
        for m in lengths:
            out += [m] * min(k - len(out), counts[m] - (m == but))
            if len(out) == k:
                break
        return out

    def longest(limit: int, *used: int) -> int | None:
        for i in range(bisect_left(lengths, limit + 1) - 1, -1, -1):
            if counts[lengths[i]] > used.count(lengths[i]):
                return lengths[i]
        return None

    def times(*members: int) -> int:
        return min(counts[m] // members.count(m) for m in members)

    for w in sorted(lengths, reverse=True):
        rest = capacity - w
        while counts.get(w):
            first = longest(rest, w)
            if first is None:
                take([w], counts[w])
                continue
            low = smallest(w, 3)
            if first == rest or len(low) < 2 or low[0] + low[1] > rest:
                take([w, first], times(w, first))
                continue
            if len(low) == 3 and sum(low) <= rest:
                break
            best = inner = 0
            for y in lengths:
                if 2 * y > rest:
                    break
                x = longest(rest - y, w, y)
                if x is not None and x >= y:
                    best, inner = max(best, x + y), y
            if first >= best:
                take([w, first], times(w, first))
                continue
            second = longest(min(first, rest - first), w, first)
            if second is None or second < inner:
                break
            take([w, first, second], times(w, first, second))
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts by length; sequences with equal contents are handled as one."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append((pattern, n))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                put(capacity - each * w, ((w, each),), n // each)
                if n % each:
                    put(capacity - n % each * w, ((w, n % each),), 1)
                break
            room = rooms[at]
            pattern, bins = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
            each = min(room // w, n)
            used = min(bins, n // each)
            put(room - each * w, (*pattern, (w, each)), used)
            put(room, pattern, bins - used)
            n -= used * each
    return [x for group in open_bins.values() for x in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns ((length, how many), ...) and how many sequences follow each."""
    left = {k: n for k, n in counts.items() if n}
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Runs of ranks within a length: from which rank, how many in each sequence, first sequence and offset there."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * n
            offset += each * length
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T.copy(), strict=True))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (length, doc_id, piece and any more columns, length from 1 to capacity) with sequence_id and offset.

    Only the number of pieces of each length reaches the driver: capacity numbers at most, whatever the corpus. There a
    plan is made for these counts; every piece then finds its place from its rank among the pieces of its length.
    Cases: null doc_id sorts last; repeated rows are packed each on its own; an empty table gives an empty one; columns of
    items named rank, sequence_id or offset are replaced.
    """
    items = items.drop("rank", "sequence_id", "offset")
    rows, sizes = ranked(items, ["length"], [F.col("doc_id").asc_nulls_last(), F.col("piece").asc_nulls_last()], "pack")
    at = places(plan({r["length"]: r["n"] for r in sizes.collect()}, capacity))
    keys = at["length"] << 40 | at["rank"]
    names = items.columns

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            run = np.searchsorted(keys, length << 40 | rank, "right") - 1
            step = rank - at["rank"][run]
            each = at["each"][run]
            new = {"sequence_id": at["sequence"][run] + step // each, "offset": at["offset"][run] + step % each * length}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, new.values())], names=[*names, *new])

    return rows.mapInArrow(tidy(place), rows.select(*items.columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text) with sequence_id and offset. Null and empty texts are one piece with id 0 alone."""
    return pack(stored(pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
