"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by normalised bit overlap."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, tidy
from .words import BLOCK, mix

WINDOW = 16
SPAN = 32
POPULAR = 8
#: Texts of fewer windows keep every window that is the rarest of any SPAN (of fewer than SPAN: of any SHORT) successive ones.
FEW = 8 * SPAN
SHORT = 8
BITS = 2048
PER_FILTER = 160
HASHES = 5
_FINE = 64  # fixed-point steps of c * log2(c)
_BINS = int(WINDOW * np.log2(WINDOW) * _FINE) // 16 + 1
_CLOG = np.array([0, *(round(c * np.log2(c) * _FINE) for c in range(1, WINDOW + 1))], np.int32)
_GAIN = np.concatenate([[0], np.diff(_CLOG)]).astype(np.int32)
#: Windows of less than a bit of entropy per byte (runs of one or two bytes) make no feature.
_DULL = int((np.log2(WINDOW) - 1.0) * WINDOW * _FINE) // 16


def concentration(data: np.ndarray) -> np.ndarray:
    """For each window of data: sum of c * log2(c) over its bytes' counts c, in bins; entropy is log2(WINDOW) less its share.

    Windows move by one byte; how often the byte that leaves or enters occurs in the window tells how the sum changes.
    """
    before, after = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for lag in range(1, WINDOW):
        equal = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += equal
        after[:-lag] += equal
    first = _CLOG[np.bincount(data[:WINDOW], minlength=256)].sum()
    change = _GAIN[before[WINDOW:]] - _GAIN[after[: len(data) - WINDOW]]
    return (np.concatenate([[0], np.cumsum(change)]) + first) // 16


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows within a text fall in each bin."""
    total = np.zeros(_BINS, np.int64)
    for group in _groups(texts):
        data, _, inside, _ = _joined(group)
        if inside.any():
            total += np.bincount(concentration(data)[inside], minlength=_BINS)
    return total


def _groups(texts: list[bytes]):
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _joined(texts: list[bytes]):
    """All bytes (zeros at the end, for a window and a span), where texts begin, which windows lie within a text, and each one's text."""
    begin = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts) + bytes(WINDOW + SPAN), np.uint8)
    n = len(data) - WINDOW + 1
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    owner = np.concatenate([owner, np.full(n - len(owner), len(texts))])[:n]
    inside = np.arange(n) + WINDOW <= begin[np.minimum(owner + 1, len(texts))]
    inside &= owner < len(texts)
    return data, begin, inside, owner


def features(texts: list[bytes], rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of selected windows in order: those that are the leftmost rarest of SPAN successive ones at least POPULAR times.

    See FEW and SHORT for short texts; a text without any fit window, but not empty, gives itself as its one feature.
    """
    data, begin, inside, owner = _joined(texts)
    n = len(inside)
    keep = np.zeros(n, bool)
    if inside.any():
        bins = concentration(data)
        rank = np.where(inside & (bins < _DULL), rarity[bins], 1 << 20)
        low = (rank.astype(np.int64) << 40) + np.arange(n)
        spans = low.copy()
        for k in (1, 2, 4, 8, 16):
            spans[:-k] = np.minimum(spans[:-k], spans[k:])
        whole = inside.copy()
        whole[: n - SPAN + 1] &= inside[SPAN - 1 :] & (owner[: n - SPAN + 1] == owner[SPAN - 1 :])
        whole[max(0, n - SPAN + 1) :] = False
        best = spans[whole]
        best = best[best >> 40 < 1 << 20] & ((1 << 40) - 1)
        windows = np.diff(begin) - WINDOW + 1
        keep = np.bincount(best, minlength=n) >= np.where(np.append(windows, 0)[owner] < FEW, 1, POPULAR)
    chosen = np.flatnonzero(keep)
    words = data[chosen[:, None] + np.arange(WINDOW)].view(np.uint64) if len(chosen) else np.zeros((0, WINDOW // 8), np.uint64)
    hashes = np.zeros(len(chosen), np.uint64)
    for k in range(WINDOW // 8):
        hashes = mix(hashes ^ (words[:, k] + np.uint64(k + 1)))
    doc = owner[chosen]
    bare = np.setdiff1d(np.flatnonzero(np.diff(begin)), doc)
    if len(bare):
        extra = []
        for i in bare.tolist():
            own = np.arange(begin[i], max(begin[i], begin[i + 1] - WINDOW + 1))
            own = own[rank[own] < 1 << 20] if len(own) else own
            lows = [own[k + int(np.argmin(rank[own[k : k + SHORT]]))] for k in range(max(1, len(own) - SHORT + 1))] if len(own) else []
            parts = [data[at : at + WINDOW].tobytes() for at in dict.fromkeys(lows)] or [texts[i]]
            extra += [(i, int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little")) for p in parts]
        doc, hashes = np.concatenate([doc, np.array([i for i, _ in extra])]), np.concatenate([hashes, np.array([h for _, h in extra], np.uint64)])
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    once = np.sort(order[fresh])  # a repeated window counts where it stands first, as far as order within a text goes
    once = once[np.argsort(doc[once], kind="stable")]
    return doc[once], hashes[once]


def filters(texts: list[bytes], rarity: np.ndarray) -> list[np.ndarray]:
    """Each text's Bloom filters, one per PER_FILTER features, as rows of BITS / 8 bytes."""
    out: list[np.ndarray] = []
    for group in _groups(texts):
        doc, hashes = features(group, rarity)
        counts = np.bincount(doc, minlength=len(group))
        chain = np.cumsum([0, *-(-counts // PER_FILTER)])
        place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        row = chain[doc] + place // PER_FILTER
        bits = np.zeros((int(chain[-1]), BITS), np.uint8)
        for k in range(HASHES):
            bits[row, (hashes >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = 1
        packed = np.packbits(bits, axis=1)
        out += [packed[a:b] for a, b in zip(chain[:-1], chain[1:], strict=True)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain its best overlap in the other, less what chance gives; their mean.

    Equal chains (two empty ones too) give 1; an empty and another one 0.
    """
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    both = np.array([np.bitwise_count(b & x).sum(1, dtype=np.int64) for x in a])
    most = np.minimum(na[:, None], nb[None])
    least = np.maximum(0.3 * most, na[:, None] * nb[None] / BITS)
    score = (both - least) / np.maximum(most - least, 1e-9)
    return float(np.clip(score, 0, 1).max(1).mean())


def rarity_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each bin, rarest first, from all windows of all texts. _BINS sums reach the driver."""

    def count(batches):
        total = np.zeros(_BINS, np.int64)
        for batch in batches:
            total += histogram([t or b"" for t in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BINS)), pa.array(total)], names=["bin", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(tidy(count), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(_BINS, np.int64)
    for r in rows:
        n[r["bin"]] = r["n"]
    ranks = np.empty(_BINS, np.int64)
    ranks[np.lexsort((np.arange(_BINS), n))] = np.arange(_BINS)
    return ranks


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half comes from the next document's beginning.

    The next document: by descending doc_id, nulls last, equal ids by text; after the last comes the first. Ranges of
    doc_id, cut at ids that occur, are dealt to tasks; the row at a cut is also sent to the range before it, so each task
    finds every next document in its own sorted stream, and texts are shuffled once. Cases: null text is empty;
    an empty text has an empty fingerprint; one document is its own next; repeated rows are kept; an empty table
    gives no rows; more columns are left out.
    """
    spark = docs.sparkSession
    ranks = rarity_ranks(lean(docs))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = docs.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts).alias("cuts")).first()
    cuts = np.unique(np.array(shape["cuts"] or [], np.int64))

    @F.arrow_udf("long")
    def place(ids: pa.Array) -> pa.Array:
        """Twice the number of cuts from the id on, and one more for the id of a cut itself."""
        known = np.asarray(ids.is_valid())
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(cuts, x)
        hit = np.isin(x, cuts)
        return pa.array(np.where(known, 2 * (len(cuts) - at) + hit, 2 * len(cuts)))

    where = F.struct((F.shiftright("_place", 1)).cast("long").alias("b"), F.lit(0).alias("tail"))
    before = F.struct((F.shiftright("_place", 1) - 1).cast("long").alias("b"), F.lit(1).alias("tail"))
    wrap = F.struct(F.lit(len(cuts)).cast("long").alias("b"), F.lit(2).alias("tail"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_place", place("doc_id"))
    every = F.filter(F.array(where, F.when(F.col("_place") % 2 == 1, before), F.when(F.col("doc_id").eqNullSafe(F.lit(shape["top"])), wrap)), lambda x: x.isNotNull())
    dealt = rows.select("doc_id", "text", F.inline(every)).repartition(parts, "b").sortWithinPartitions("b", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())

    def pairs(batches):
        held = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                row = (row[0], row[1] or "", *row[2:])
                if held and held[2] == row[2] and not held[3]:
                    yield held[0], held[1], row[1]
                held = row

    def work(batches):
        group, size = [], 0
        for pair in pairs(batches):
            group.append(pair)
            size += len(pair[1])
            if size > 4 * BLOCK:
                yield score(group)
                group, size = [], 0
        if group:
            yield score(group)

    def score(group):
        texts = [t for _, t, _ in group]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, after in group]
        raw = [e.encode() for e in edited]
        last = group[-1][2]
        own = filters([*(t.encode() for t in texts), last.encode()], ranks)
        index = [i + 1 for i in range(len(group))]
        fresh = {i: after for i, (_, _, after) in enumerate(group[:-1]) if after != texts[i + 1]}  # where another range begins
        other = dict(zip(fresh, filters([t.encode() for t in fresh.values()], ranks), strict=True))
        new = filters(raw, ranks)
        columns = (
            [d for d, _, _ in group], [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in raw],
            [f.tobytes().hex() for f in own[:-1]], [f.tobytes().hex() for f in new],
            [likeness(a, b) for a, b in zip(own, new, strict=False)], [likeness(own[i], other[i] if i in other else own[k]) for i, k in enumerate(index)],
        )
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt.mapInArrow(tidy(work), SCHEMA)


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
