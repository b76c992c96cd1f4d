"""Token ids as packed matrices: best-fit decreasing with a segment tree over free room, in bounded batches."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, tidy
from .tokens import coder

CAPACITY = 2048


class Rooms:
    """How many open sequences have each free room; a segment tree finds the tightest room of at least some size."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest room of at least ``least``, which is then no longer open."""
        tree, i = self.tree, least + self.size
        while not tree[i]:
            while i & 1:  # right children are done; go up to the next subtree on the right
                i >>= 1
                if not i:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of lengths by sequence. Equal lengths keep their order."""
    rooms, out = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        room, k = found if found else (capacity, len(out))
        if not found:
            out.append([])
        out[k].append(i)
        rooms.put(room - lengths[i], k)
    return out


SCHEMA = "n_tokens int, id_bytes int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary, ids_crc32 long"
_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int64()]


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, batch_tokens: int = 1 << 22, tokenizer: str | None = None) -> DataFrame:
    """Rows of a packed id matrix from docs (doc_id, text).

    A document's ids (and a final id 0) are cut into pieces of capacity, without loss; a task packs about batch_tokens
    of pieces at a time, largest first, each into the tightest sequence that has room. ids: capacity unsigned little-endian
    ids of id_bytes each (2, or 4 if the vocabulary needs it), zeros at the end; cu_seqlens: 0 and the segments' cumulative lengths; position_resets: where positions
    start from 0 again; doc_ids and pieces: the segments' origin; ids_crc32 of all of ids. sequence_id is unique. No text and no
    ids are shuffled. Cases: null and empty texts are one segment of id 0; null doc_id is kept; repeated rows are packed each;
    an empty table gives no rows; more columns are left out.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def matrix(held, kind):
        rows = []
        for members in best_fit_decreasing([len(h[2]) for h in held], capacity):
            ids = np.zeros(capacity, kind)
            ends = np.cumsum([0, *(len(held[i][2]) for i in members)])
            for i, at in zip(members, ends, strict=False):
                ids[at : at + len(held[i][2])] = held[i][2]
            raw = ids.tobytes()
            rows.append((int(ends[-1]), kind.itemsize, [held[i][0] for i in members], [held[i][1] for i in members], ends.tolist(), ends[:-1].tolist(), raw, zlib.crc32(raw)))
        for at in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1024], strict=True), _TYPES, strict=True)], names=names)

    def run(batches):
        code, held, size = coder(tokenizer), [], 0
        kind = np.dtype("<u2" if code.largest < 1 << 16 else "<u4")
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(docs_), 256):
                for doc, raw in zip(docs_[lo : lo + 256], code.encode(texts[lo : lo + 256]), strict=True):
                    ids = np.frombuffer(raw + bytes(4), "<u4").astype(kind)
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        held.append((doc, k, ids[at : at + capacity]))
                    size += len(ids)
                if size > batch_tokens:
                    yield from matrix(held, kind)
                    held, size = [], 0
        if held:
            yield from matrix(held, kind)

    return lean(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidy(run), SCHEMA).withColumn("sequence_id", F.monotonically_increasing_id())


def write_matrix(packed: DataFrame, path: str) -> None:
    """The matrix as a Parquet table (Zstandard), in order of sequence_id within each file; an empty one gives an empty table."""
    packed.sortWithinPartitions("sequence_id").write.option("compression", "zstd").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """Segments (doc_id, piece, ids as bytes, id_bytes each) back from the matrix."""
    segment = F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("pieces").alias("piece"), F.col("position_resets").alias("at"), F.slice("cu_seqlens", F.lit(2), F.size("pieces")).alias("stop"))
    rows = packed.select("ids", F.col("id_bytes").alias("w"), F.inline(segment))
    return rows.select("doc_id", "piece", F.expr("substring(ids, w * at + 1, w * (stop - at))").alias("ids"))


def op8_token_id_output(spark, sf_dir: str) -> DataFrame:
    return packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
