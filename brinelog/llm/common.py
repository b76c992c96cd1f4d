"""Shared building blocks: scratch tables, checked broadcasts, ranks without a single-task window."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of at most this many narrow rows may be broadcast; its rows are counted first.
BROADCAST_ROWS = 100_000
#: Texts of an Arrow batch.
TEXTS = 1000
#: What a word is, everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a temporary one where it is unset, in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def lean(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most TEXTS rows from here on, unless the session has a setting of its own: whole texts are in them."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":  # Spark's default
        conf.set(key, str(TEXTS))
    return df


_LAST = [0.0]


def trim(seconds: float = 0.5) -> None:
    """Give free memory of this Python worker back to the machine, if that is so long ago; workers live on and share an executor's memory with its JVM."""
    now = time.monotonic()
    if now - _LAST[0] < seconds:
        return
    _LAST[0] = now
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """run, a function for mapInArrow, that trims its worker now and then and when its input ends."""

    def wrapped(batches):
        try:
            for batch in run(batches):
                yield batch
                trim()
        finally:
            trim(0)

    return wrapped


def spare(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores before it as it takes to be no column of frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: the lineage ends here and lost executors lose nothing. options: the writer's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(df: DataFrame, settled: bool = False) -> DataFrame:
    """df, a stored table; shuffle files that led to it and that nothing refers to any longer are given back, as Spark does on a collection only.

    settled: wait until Spark's listeners, which hold a query for a moment after its end, have let go of it; else its files may stay until the next call.
    """
    for pause in (0.5, 0.5) if settled else (0,):
        time.sleep(pause)
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return df


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows (counted), else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of both sides' keys."""
    cond = F.lit(True)
    for k in keys:
        cond &= left[k].eqNullSafe(right[k])
    return cond


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """df with ``rank`` (long, from 0) by order within its group, and (group, n) with each group's size.

    Rows are dealt by range over group and order, so a group with a third of all rows spreads over many tasks; each
    task numbers its rows, and sums of counts per (task, group) turn these into ranks. The dealt rows are written
    once because the numbers must not change between the two reads. df should be cheap to read twice, as range
    bounds are sampled first. A column rank in df is replaced; group columns must not be named _n or _first.
    """
    task, at, run, before = (spare(c, df) for c in ("_task", "_at", "_run", "_before"))
    keys = [F.col(k).asc_nulls_last() for k in group]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stored(dealt.withColumn(task, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = rows.groupBy(task, *group).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    w = Window.partitionBy(*group).orderBy(task)
    runs = counts.withColumn(before, F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first"))
    own = {k: spare(f"_{k}", df) for k in group}
    runs = small(runs.select(*[F.col(k).alias(x) for k, x in own.items()], F.col(task).alias(run), before))
    cond = F.col(task) == F.col(run)
    for k, x in own.items():
        cond &= F.col(k).eqNullSafe(F.col(x))
    out = rows.join(runs, cond).withColumn("rank", F.col(at) + F.col(before)).select(*[c for c in df.columns if c != "rank"], "rank")
    return out, counts.groupBy(*group).agg(F.sum("_n").alias("n"))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
