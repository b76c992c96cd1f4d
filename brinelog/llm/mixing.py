"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ranked, small, spare, stored

#: Expected copies are fixed-point numbers of this scale, so that prefix sums are exact and reruns agree.
SCALE = 1 << 24


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, n_docs, source_size, weight, target) from (source, size) rows.

    Sources by code point, null last, take the weights in turn. The mix takes share times all sizes; a target above
    cap times its source's size stops there and its excess is shared again by weight: with sources ordered by the
    level at which each stops, the stopped ones are a prefix, and one level holds for the rest. A source without words
    has target 0. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place % len(weights) + 1)
    rows = totals.withColumn("place", place).withColumn("weight", weight).withColumn("stop", F.col("source_size") * cap)
    by_stop = Window.orderBy((F.col("stop") / F.col("weight")).asc(), F.col("place").asc())
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("stopped", F.col("level") >= F.col("stop") / F.col("weight"))
    first = F.min(F.when(~F.col("stopped"), F.struct(F.col("stop") / F.col("weight"), "place", "level"))).over(everything)
    target = F.when(F.col("stopped"), F.col("stop").cast("double")).otherwise(first["level"] * F.col("weight"))
    return rows.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """docs (doc_id, source, size and any more columns) with source_size, target and copies.

    Systematic sampling: within its source each document expects target / source_size copies; documents stand in
    order of size (then doc_id), their expected copies are summed up, one random offset per source (from a hash of seed
    and source) is added, and a document is taken once per integer boundary that its interval crosses. By the order,
    a source's taken words miss its target by about one document at most. With cap 2 no document is taken more than twice.

    Cases: null source is a source of its own, ordered last; null size counts as 0; null doc_id sorts last; repeated
    rows are taken each on its own; an empty table gives an empty one; columns named rank, copies, target, source_size,
    weight or n_docs in docs are replaced. Ranks within a source come from rows dealt by range, so a source with a
    third of all rows is spread over many tasks.
    """
    docs = docs.drop("rank", "copies", "target", "source_size", "weight", "n_docs").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    targets = source_targets(docs, weights, share, cap)
    rate = F.coalesce(F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size")) * SCALE + 0.5), F.lit(cap * SCALE)), F.lit(0)).cast("long")
    name = F.concat(F.lit(seed), F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))))
    offset = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % SCALE
    source_, rate_, offset_ = (spare(c, docs) for c in ("_source", "_rate", "_offset"))
    targets = small(targets.select(F.col("source").alias(source_), "source_size", "target", rate.alias(rate_), offset.alias(offset_)))
    placed, _ = ranked(docs, ["source"], [F.col("size").desc(), F.col("doc_id").asc_nulls_last()], "mix")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col(source_)))
    copies = F.expr(f"(((rank + 1) * {rate_} + {offset_}) div {SCALE}) - ((rank * {rate_} + {offset_}) div {SCALE})")
    return joined.withColumn("copies", copies).drop("rank", source_, rate_, offset_)


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1 in a column copy, which replaces one of that name."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken, and source and copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    return mix_sources(sizes).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS stop FROM p),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(stop) OVER (ORDER BY stop / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / CAST(sum(weight) OVER (ORDER BY stop / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
m AS (SELECT arg_min(level, place) AS level FROM l WHERE level < stop / weight AND stop / weight = (SELECT min(stop / weight) FROM l WHERE level < stop / weight)),
t AS (SELECT source, source_size, CASE WHEN level >= stop / weight THEN CAST(stop AS DOUBLE) ELSE (SELECT level FROM m) * weight END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size * 16777216 + 0.5) AS BIGINT), 33554432) END AS rate,
        CAST('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN '0' ELSE '1' || source END), 1, 8) AS BIGINT) % 16777216 AS shift FROM t),
k AS (SELECT doc_id, d.source, size, source_size, target, rate, shift,
        row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS LAST) - 1 AS place FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, CAST(((place + 1) * rate + shift) // 16777216 - (place * rate + shift) // 16777216 AS BIGINT) AS copies FROM k)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
"""
