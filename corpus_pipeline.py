"""From raw documents to packed training sequences: five stages, each one of the operators in brinelog.llm.

A stage is called with what the one before it kept. Its result is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelog.llm import common, jaccard, langid, mixing, packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the classifier rejects go."""
    model = langid.train(docs.where(common.crc_mod("doc_id", 3) != 1))
    return docs.where(~langid.classify(model)("text")["rejected"]).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by their text and by what their source and language show."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.classify(docs.select(*COLUMNS), labels).where("keep").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest doc_id (nulls last, then by its text's hash), of each group of near duplicates.

    Rows are told apart by doc_id and text, so a text under a reused or null doc_id goes or stays by itself. Of repeated
    rows one stays; rows without words all stay.
    """
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
    groups = common.stored(groups.where("group_key IS NOT NULL").select("doc_id", "text_hash", "group_key"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    firsts = groups.groupBy("group_key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = groups.groupBy("group_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("again"))
    told = members.join(firsts, "group_key").where("again > 1 OR NOT doc_id <=> first.doc_id OR text_hash <> first.text_hash")
    told = common.stored(told.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays")), "told")
    keyed = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("binary")).alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    rest = keyed.join(common.small(told), same, "left_anti")
    repeated = keyed.join(common.small(told.where("stays")), same, "left_semi").dropDuplicates(["doc_id", "_hash"])
    return rest.unionByName(repeated).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents such that sources stand to each other as their weights say, as far as they reach.

    The mix is made of narrow rows (doc_id, source, size, hash of the text), which then fetch the texts in a shuffled join, as
    they grow with the documents. One of several rows that are equal in these stands for all: it is there as often as they
    are taken together.
    """
    keys = ["doc_id", "source", "size", "hash"]
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumns({"size": mixing.word_count(), "hash": F.xxhash64(F.col("text").cast("binary"))})
    mixed = mixing.mix_sources(common.stored(keyed.select(*keys), "sizes"))
    taken = mixed.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    taken = common.stored(taken.withColumnsRenamed({k: f"_{k}" for k in keys}), "taken")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    once = keyed.join(taken.where("rows = 1").hint("merge"), same)
    again = keyed.join(common.small(taken.where("rows > 1")), same).dropDuplicates(keys)
    return mixing.emit(once.unionByName(again)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in as few sequences as can be."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("language ID", language), ("quality classifier", quality_filter), ("n-gram Jaccard join", one_of_each), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: SQL can't express the classifiers and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
