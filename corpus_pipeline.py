"""The corpus pipeline: documents in, clean, unique, uncontaminated and encoded documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo.llm import decontam, linededup, ngramjoin, quality, wordbpe
from cotejo.llm.common import scratch, table
from cotejo.llm.queries import PREDICT, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: near duplicates: word shingles of five, a similarity of 0.8 or more
NEAR_WORDS, NEAR_PERCENT = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality model rejects; the model is fitted on all of the documents' table."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, keep=COLUMNS).where(F.col("score") >= PREDICT).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share; n_chars follows the text."""
    clean = linededup.LineIndex.empty(spark).insert(docs).clean(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies: that of the smallest doc_id (null last), then of the smallest digest of the text.

    Rows are told apart by id and text, so an id on several rows is judged text by text; of equal rows one stays. Rows without
    shingles are copies of nothing and all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))
    rows = docs.select(*COLUMNS, key.alias("_key"))
    classes = ngramjoin.jaccard_classes(rows.select(F.col("_key").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    by_row = classes.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("copy"))
    odd = by_row.where("copy OR n > 1").select(F.col("doc_id").alias("_key"), "copy")
    met = rows.join(odd, "_key", "left")
    once = met.where("copy = false").dropDuplicates(["_key"])
    return met.where("copy IS NULL").unionByName(once).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontam.remove(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, with its number of tokens."""
    return wordbpe.encode_decode(docs, vocabulary("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]
#: SQL can't express the first stage's model or the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
