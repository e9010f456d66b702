"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns to the shared
folder and hands the next one what it reads there. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, decontaminate, neardup, secrets, toxicity
from lodestrata.llm.common import table, without, written
from lodestrata.llm.queries import TOXIC_FROM, tokenizer_file, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity operator scores below its threshold."""
    model = toxicity_model(spark, sf_dir)
    scored = docs.withColumn("__toxicity", toxicity.score(model, F.col("text")))
    return scored.where(F.col("__toxicity") < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the least id."""
    return without(docs, neardup.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")), "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a benchmark item in them."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; its secrets, encoded ones too, give way to a mark and n_chars follows the text."""
    return docs.withColumn("text", secrets.masked(F.col("text"))).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with the digests of ids and decoded text."""
    return docs.select("doc_id", "lang", "source", bpe.digests(tokenizer_file(), F.col("text"), ids=True).alias("r")).select("doc_id", "lang", "source", "r.*")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("secrets", mask_secrets), ("tokens", encode_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
