"""A training corpus from raw documents: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import jaccard_dedup, line_dedup, mixing, packing, toxicity
from lodestar.llm.queries import CAPACITY, tokenizer_path
from lodestar.llm.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go.

    Null and empty texts are scored as empty ones and stay; repeated rows have one score, so all go or all
    stay; labels of documents that aren't there teach nothing. An empty table gives none.
    """
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or nearly equal lines one stays; n_chars follows the text.

    No document goes: one that has lost all its lines has the empty text. Null texts stay null, with their n_chars.
    Of ties the line of the smallest doc_id stays, a null doc_id first; repeated rows keep the same lines.
    """
    left = line_dedup.dedup_lines(docs)
    changed = F.col("__dropped") > 0
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard similarity of 0.8 or more stays (five-word shingles).

    It is the one with the smallest doc_id, and of rows that repeat it one. Texts without a word, null or empty
    (those that the stage before has emptied as well), are alike, so one of them stays. Rows without
    doc_id belong to no group and stay.
    """
    return jaccard_dedup.keep_one(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents are left out, kept or repeated.

    A null source is one of its own and comes last; null texts have no words. Rows with one doc_id are taken alike,
    which settles ties; reruns agree.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 2048 tokens.

    Null and empty texts are one id each; documents that the mix repeats are packed as often. Only longer ones are cut.
    """
    return packing.pack(docs, tokenizer_path(), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained classifier nor the fingerprints; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a stage table before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
