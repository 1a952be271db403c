"""The corpus pipeline: quality filter, line dedup, near-duplicate join, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  Stages work on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import storage
from sparkloom.llm import decontaminate, jaccard_join, line_dedup, pieces, quality

NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows that share doc_id and text go or stay together, null texts count as empty."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in five documents or more stay in the largest doc_id alone; every row stays, null texts become empty."""
    return line_dedup.line_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row stays, of the smallest doc_id; rows without doc_id are in no group and all stay."""
    return jaccard_join.one_row_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut from the texts; rows with over half of their words hit go, all others stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding gives the text back; one row for each row, null texts have no ids."""
    done = pieces.round_trip(docs)
    return done.select("doc_id", "ids", "n_tokens", (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark_spans),
    ("sentencepiece", encode),
]
#: SQL can't express the classifier or the encoder; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written, as the next reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        before, docs = docs, storage.stage(done, f"pipeline-{name}") if k < len(STAGES) - 1 else done
        if k < len(STAGES) - 1:
            storage.discard(before)
    return docs
