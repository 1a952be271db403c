"""Exact de-duplication by sorting content (operator 6).

1. One Arrow pass normalises each whole text (A-Z to a-z) and hashes it.
2. Spark samples splitters and range-partitions on (first bytes, digest,
   doc_id descending): a total order in which equal texts are neighbours and
   in which a huge group is spread over as many partitions as it needs,
   because doc_id takes part in the splitters.  The splitter key is short, so
   what the driver samples stays small however long the texts are.
3. Spark's external sort orders each partition; one streaming pass compares
   each text in full with its neighbour and numbers the runs of equal texts.
   Memory: one batch, the previous text and the ids of the run's current batch.
4. Runs that touch a partition's edge are stitched across partitions by a join
   of partition p with p+1 on two boundary texts each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, cut

PREFIX_BYTES = 24
RUNS = "doc_id long, text_sha256 string, part int, run long, run_start boolean, head binary, tail binary"


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.binary())
        values = text.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([v[:PREFIX_BYTES] for v in values], pa.binary()), pa.array([hashlib.sha256(v).digest() for v in values], pa.binary()), text],
            ["doc_id", "prefix", "digest", "norm"],
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours.  The first row carries the partition's first text, a last extra row its last text."""
    part = TaskContext.get().partitionId()
    last, run = None, -1
    for batch in batches:
        ids, digests, norms = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        runs, starts, heads = [], [], []
        for text in norms:
            same = text == last
            heads.append(text if last is None else None)
            run += not same
            runs.append(run)
            starts.append(not same)
            last = text
        n = len(runs)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([d.hex() for d in digests], pa.string()), pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()), pa.array(starts, pa.bool_()), pa.array(heads, pa.binary()), pa.nulls(n, pa.binary())],
            ["doc_id", "text_sha256", "part", "run", "run_start", "head", "tail"],
        )
    if last is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([part], pa.int32()), pa.array([run], pa.int64()), pa.array([False]), pa.nulls(1, pa.binary()), pa.array([last], pa.binary())],
            ["doc_id", "text_sha256", "part", "run", "run_start", "head", "tail"],
        )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  The row with the largest doc_id stays.  Repeated rows (same doc_id
    and text) count each in group_size and exactly one of them is kept.  A null
    doc_id sorts below all others; a group of only such rows has keep_id null
    and keeps one row.  An empty table gives an empty result.  Other columns of
    the input are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    normal = rows.mapInArrow(_normalise, "doc_id long, prefix binary, digest binary, norm binary")
    dealt = normal.repartitionByRange("prefix", "digest", F.col("doc_id").desc_nulls_last())
    ordered = dealt.sortWithinPartitions("prefix", "digest", "norm", F.col("doc_id").desc_nulls_last())
    runs = cut(ordered.select("doc_id", "digest", "norm").mapInArrow(_runs, RUNS), "runs")

    edge = runs.where(F.col("head").isNotNull() | F.col("tail").isNotNull())
    # two rows a partition: first and last text; partitions without rows are skipped by ranking the others
    ends = edge.groupBy("part").agg(F.first("head", True).alias("head"), F.first("tail", True).alias("tail"), F.max("run").alias("last_run"))
    ranked = ends.select("part", "last_run", F.row_number().over(Window.orderBy("part")).alias("k"))
    ends = ends.drop("last_run").join(ranked, "part")
    before = ends.select((F.col("k") + 1).alias("k"), F.col("tail").alias("before"))
    joined = ends.join(before, "k", "left").select("k", "part", "last_run", (F.col("head") == F.col("before")).alias("goes_on"))
    # number the groups over all partitions: a partition opens last_run + 1 of them, less one if its first goes on
    opened = F.col("last_run") + 1 - F.coalesce(F.col("goes_on").cast("int"), F.lit(0))
    base = joined.select("part", (F.sum(opened).over(Window.orderBy("k")) - F.col("last_run") - 1).alias("base"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"))

    real = runs.where(F.col("text_sha256").isNotNull())
    numbered = real.join(base, "part").select(
        "doc_id", "text_sha256", (F.col("base") + F.col("run")).alias("grp"), (F.col("run_start") & ~((F.col("run") == 0) & F.col("goes_on"))).alias("kept")
    )
    groups = numbered.groupBy("grp").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return numbered.join(groups, "grp", "left").select(
        "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "kept", "text_sha256"
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
