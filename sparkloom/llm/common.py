"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import discard, shared_dir  # noqa: F401
from ..storage import stage as cut  # noqa: F401

#: ASCII white space as the contracts spell it: \x20 and \x09-\x0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


#: Rows of an Arrow batch, in sessions that have not chosen a number themselves.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are counted in rows, whatever their size, and texts may be long: lower Spark's default number for the session."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH_ROWS))


def joined(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batches, put together to about so many rows, for steps that take small rows many at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, most: int | None = None) -> DataFrame:
    """Apply ``step`` to each Arrow batch where it lies, or to its slices of at most ``most`` rows; no shuffle, one batch in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = most or max(batch.num_rows, 1)
            for at in range(0, max(batch.num_rows, 1), size):
                out = step(batch.slice(at, size))
                if out is not None:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as bytes (null stays null) and ``more``, and no other column, so that names can't clash."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *more)


def quoted(name: str) -> str:
    """A column's name as expressions take it, whatever signs are in it."""
    return "`" + name.replace("`", "``") + "`"


def with_rest(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text as bytes, ``more`` and rest: a struct of all other columns, so that no name can clash."""
    others = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *more, rest.alias("rest"))


def restored(done: DataFrame, docs: DataFrame, follow: bool = True) -> DataFrame:
    """The columns of ``docs`` in their order, out of doc_id, text and rest; n_chars, where there is one, follows the text on wish."""
    return done.select(
        *(F.col(c) if c in ("doc_id", "text") else F.length("text").cast(docs.schema[c].dataType).alias(c) if follow and c == "n_chars" else F.col(f"rest.{quoted(c)}").alias(c) for c in docs.columns)
    )


def extended(df: DataFrame, more: str) -> StructType:
    """The frame's schema and further fields, given as DDL; its own types are never written as text."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
