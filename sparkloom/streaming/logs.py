"""Event logs as streams: resumable tails, event-time windows with late data, duplicates, states of runs.

A stream reads a folder of files, goes as far as there are files and stops
(``availableNow``); started again with the same checkpoint it goes on behind
what it has read.  Checkpoint and results lie in the folder all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import MOVES
from ..storage import shared_dir


def read_log(spark: SparkSession, path: str, time: str = "ts", files_per_trigger: int = 64) -> DataFrame:
    """The files under a path as a stream, their time as a timestamp; a batch takes some files, so memory is bounded."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path[:-1] + f"[{path[-1]}]").withColumn(time, F.col(time).cast("timestamp"))


def drain(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there, append what it gives to a table, and read the table.

    With the same ``folder`` again, only what came since is read and appended.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def windowed_counts(log: DataFrame, time: str, by: str, window: str, late: str) -> DataFrame:
    """start, ``by``, n, total: closed event-time windows; events that come more than ``late`` behind the newest may be lost."""
    counted = log.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), by, "n", "total")


def without_repeats(log: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """Each key once, as long as its repeats come within ``late``; older keys leave the state."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def illegal_moves(log: DataFrame, run: str, order: list[str], moves: dict[str, list[str]] = MOVES) -> DataFrame:
    """run, event_id, before, status: events whose status may not follow the run's status, which is the state kept between batches.

    A run's events of one batch are sorted by ``order``; batches must come in time order.
    """
    schema = "run long, event_id long, before string, status string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, out = state.get[0] if state.exists else "", []
        rows = pd.concat(list(batches)).sort_values(order)
        for event_id, status in zip(rows["event_id"], rows["status"], strict=True):
            if status not in moves.get(before, []):
                out.append((key[0], event_id, before, status))
            before = status
        state.update((before,))
        yield pd.DataFrame(out, columns=["run", "event_id", "before", "status"])

    return log.groupBy(run).applyInPandasWithState(step, schema, "status string", "append", GroupStateTimeout.NoTimeout)
