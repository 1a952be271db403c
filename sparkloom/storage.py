"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own in local mode (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it again: cuts the lineage of loops and survives lost executors.

    The files stay until ``discard``, or until whoever owns the folder clears it.
    """
    path = f"{shared_dir(df.sparkSession)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def discard(*staged: DataFrame | None) -> None:
    """Delete the files of staged tables that nothing will read again; other frames and None are left alone."""
    for df in staged:
        path = getattr(df, "staged_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
            df.staged_path = None


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt over as many tasks as a shuffle has, by a key that few rows share.

    Small rows that much is made of lie in few files, and would be left to the few tasks that read these; Spark doesn't put together
    again what is dealt by a number of tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
