"""A full-text index kept up to date by a stream of file changes.

The index is a log of batches in a shared folder: of each batch the state of the
files that it touched, their new postings, and how much each term's document
frequency changed.  A file's newest batch holds its postings; sums of changes
are the frequencies.  A batch reads only batches before it and rewrites its own
folders, so running one again, after a lost driver or executor, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t

TABLES = {"files": "path string, present boolean", "postings": "path string, term string, tf bigint", "frequencies": "term string, change bigint", "commits": "n_files bigint"}


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all batches with its number; empty before the first one."""
    schema = f"{TABLES[name]}, batch bigint"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def _write(df: DataFrame, root: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def batches(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of the batches that are complete: their commit is written last."""
    return _table(spark, root, "commits").select("batch").distinct()


def _complete(spark: SparkSession, root: str, name: str, before: int | None) -> DataFrame:
    own = _table(spark, root, name)
    own = own if before is None else own.where(F.col("batch") < before)
    return own.join(F.broadcast(batches(spark, root)), "batch", "left_semi")  # a number for each batch


def newest_files(spark: SparkSession, root: str, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """path, batch, present: the newest batch of each file, or of those in ``only`` (path)."""
    files = _complete(spark, root, "files", before)
    files = files if only is None else files.join(only, "path", "left_semi")
    return files.groupBy("path").agg(F.max(F.struct("batch", "present")).alias("last")).select("path", "last.batch", "last.present")


def postings(spark: SparkSession, root: str, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """path, term, tf of the files as they are now, or were before a batch."""
    files = newest_files(spark, root, before, only).where("present").select("path", "batch")
    return _complete(spark, root, "postings", before).join(files, ["path", "batch"]).select("path", "term", "tf")


def frequencies(spark: SparkSession, root: str) -> DataFrame:
    """term, df: in how many files a term is."""
    return _complete(spark, root, "frequencies", None).groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")


def counted(texts: DataFrame) -> DataFrame:
    """path, term, tf of texts (path, text), a row for each path: words are counted within their text, so that no task holds the counts of many."""
    sorted_ = texts.select("path", F.array_sort(t.tokens(F.col("text"))).alias("words"))
    # a word that differs from the one behind it is the last of its kind, and counts from the last of the kind before
    follows = F.concat(F.slice("words", F.lit(2), F.size("words")), F.array(F.lit(None).cast("string")))
    told = F.transform(F.arrays_zip(F.col("words").alias("term"), follows.alias("next")), lambda x, i: F.struct(x["term"].alias("term"), (i + 1).alias("upto"), (~x["term"].eqNullSafe(x["next"])).alias("last")))
    ends = sorted_.select("path", F.filter(told, lambda x: x["last"]).alias("ends"))
    before = F.slice(F.concat(F.array(F.lit(0)), "ends.upto"), F.lit(1), F.size("ends"))
    # outer, as Spark would first cut and sort each text once more to see whether it has words
    each = ends.select("path", F.inline_outer(F.zip_with("ends", before, lambda x, n: F.struct(x["term"].alias("term"), (x["upto"] - n).cast("long").alias("tf")))))
    return each.where("term IS NOT NULL").select("path", "term", "tf")


def apply_changes(spark: SparkSession, root: str, changes: DataFrame, batch: int) -> None:
    """Bring the index up to one batch of changes (path, seq, text, deleted).

    Of several changes of a file the one with the largest seq counts (of equal ones a deletion, else the larger text); seq rises with
    time, so batches come in its order.  A null text has no terms.  A file that is deleted before it was known stays unknown to all
    but the log.
    """
    last = changes.groupBy("path").agg(F.max(F.struct("seq", "deleted", F.coalesce("text", F.lit("")).alias("text"))).alias("last")).select("path", "last.text", (~F.col("last.deleted")).alias("present"))
    _write(last.select("path", "present"), root, "files", batch)
    files = spark.read.schema(TABLES["files"]).parquet(f"{root}/files/batch={batch}")
    _write(counted(last.where("present")), root, "postings", batch)
    new = spark.read.schema(TABLES["postings"]).parquet(f"{root}/postings/batch={batch}")
    old = postings(spark, root, batch, files.select("path"))
    change = new.select("term", F.lit(1).alias("n")).unionByName(old.select("term", F.lit(-1).alias("n"))).groupBy("term").agg(F.sum("n").alias("change")).where("change <> 0")
    _write(change, root, "frequencies", batch)
    _write(files.agg(F.count("*").alias("n_files")), root, "commits", batch)


def follow(changes: DataFrame, root: str) -> None:
    """Apply a stream of changes as far as it goes; started again with the same root it goes on behind what it has applied."""
    spark = changes.sparkSession

    def step(df: DataFrame, batch: int) -> None:
        df.persist()
        apply_changes(spark, root, df, batch)
        df.unpersist()

    changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Write the index as it is now as one batch into a new folder: deleted files and old postings are gone.

    The batch keeps the number of the last one, so that a stream whose checkpoint is copied too goes on with the next.
    """
    last = batches(spark, root).agg(F.max("batch")).first()[0]
    if last is None:
        return
    _write(newest_files(spark, root).where("present").select("path", "present"), target, "files", last)
    _write(postings(spark, root), target, "postings", last)
    _write(frequencies(spark, root).select("term", F.col("df").alias("change")), target, "frequencies", last)
    _write(newest_files(spark, root).agg(F.count("*").alias("n_files")), target, "commits", last)


def search_index(spark: SparkSession, root: str, questions: DataFrame, k: int = 10) -> DataFrame:
    """q, path, n_terms, score, rank by summed IDF over the index as it is, without reading a text."""
    terms = questions.select("q", F.explode(t.significant_terms(F.col("text"))).alias("term")).distinct()
    total = newest_files(spark, root).where("present").agg(F.count("*").alias("n"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(frequencies(spark, root), "term").crossJoin(F.broadcast(total)).where(F.col("df") <= F.col("n") / 2).select("q", "term", idf.alias("idf"))  # one row
    hits = postings(spark, root).join(weights, "term").groupBy("q", "path").agg(F.count("*").alias("n_terms"), F.round(F.sum("idf"), 6).alias("score"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= k)
