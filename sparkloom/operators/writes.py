"""Writes as functions from tables to tables, to be overwritten or merged by whatever stores them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def insert_with_provenance(items: DataFrame, key: list[str], sources: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """New rows with an id made of their key and a time, and a child row for each of a row's sources."""
    own = items.withColumn("id", F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)), 256)).withColumn("created_at", at)
    return own.drop(sources), own.select("id", F.posexplode(sources).alias("pos", "source"))


def replace_edges(edges: DataFrame, gone: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Edges without those of ``gone``, and of ``new`` those whose key isn't left; the first of equal keys by all columns."""
    left = edges.join(gone.select(*key).distinct(), key, "left_anti")
    fresh = new.groupBy(*key).agg(F.min(F.struct(*(c for c in edges.columns if c not in key))).alias("rest")).select(*key, "rest.*")
    return left.unionByName(fresh.join(left.select(*key), key, "left_anti"))


def replace_set(current: DataFrame, owners: DataFrame, new: DataFrame, owner: str, key: str, order: str) -> DataFrame:
    """The sets of ``owners`` are replaced by ``new``; of rows with one owner and key the last by ``order`` stays."""
    rest = [c for c in current.columns if c not in (owner, key)]
    last = new.groupBy(owner, key).agg(F.max_by(F.struct(*rest), order).alias("rest")).select(owner, key, "rest.*")
    return current.join(owners.select(owner).distinct(), owner, "left_anti").unionByName(last)


def apply_changes(index: DataFrame, changed: DataFrame, deleted: DataFrame, path: str) -> DataFrame:
    """An index after a batch: rows of changed and deleted paths go, the changed ones' new rows come."""
    touched = changed.select(path).unionByName(deleted.select(path)).distinct()
    return index.join(touched, path, "left_anti").unionByName(changed)


def set_with_history(rows: DataFrame, wanted: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Set ``column`` where it has the expected value, and a history row for each row that was set.

    ``wanted``: key, expected, new; one row a key.
    """
    met = rows.join(wanted, key, "left")
    hit = F.coalesce(F.col(column) == F.col("expected"), F.lit(False))
    now = met.withColumn(column, F.when(hit, F.col("new")).otherwise(F.col(column))).select(*rows.columns)
    return now, met.where(hit).select(key, F.col(column).alias("before"), F.col("new").alias("after"))


def export_rows(items: DataFrame, exported: DataFrame, vault: Column, reference: str, digest: str, dropped: list[str]) -> DataFrame:
    """Rows of the vault that may leave: without the dropped columns, and with reference and digest null where the row they
    point at isn't exported."""
    known = exported.select(F.col(exported.columns[0]).alias("known")).distinct()
    own = items.where(vault).drop(*dropped).join(known, F.col(reference) == F.col("known"), "left")
    for c in (digest, reference):
        own = own.withColumn(c, F.when(F.col("known").isNotNull(), F.col(c)))
    return own.drop("known")


def hash_chain(rows: DataFrame, chain: str, order: list[str], record: str) -> DataFrame:
    """Each record's link: sha256 of the link before it in its chain and the record.  A chain is sorted and streamed through one
    task, as each link needs the one before; memory holds a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, link, n = object(), GENESIS, 0
        for batch in batches:
            links, places = [], []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != own:
                    own, link, n = c, GENESIS, 0
                link, n = hashlib.sha256(f"{link}{text or ''}".encode()).hexdigest(), n + 1
                links.append(link)
                places.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), batch.column(1), pa.array(links)], ["chain", "place", "record", "link"])

    dealt = rows.select(F.col(chain).cast("string").alias("chain"), F.col(record).cast("string").alias("record"), *order).repartition("chain").sortWithinPartitions("chain", *order)
    return dealt.select("chain", "record").mapInArrow(run, "chain string, place long, record string, link string")


def chain_faults(links: DataFrame, ends: DataFrame) -> DataFrame:
    """chain, fault: links that don't follow from the one before, and chains whose count or head isn't the one ``ends`` states
    (chain, n, head).  Links are checked by themselves, in parallel."""
    before = F.lag("link", 1, GENESIS).over(Window.partitionBy("chain").orderBy("place"))
    edited = links.withColumn("before", before).where(F.sha2(F.concat("before", F.coalesce("record", F.lit(""))), 256) != F.col("link")).select("chain", F.lit("edited").alias("fault"))
    heads = links.groupBy("chain").agg(F.count("*").alias("found"), F.max_by("link", "place").alias("found_head"))
    short = ends.join(heads, "chain", "left").where((F.coalesce("found", F.lit(0)) != F.col("n")) | ~F.col("found_head").eqNullSafe(F.col("head"))).select("chain", F.lit("truncated").alias("fault"))
    return edited.unionByName(short).distinct()


def promoted(findings: DataFrame, confidence: str) -> DataFrame:
    """Findings as knowledge: DERIVED from a confidence of 0.7 on, else OBSERVED."""
    return findings.withColumn("trust", F.when(F.col(confidence) >= 0.7, "DERIVED").otherwise("OBSERVED"))
