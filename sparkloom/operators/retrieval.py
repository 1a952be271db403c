"""The retrieval pipeline: ranked sources are fused, widened through a graph, fused again, cleared of copies and reranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..storage import stage
from . import graph, search

# fixed value: walks start from this many items at least
SEEDS = 8


@dataclass(frozen=True)
class Level:
    """What one level of context may read: hits a source, results, and steps through the graph (0: none)."""

    per_source: int
    results: int
    depth: int = 0
    direction: str = "out"


def fuse(batches: dict[str, DataFrame], limit: int) -> DataFrame:
    """q, doc, sources, score: reciprocal-rank fusion of the first ``limit`` hits (q, doc, rank) of each source."""
    return search.rrf(_sourced(batches, limit))


def seeds(fused: DataFrame, least: int = SEEDS) -> DataFrame:
    """root, node: all items named exactly, then the best others until ``least`` are reached."""
    exact = F.array_contains(F.split("sources", ","), "exact")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("exact"), F.desc("score"), "doc"))
    return fused.withColumn("exact", exact).withColumn("place", rank).where(F.col("exact") | (F.col("place") <= least)).select(F.col("q").alias("root"), F.col("doc").alias("node"))


def widen(fused: DataFrame, batches: dict[str, DataFrame], edges: DataFrame, level: Level) -> DataFrame:
    """``batches`` fused again with what a walk from the seeds reaches, three times a source's hits at most."""
    if not level.depth:
        return fused
    start = stage(seeds(fused), "seeds")
    reached = graph.walk(edges, start, level.depth, level.direction)
    near = graph.expand_ranked(edges, reached, 3 * level.per_source).select(F.col("root").alias("q"), F.col("node").alias("doc"), "rank")
    return search.rrf(_sourced(batches, level.per_source).unionByName(near.select("q", "doc", F.lit("graph").alias("source"), "rank")))


def _sourced(batches: dict[str, DataFrame], limit: int) -> DataFrame:
    rows = None
    for name in sorted(batches):
        own = batches[name].where(F.col("rank") <= limit).select("q", "doc", F.lit(name).alias("source"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def mark_copies(fused: DataFrame, texts: DataFrame, least: float = 0.85) -> DataFrame:
    """``redundant_of``: the better item of the question that an item repeats, or null.

    Items are taken best first; one with the tokens of a kept item, or of its subject and with shingles at Jaccard ``least`` or more,
    is marked and holds nobody back.  texts (doc, text, subject); null text is like nothing.  Alike texts are found once for all
    questions, between classes of equal ones; the fold then runs over a question's items, which the levels bound.
    """
    wanted = stage(texts.join(fused.select("doc").distinct(), "doc", "left_semi"), "wanted")
    members, pairs = search.copy_classes(wanted.withColumnRenamed("doc", "doc_id"), least)
    pairs = stage(pairs, "alike")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    near = both.groupBy("rep").agg(F.collect_list("other").alias("near"))
    known = wanted.select("doc", t.digest(F.col("text")).alias("digest")).join(members, "doc", "left").join(near, "rep", "left")
    rows = fused.select("q", "doc", "score").join(known, "doc")
    empty = F.array().cast("array<string>")
    one = F.struct((-F.col("score")).alias("s"), F.col("doc").cast("string").alias("doc"), "digest", F.col("rep").cast("string").alias("rep"), F.coalesce(F.col("near").cast("array<string>"), empty).alias("near"))
    none = F.array().cast("array<struct<doc:string,digest:string,rep:string,redundant_of:string>>")

    def step(acc, x):
        kept = F.filter(acc, lambda k: k["redundant_of"].isNull())
        same = F.filter(kept, lambda k: k["digest"] == x["digest"])
        alike = F.filter(kept, lambda k: (k["rep"] == x["rep"]) | F.array_contains(x["near"], k["rep"]))
        of = F.coalesce(F.get(same, F.lit(0))["doc"], F.get(alike, F.lit(0))["doc"])
        return F.concat(acc, F.array(F.struct(x["doc"].alias("doc"), x["digest"].alias("digest"), x["rep"].alias("rep"), of.alias("redundant_of"))))

    marked = rows.groupBy("q").agg(F.aggregate(F.array_sort(F.collect_list(one)), none, step).alias("m")).select("q", F.inline("m")).select("q", "doc", "redundant_of")
    return fused.join(marked, ["q", "doc"], "left")


def retrieve(batches: dict[str, DataFrame], edges: DataFrame, items: DataFrame, overlap: DataFrame, level: Level, least: float = 0.85) -> DataFrame:
    """q, doc, sources, redundant_of, final, rank: the pipeline; ranks count items that repeat nothing, the others have none.

    batches: source -> (q, doc, rank); doc is a node of edges.  items (doc, text, subject, trust, health, age_days, is_overlay);
    overlap (q, doc, overlap), 0 where a row is missing.
    """
    fused = stage(widen(fuse(batches, level.per_source), batches, edges, level), "fused")
    marked = mark_copies(fused.join(items.select("doc"), "doc", "left_semi"), items.select("doc", "text", "subject"), least)
    rated = search.rerank(with_factors(marked, items, overlap))
    place = F.row_number().over(Window.partitionBy("q", F.col("redundant_of").isNull()).orderBy(F.desc("final"), "doc"))
    ranked = rated.withColumn("rank", F.when(F.col("redundant_of").isNull(), place))
    return ranked.where(F.col("rank").isNull() | (F.col("rank") <= level.results)).select("q", "doc", "sources", "redundant_of", "final", "rank")


def with_factors(fused: DataFrame, items: DataFrame, overlap: DataFrame) -> DataFrame:
    """What ``search.rerank`` needs beside the score."""
    return fused.join(items.drop("text", "subject"), "doc").join(overlap, ["q", "doc"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
