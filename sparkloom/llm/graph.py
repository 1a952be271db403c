"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """id, comp for every id in ``edges`` (a, b): comp is the smallest id that links reach.

    Each round takes the least label among an id's neighbours and then the
    label of its label, and is written to the shared folder; the number of
    rounds grows with the logarithm of the longest chain on most graphs.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = old = cut(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("theirs")), "b").groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("theirs"))
        less = labels.join(near, "id").select("id", "comp", F.least("comp", "theirs").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        step = less.join(jump, "new", "left").select("id", "comp", F.least("new", F.coalesce("far", "new")).alias("new"))
        done = cut(step, "labels")
        discard(old)
        old = done
        labels = done.select("id", F.col("new").alias("comp"))
        if done.where(F.col("new") < F.col("comp")).isEmpty():
            discard(both)
            labels.staged_path = done.staged_path
            return labels
