"""Scans, precedence, change detection and functional writes (a new table from the old one and a delta)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, vaults: list[str], project: str | None, as_of) -> DataFrame:
    """Rows a reader may see: default rows, those of the project, ephemeral ones of it or of none; live and not expired.  No vault, no row."""
    v, p = F.col("vault"), F.col("project")
    rules = {"default": v == "default", "project": (v == "project") & (p == F.lit(project)), "ephemeral": (v == "ephemeral") & (p.isNull() | (p == F.lit(project)))}
    allowed = F.lit(False)
    for name in vaults:
        allowed = allowed | rules[name]
    return df.where(allowed & ~F.col("health").isin("QUARANTINED", "SUPERSEDED") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of))))


def get_many(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of the ids, in the order asked for; absent ids are skipped.  The list comes from the caller and is small."""
    wanted = df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} {df.schema[key].dataType.simpleString()}, pos int")
    return df.join(F.broadcast(wanted), key).orderBy("pos")


def prefer_overlay(committed: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the overlay's where there is one; a row of status deleted hides the key."""
    both = committed.withColumn("scope", F.lit("committed")).unionByName(overlay.withColumn("scope", F.lit("overlay")))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("scope")))
    return both.withColumn("i", first).where((F.col("i") == 1) & (F.col("status") != "deleted")).drop("i")


def changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, changed or removed between two snapshots."""
    a, b = before.select(key, F.col(digest).alias("old")), after.select(key, F.col(digest).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, kind.alias("change"))


def upsert(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the delta's rows put in by key."""
    return target.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def insert_ignore(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the delta, one a key, whose key the target hasn't."""
    return delta.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def increment(target: DataFrame, delta: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Counters added in place by key."""
    return target.unionByName(delta).groupBy(key).agg(*(F.sum(c).alias(c) for c in counters))


def keep_recent(df: DataFrame, when: str, days: int, as_of, final: list[str] | None = None) -> DataFrame:
    """Rows that retention leaves: younger than ``days`` or, if given, not in a final status."""
    old = F.col(when) < F.lit(as_of).cast(df.schema[when].dataType) - F.expr(f"INTERVAL {days} DAYS")
    return df.where(~(old & F.col("status").isin(final)) if final else ~old)


def compare_and_set(target: DataFrame, wanted: DataFrame, key: str, column: str) -> DataFrame:
    """wanted (key, expected, value): the target with the column set where it still has the expected value; ``applied`` says so."""
    met = target.join(wanted, key, "left")
    hit = F.col(column).eqNullSafe(F.col("expected")) & F.col("value").isNotNull()
    return met.select(*[F.when(hit, F.col("value")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in target.columns], hit.alias("applied"))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("i = 1").drop("i")


def signature(df: DataFrame, columns: list[str]):
    """One sha1 for a whole table: per-row hashes summed without order, so nothing is collected or sorted."""
    row = F.conv(F.substring(F.sha1(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sha1(F.concat_ws(":", F.count("*"), F.sum(row))).alias("signature"))


def other_bucket(counts: DataFrame, name: str, n: str, most: int) -> DataFrame:
    """Groups by (count descending, name); if there are more than ``most``, the first ``most`` - 1 and all others as OTHER.

    The first ones are a top-k and what remains is a difference of sums, so that no task sees all groups.
    """
    whole = counts.agg(F.count("*").alias("m"), F.sum(n).alias("total"))
    top = counts.orderBy(F.desc(n), name).limit(most)
    first = top.select(F.col(name).cast("string").alias(name), n).withColumn("i", F.row_number().over(Window.orderBy(F.desc(n), name)))  # ``most`` rows
    kept = first.join(F.broadcast(whole)).where((F.col("m") <= most) | (F.col("i") < most))
    rest = kept.groupBy("m", "total").agg(F.sum(n).alias("s")).where(F.col("m") > most).select(F.lit("OTHER").alias(name), (F.col("total") - F.col("s")).alias(n))
    alone = whole.where((F.col("m") > most) & F.lit(most < 2)).select(F.lit("OTHER").alias(name), F.col("total").alias(n))
    return kept.select(name, n).unionByName(rest).unionByName(alone)
