"""Append-only event logs: sequences, pages, folds over runs, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the legal moves of a run
MOVES = {"": ["started"], "started": ["open", "completed", "failed"], "open": ["open", "completed", "failed"], "completed": [], "failed": []}


def sequence(events: DataFrame, run: str, order: list[str], base: DataFrame | None = None) -> DataFrame:
    """``seq`` added: 1, 2, ... without gaps in each run, after ``base`` (run, last_seq) where given."""
    out = events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long"))
    return out if base is None else out.join(base, run, "left").withColumn("seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))).drop("last_seq")


def page(events: DataFrame, run: str, run_id, after: int, limit: int, types: list[str] | None = None) -> DataFrame:
    """The next ``limit`` events of a run after a cursor, with has_more: one row more is read to know it."""
    own = events.where((F.col(run) == run_id) & (F.col("seq") > after))
    if types:
        own = own.where(F.col("type").isin(types))
    head = own.orderBy("seq").limit(limit + 1)
    n = F.count("*").over(Window.partitionBy(run))
    return head.withColumn("has_more", n > limit).withColumn("i", F.row_number().over(Window.partitionBy(run).orderBy("seq"))).where(F.col("i") <= limit).drop("i")


def keyset_after(rows: DataFrame, keys: list[str], cursor: list, limit: int) -> DataFrame:
    """The next rows in descending order of ``keys`` below a cursor: a row comparison, so ties on the first key page well."""
    below = F.struct(*keys) < F.struct(*(F.lit(c).cast(rows.schema[k].dataType).alias(k) for k, c in zip(keys, cursor, strict=True)))
    return rows.where(below).orderBy(*(F.desc(k) for k in keys)).limit(limit)


def mission_fold(events: DataFrame, run: str) -> DataFrame:
    """One row a run: last value of each kind, counters, first and last seq; max_by combines on the map side."""
    last = lambda kind, c: F.max_by(c, F.when(F.col("type") == kind, F.col("seq")))
    return events.groupBy(run).agg(
        F.count("*").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("type", "seq").alias("last_type"), F.count_if(F.col("type") == "error").alias("n_errors"),
        F.count_if(F.col("type") == "purchase").alias("n_purchases"), F.round(F.sum("value"), 4).alias("total"), last("error", "event_id").alias("last_error"), last("purchase", "event_id").alias("last_purchase"),
    )


def illegal_moves(events: DataFrame, run: str, moves: dict[str, list[str]] = MOVES) -> DataFrame:
    """Events whose status may not follow the run's status before; the first follows ''."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy(run).orderBy("seq")), F.lit(""))
    legal = F.lit(False)
    for a, bs in moves.items():
        if bs:
            legal = legal | ((F.col("before") == a) & F.col("status").isin(bs))
    return events.withColumn("before", before).where(~legal).select(run, "seq", "before", "status")


def over_budget(events: DataFrame, run: str, cost: str, limit: float) -> DataFrame:
    """The first event of each run at which the running cost exceeds the limit."""
    spent = F.sum(cost).over(Window.partitionBy(run).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    over = events.withColumn("spent", F.round(spent, 4)).where(F.col("spent") > limit)
    return over.groupBy(run).agg(F.min("seq").alias("seq"), F.min_by("spent", "seq").alias("spent"))


def spans(events: DataFrame, run: str, span: str) -> DataFrame:
    """Per span: first and last seq, counts, and its status: the last closing event's, else started if open."""
    closing = F.when(F.col("status").isin("completed", "failed"), F.col("seq"))
    return events.groupBy(run, span).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_events"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.coalesce(F.max_by("status", closing), F.lit("started")).alias("status")
    )


def fold_message(message):
    """Numbers and hex become #, so that messages of one kind fold together."""
    return F.regexp_replace(F.regexp_replace(message, "0x[0-9a-fA-F]+", "#"), "[0-9]+", "#")


def metrics(calls: DataFrame, key: str) -> DataFrame:
    """Calls, successes and failures of each key, with rates that are null without calls."""
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.try_divide(F.count_if("ok"), F.count("*")), 6).alias("success_rate"), F.round(F.avg("latency"), 6).alias("avg_latency")
    )


def activity(events: DataFrame, after, limit: int) -> DataFrame:
    """The newest events after a high-water mark, each id once."""
    return events.where(F.col("ts") > F.lit(after).cast("timestamp_ntz")).dropDuplicates(["event_id"]).orderBy(F.desc("ts"), "event_id").limit(limit)
