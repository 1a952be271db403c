"""Queries that run streams over the event log as far as it goes and give what they appended."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..storage import shared_dir
from ..streaming import index, logs
from .event_queries import LOG
from .registry import Tables, query
from .search_queries import tok


def _log(spark, sf_dir):
    return logs.read_log(spark, f"{sf_dir}/events.parquet")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def log_tail(spark, sf_dir):
    return logs.drain(_log(spark, sf_dir).where(F.col("event_type").isin("error", "purchase")).select("event_id", "user_id", "event_type"), "tail")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, value FROM events), l AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS closed FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM w, l WHERE start + INTERVAL 6 HOURS <= closed GROUP BY start, event_type""")
def windowed_counts(spark, sf_dir):
    """Windows that are closed, a day behind the newest event."""
    done = logs.drain(logs.windowed_counts(_log(spark, sf_dir), "ts", "event_type", "6 hours", "1 day"), "windows")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT DISTINCT user_id FROM events")
def first_seen(spark, sf_dir):
    return logs.drain(logs.without_repeats(_log(spark, sf_dir), "ts", "user_id", "60 days").select("user_id"), "seen")


@query(f"""WITH {LOG}, m AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY run ORDER BY seq), '') AS before FROM log)
SELECT run, event_id, before, status FROM m WHERE NOT (before = '' AND status = 'started' OR before IN ('started', 'open') AND status IN ('completed', 'failed', 'open') )""")
def run_states(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("open")
    log = _log(spark, sf_dir).select(F.col("user_id").alias("run"), "event_id", "ts", status.alias("status"))
    return logs.drain(logs.illegal_moves(log, "run", ["ts", "event_id"]), "states")


def _indexed(spark, sf_dir):
    """An index after three batches: all documents; new versions of every third, their first lines; deletions of every fifth."""
    root = f"{shared_dir(spark)}/sparkloom/index-{uuid.uuid4().hex}"
    docs = Tables(spark, sf_dir).documents.select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    first = docs.select("path", F.lit(1).alias("seq"), "text", F.lit(False).alias("deleted"))
    edited = docs.where("doc_id % 3 = 0").select("path", F.lit(2).alias("seq"), F.substring_index("text", "\n", 1).alias("text"), F.lit(False).alias("deleted"))
    gone = docs.where("doc_id % 5 = 0").select("path", F.lit(3).alias("seq"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"))
    for k, part in enumerate((first, edited, gone)):
        index.apply_changes(spark, root, part, k)
    return root


_NOW = "now AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN split_part(text, chr(10), 1) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"


@query(f"WITH {_NOW} SELECT term, count(*) AS df FROM (SELECT DISTINCT path, term FROM (SELECT path, unnest({tok('text')}) AS term FROM now)) GROUP BY term")
def incremental_frequencies(spark, sf_dir):
    """Document frequencies kept by differences through three batches, against those of the last state."""
    return index.frequencies(spark, _indexed(spark, sf_dir))


@query(f"WITH {_NOW} SELECT path, term, count(*) AS tf FROM (SELECT path, unnest({tok('text')}) AS term FROM now) GROUP BY path, term")
def incremental_postings(spark, sf_dir):
    return index.postings(spark, _indexed(spark, sf_dir))
