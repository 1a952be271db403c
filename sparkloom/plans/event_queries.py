"""Queries over the event log: a run is a user's events, its status comes from the event's type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import profiles
from ..operators import tables
from .registry import Tables, query

LOG = """log AS (SELECT user_id AS run, event_id, ts, event_type AS type, value,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'open' END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""


def log(d: Tables):
    status = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("open")
    return ev.sequence(d.events.select(F.col("user_id").alias("run"), "event_id", "ts", F.col("event_type").alias("type"), "value", status.alias("status")), "run", ["ts", "event_id"])


@query(f"WITH {LOG} SELECT run, event_id, seq FROM log")
def event_sequence(spark, sf_dir):
    return log(Tables(spark, sf_dir)).select("run", "event_id", "seq")


@query(f"WITH {LOG}, own AS (SELECT * FROM log WHERE run = 3 AND seq > 5) SELECT run, event_id, seq, (SELECT count(*) FROM own) > 10 AS has_more FROM own ORDER BY seq LIMIT 10")
def event_page(spark, sf_dir):
    return ev.page(log(Tables(spark, sf_dir)), "run", 3, 5, 10).select("run", "event_id", "seq", "has_more")


@query("""SELECT user_id AS run, min(ts) AS created FROM events GROUP BY user_id
HAVING (min(ts), user_id) < (TIMESTAMP '2024-01-01 12:00:00', 0) ORDER BY created DESC, run DESC LIMIT 20""")
def run_list(spark, sf_dir):
    runs = Tables(spark, sf_dir).events.groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("created"))
    return ev.keyset_after(runs, ["created", "run"], ["2024-01-01 12:00:00", 0], 20)


@query(f"""WITH {LOG} SELECT run, count(*) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(type, seq) AS last_type, count(*) FILTER (WHERE type = 'error') AS n_errors,
count(*) FILTER (WHERE type = 'purchase') AS n_purchases, round(sum(value), 4) AS total, arg_max(event_id, seq) FILTER (WHERE type = 'error') AS last_error,
arg_max(event_id, seq) FILTER (WHERE type = 'purchase') AS last_purchase FROM log GROUP BY run""")
def mission_fold(spark, sf_dir):
    return ev.mission_fold(log(Tables(spark, sf_dir)), "run")


@query(f"""WITH {LOG} SELECT run, seq, before, status FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY run ORDER BY seq), '') AS before FROM log)
WHERE NOT ((before = '' AND status = 'started') OR (before IN ('started', 'open') AND status IN ('open', 'completed', 'failed')))""")
def illegal_moves(spark, sf_dir):
    return ev.illegal_moves(log(Tables(spark, sf_dir)), "run")


@query(f"""WITH {LOG}, s AS (SELECT run, seq, round(sum(value) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS spent FROM log)
SELECT run, min(seq) AS seq, arg_min(spent, seq) AS spent FROM s WHERE spent > 500 GROUP BY run""")
def over_budget(spark, sf_dir):
    return ev.over_budget(log(Tables(spark, sf_dir)), "run", "value", 500.0)


@query(f"""WITH {LOG} SELECT run, ts::DATE::VARCHAR AS span, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_events, count(*) FILTER (WHERE status = 'failed') AS n_failed,
coalesce(arg_max(status, seq) FILTER (WHERE status IN ('completed', 'failed')), 'started') AS status FROM log GROUP BY 1, 2""")
def span_status(spark, sf_dir):
    """A span is a day of a run."""
    return ev.spans(log(Tables(spark, sf_dir)).withColumn("span", F.to_date("ts").cast("string")), "run", "span")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM events)
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) FILTER (WHERE i = least(m - 1, floor(m * 0.95))) AS p95, max(value) AS most FROM r GROUP BY event_type""")
def event_timing(spark, sf_dir):
    return profiles.timing(Tables(spark, sf_dir).events, "event_type", "value")


@query("SELECT regexp_replace(regexp_replace(props, '0x[0-9a-fA-F]+', '#', 'g'), '[0-9]+', '#', 'g') AS message, count(*) AS n FROM events GROUP BY 1")
def folded_messages(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy(ev.fold_message(F.col("props")).alias("message")).agg(F.count("*").alias("n"))


@query("""SELECT user_id AS provider, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures,
round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate, round(avg(value), 6) AS avg_latency FROM events GROUP BY user_id""")
def provider_metrics(spark, sf_dir):
    calls = Tables(spark, sf_dir).events.select(F.col("user_id").alias("provider"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    return ev.metrics(calls, "provider")


@query("SELECT event_id, ts, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 50")
def activity_feed(spark, sf_dir):
    return ev.activity(Tables(spark, sf_dir).events, "2024-01-20 00:00:00", 50).select("event_id", "ts", "event_type")


@query(f"WITH {LOG} SELECT event_id, status FROM log WHERE NOT (ts < TIMESTAMP '2024-01-25' - INTERVAL 14 DAYS AND status IN ('completed', 'failed'))")
def retention(spark, sf_dir):
    return tables.keep_recent(log(Tables(spark, sf_dir)), "ts", 14, "2024-01-25 00:00:00", ["completed", "failed"]).select("event_id", "status")


_LINES = """ll AS (SELECT user_id AS log, event_id AS line, CASE WHEN event_id % 50 = 0 THEN '    at shop.Cart(' || event_id || ')' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE event_type WHEN 'error' THEN ' [ERROR]: ' WHEN 'purchase' THEN ' Warning - ' WHEN 'view' THEN ' ' ELSE ' info ' END
  || event_type || ' took ' || (event_id % 7) || 'ms of 0x' || lower(hex(event_id % 3)) || ' ' || props END AS text FROM events),
r AS (SELECT *, regexp_replace(upper(regexp_extract(text, '(?i)\\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRITICAL|FATAL|SEVERE)\\b', 1)), 'WARNING', 'WARN') AS level, regexp_extract(text, '\\b([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2})', 1) AS stamp,
  left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)^.*?\\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRITICAL|FATAL|SEVERE)\\b', ''),
    '(?i)\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b|\\b0x[0-9a-f]+\\b|\\b[0-9]+(?:\\.[0-9]+)?\\b', '#', 'g'), '^[ :\\-\\[\\]]+', ''), '[ :\\-\\[\\]]+$', ''), 160) AS message FROM ll)"""


def _read(d):
    level = F.when(F.col("event_type") == "error", " [ERROR]: ").when(F.col("event_type") == "purchase", " Warning - ").when(F.col("event_type") == "view", " ").otherwise(" info ")
    k = F.col("event_id")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, "event_type", F.lit(" took "), k % 7, F.lit("ms of 0x"), F.lower(F.hex(k % 3)), F.lit(" "), "props")
    trace = F.concat(F.lit("    at shop.Cart("), k, F.lit(")"))
    return profiles.read_lines(d.events.select(F.col("user_id").alias("log"), k.alias("line"), F.when(k % 50 == 0, trace).otherwise(text).alias("text")))


@query(f"WITH {_LINES} SELECT log, count(*) AS lines, count(*) FILTER (WHERE level = 'ERROR') AS errors, min(nullif(stamp, '')) AS first_stamp, max(nullif(stamp, '')) AS last_stamp, count(*) FILTER (WHERE regexp_matches(text, '^\\s+at \\S+\\(.*\\)$')) AS traces FROM r GROUP BY log")
def log_summary(spark, sf_dir):
    """The events of a user as a log of text lines."""
    return profiles.log_summary(_read(Tables(spark, sf_dir)))


@query(f"WITH {_LINES} SELECT log, level, count(*) AS n FROM r WHERE level <> '' GROUP BY log, level")
def log_levels(spark, sf_dir):
    return profiles.log_levels(_read(Tables(spark, sf_dir)))


@query(f"WITH {_LINES} SELECT log, message, n FROM (SELECT *, row_number() OVER (PARTITION BY log ORDER BY n DESC, message) AS place FROM (SELECT log, message, count(*) AS n FROM r WHERE message <> '' GROUP BY log, message) WHERE n > 1) WHERE place <= 10")
def log_messages(spark, sf_dir):
    return profiles.top_messages(_read(Tables(spark, sf_dir)))


@query(f"WITH {_LINES} SELECT log, line, left(trim(text), 200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY log ORDER BY line) AS place FROM r WHERE level = 'ERROR') WHERE place <= 20")
def log_errors(spark, sf_dir):
    return profiles.first_errors(_read(Tables(spark, sf_dir)))


@query("""SELECT count(*) AS samples, round(sum(value), 3) AS total, round(median(value), 3) AS p50, round(list_sort(list(value))[(least(count(*) - 1, floor(count(*) * 0.95)) + 1)::BIGINT], 3) AS p95, round(max(value), 3) AS most,
round((SELECT max(t) FROM (SELECT sum(value) AS t FROM events GROUP BY event_type)) / sum(value), 3) AS share_of_first FROM events""")
def timing_profile(spark, sf_dir):
    return profiles.profile(Tables(spark, sf_dir).events, "event_type", "value")
