"""Logs and timings as defined summaries: levels, spans of time, folded messages, errors; counts, quantiles and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: levels of a log, what a stamp and a number look like, levels that are errors, lengths and numbers of what is shown
LEVEL = r"(?i)\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRITICAL|FATAL|SEVERE)\b"
STAMP = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2})"
NUMBER = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\b0x[0-9a-f]+\b|\b[0-9]+(?:\.[0-9]+)?\b"
ERRORS = ("ERROR", "CRITICAL", "FATAL", "SEVERE")
TRACE = r"^\s+at \S[^\s(]*\("  # and a bracket at the end
MESSAGE, SHOWN, MOST_MESSAGES, MOST_ERRORS = 160, 200, 10, 20
# fixed values: how a timed line ends, and its unit in milliseconds
TIMED = r"(?i)[:=,]\s*([0-9]+(?:\.[0-9]+)?)\s*(us|µs|ms|s|sec|seconds)?\s*$"
UNITS = {"us": 0.001, "µs": 0.001, "": 1.0, "ms": 1.0, "s": 1000.0, "sec": 1000.0, "seconds": 1000.0}
BUCKETS = 100


def read_lines(lines: DataFrame) -> DataFrame:
    """log, line, text, level, stamp, message, is_trace of lines (log, line, text): what stands after the level, numbers and ids folded to #."""
    level = F.regexp_replace(F.upper(F.regexp_extract("text", LEVEL, 1)), "WARNING", "WARN")
    # the first level of a line ends what comes before the message
    rest = F.when(level != "", F.expr("substring(text, regexp_instr(text, '%s') + length(regexp_extract(text, '%s', 1)))" % ((LEVEL.replace("\\", "\\\\"),) * 2))).otherwise(F.col("text"))
    body = F.trim(F.regexp_replace(rest, NUMBER, "#"), F.lit(" :-[]"))
    trace = F.col("text").startswith("Traceback (most recent call last)") | (F.col("text").rlike(TRACE) & F.col("text").endswith(")"))
    stamp = F.regexp_extract("text", STAMP, 1)
    return lines.where(F.col("text").isNotNull()).select(
        "log", "line", "text", F.when(level != "", level).alias("level"), F.when(stamp != "", stamp).alias("stamp"), F.substring(body, 1, MESSAGE).alias("message"), trace.alias("is_trace")
    )


def log_levels(read: DataFrame) -> DataFrame:
    return read.where(F.col("level").isNotNull()).groupBy("log", "level").agg(F.count("*").alias("n"))


def log_summary(read: DataFrame) -> DataFrame:
    """log, lines, errors, first and last stamp, blocks of stack traces."""
    return read.groupBy("log").agg(
        F.count("*").alias("lines"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"), F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp"), F.count_if("is_trace").alias("traces")
    )


def top_messages(read: DataFrame, most: int = MOST_MESSAGES) -> DataFrame:
    """log, message, n: the messages that a log repeats most often."""
    counts = read.where("message <> ''").groupBy("log", "message").agg(F.count("*").alias("n")).where("n > 1")
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("log").orderBy(F.desc("n"), "message"))).where(F.col("place") <= most).drop("place")


def first_errors(read: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """log, line, text: the first error lines of each log."""
    errors = read.where(F.col("level").isin(*ERRORS))
    placed = errors.withColumn("place", F.row_number().over(Window.partitionBy("log").orderBy("line"))).where(F.col("place") <= most)
    return placed.select("log", "line", F.substring(F.trim("text"), 1, SHOWN).alias("text"))


def timed_lines(lines: DataFrame) -> DataFrame:
    """name, value in milliseconds of lines (text) such as ``load: 12.5 ms``; other lines are left out."""
    unit = F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), F.lower(F.regexp_extract("text", TIMED, 2)))
    value = F.regexp_extract("text", TIMED, 1).try_cast("double") * unit
    # the name is all that stands before the first separator that a time follows to the end
    name = F.trim(F.expr("substring(text, 1, regexp_instr(text, '%s') - 1)" % TIMED.replace("\\", "\\\\")))
    return lines.select(name.alias("name"), value.alias("value")).where("value IS NOT NULL AND name <> ''")


def elements(samples: DataFrame, key: str, value: str, at: dict[str, Column]) -> DataFrame:
    """key and, for each of ``at``, the element of its values in order that the expression of ``n`` names, from 0.

    Equal values are counted first.  Approximate splitters deal the distinct values of a key into buckets, exact counts say in which
    bucket an element lies, and only that bucket is ranked: a key may hold any share of all rows.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    cuts = counts.groupBy(key).agg(F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 10_000).alias("cuts"))
    dealt = counts.join(cuts, key).select(key, value, "c", F.size(F.filter("cuts", lambda x: x < F.col(value))).alias("bucket"))
    sizes = dealt.groupBy(key, "bucket").agg(F.sum("c").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(key).orderBy("bucket"))
    placed = sizes.select(key, "bucket", (upto - F.col("m")).alias("before"), upto.alias("after"), F.sum("m").over(Window.partitionBy(key)).alias("n"))
    wanted = placed.select(key, "bucket", "before", "after", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), e.cast("bigint").alias("i")) for k, e in at.items()))).alias("x")).where((F.col("x.i") >= F.col("before")) & (F.col("x.i") < F.col("after")))
    inner = dealt.join(wanted.select(key, "bucket", "before").distinct(), [key, "bucket"])
    ranked = inner.withColumn("last", F.col("before") + F.sum("c").over(Window.partitionBy(key, "bucket").orderBy(value)))
    hit = ranked.select(key, "bucket", value, "last", "c").join(wanted.select(key, "bucket", "x.what", "x.i"), [key, "bucket"]).where((F.col("i") < F.col("last")) & (F.col("i") >= F.col("last") - F.col("c")))
    return hit.groupBy(key).agg(*(F.max(F.when(F.col("what") == k, F.col(value))).alias(k) for k in at))


def timing(samples: DataFrame, name: str, value: str) -> DataFrame:
    """Per name: count, total, mean, p95 (the element at floor(0.95 n) of the sorted values), max; null values count for nothing but n."""
    sums = samples.groupBy(name).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"))
    return sums.join(elements(samples, name, value, {"p95": F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))}), name, "left").select(name, "n", "total", "mean", "p95", "most")


def profile(samples: DataFrame, name: str, value: str) -> DataFrame:
    """One row: samples, total, median, p95 and maximum of all, and the share of time of the name with the largest total."""
    whole = samples.where(F.col(value).isNotNull()).withColumn("all", F.lit(0))
    n = F.col("n")
    found = elements(whole, "all", value, {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * 0.95))})
    sums = whole.agg(F.count("*").alias("samples"), F.sum(value).alias("total"), F.max(value).alias("most"))
    top = whole.groupBy(name).agg(F.sum(value).alias("t")).agg(F.max("t").alias("top"))
    # three one-row frames
    one = found.crossJoin(sums).crossJoin(top)
    return one.select("samples", F.round("total", 3).alias("total"), F.round((F.col("low") + F.col("high")) / 2, 3).alias("p50"), F.round("p95", 3).alias("p95"), F.round("most", 3).alias("most"), F.round(F.when(F.col("total") != 0, F.col("top") / F.col("total")).otherwise(0.0), 3).alias("share_of_first"))
