"""Measures over tables: coverage, risk, ranking quality, contradictions, summaries with complete counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: weights of the readiness score and the least score and dependency share for each risk
READY_WEIGHTS = {"entity": 0.4, "dep": 0.3, "evidence": 0.2, "health": 0.1}
READY_AT = {"LOW": (0.55, 0.5), "MEDIUM": (0.70, 0.8), "HIGH": (0.85, 0.95), "CRITICAL": (0.90, 1.0)}
# fixed values: points of the blast radius, and of the levels
BLAST = ((40, 4), (15, 3), (5, 2), (1, 1))
LEVELS = ((7, 3), (5, 2), (3, 1))
LEVEL_NAMES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def readiness(rows: DataFrame, risk: str = "risk", gaps: str = "blocking") -> DataFrame:
    """``coverage`` and ``ready`` of rows with the parts entity, dep, evidence and health (0 to 1, null where not applicable):
    a weighted mean of the parts that apply, held against the risk's thresholds; any blocking gap vetoes."""
    weight = sum((F.when(F.col(p).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for p, w in READY_WEIGHTS.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) * w for p, w in READY_WEIGHTS.items()), F.lit(0.0))
    least = lambda k: F.element_at(F.create_map(*(x for r, v in READY_AT.items() for x in (F.lit(r), F.lit(v[k])))), F.col(risk))
    scored = rows.withColumn("coverage", F.round(share(total, weight), 6))
    return scored.withColumn("ready", (F.col("coverage") >= least(0)) & (F.coalesce("dep", F.lit(1.0)) >= least(1)) & (F.col(gaps) == 0))


def risk_points(rows: DataFrame) -> DataFrame:
    """``points`` and ``risk`` of changes with the columns blast, security, exposed, schema, scripts, contract, untested, routes,
    fixes, rules, weak_files and unresolved: points add up, and security and schema changes set a least level."""
    yes = lambda c: F.col(c)
    blast = F.lit(0)
    for at, points in reversed(BLAST):
        blast = F.when(F.col("blast") >= at, points).otherwise(blast)
    one = lambda c: F.when(c, 1).otherwise(0)
    points = (
        blast + F.when(yes("security"), 2).when(yes("exposed"), 1).otherwise(0) + F.when(yes("schema"), 2).when(yes("scripts"), 1).otherwise(0) + one(yes("contract"))
        + F.when(yes("untested"), F.when(yes("routes"), 3).otherwise(2)).otherwise(0) + one(F.col("fixes") >= 3) + one(F.col("rules") > 0) + one(F.col("weak_files") >= 5) + one(F.col("unresolved") > 0)
    )
    level = F.lit(0)
    for at, k in reversed(LEVELS):
        level = F.when(F.col("points") >= at, k).otherwise(level)
    floor = F.when(yes("security"), 2).when(yes("schema"), 1).otherwise(0)
    return rows.withColumn("points", points).withColumn("risk", F.element_at(F.array(*map(F.lit, LEVEL_NAMES)), F.greatest(level, floor) + 1))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """case, n_relevant, n_found, recall and top1_hit of ranked results (arm, q, doc, rank) against relevant (q, doc).

    Questions without any result count with recall 0 in every arm."""
    want = relevant.select("q", "doc").distinct()
    arms = ranked.select("arm").distinct()
    sizes = want.groupBy("q").agg(F.count("*").alias("n_relevant"))
    hits = ranked.where(F.col("rank") <= k).join(want, ["q", "doc"]).groupBy("arm", "q").agg(F.countDistinct("doc").alias("n_found"), F.min("rank").alias("best"))
    # a row for each question and arm: arms are a handful
    cases = sizes.withColumn("arm", F.explode(F.array(*(F.lit(r["arm"]) for r in arms.collect()))))
    joined = cases.join(hits, ["arm", "q"], "left")
    found = F.coalesce("n_found", F.lit(0))
    return joined.select("arm", "q", "n_relevant", found.alias("n_found"), F.round(share(found, F.col("n_relevant")), 6).alias("recall"), F.coalesce(F.col("best") == 1, F.lit(False)).alias("top1_hit"))


def quality_by_arm(cases: DataFrame) -> DataFrame:
    """Macro and micro recall and the share of first places, by arm."""
    return cases.groupBy("arm").agg(
        F.count("*").alias("n_cases"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.sum("n_found") / F.sum("n_relevant"), 6).alias("micro_recall"), F.round(F.avg(F.col("top1_hit").cast("double")), 6).alias("top1")
    )


def contradictions(items: DataFrame, subject: list[str], text: str, id_col: str, trust: str, updated: str) -> DataFrame:
    """top, other: of each subject whose items say different things, the best item with the best of each other saying.

    Sayings are compared without case and white space runs; the best has the highest trust, then the newest time, then the least id.
    """
    digest = F.sha2(F.trim(F.regexp_replace(F.lower(F.col(text)), r"[ \t\n\x0B\f\r]+", " ")), 256)
    best = F.struct(F.col(trust).alias("t"), F.col(updated).alias("u"), (-F.col(id_col)).alias("i"))
    sayings = items.select(*subject, digest.alias("digest"), best.alias("best")).groupBy(*subject, "digest").agg(F.max("best").alias("best"))
    top = sayings.groupBy(*subject).agg(F.max("best").alias("top"), F.count("*").alias("n")).where("n > 1")
    return sayings.join(top, subject).where(F.col("best") != F.col("top")).select(*subject, (-F.col("top.i")).alias("top"), (-F.col("best.i")).alias("other"))


def most_serious(findings: DataFrame, severity_rank: str, by: list[str], limit: int) -> DataFrame:
    """The first ``limit`` findings by severity, each with the complete count of its severity."""
    counts = findings.groupBy(severity_rank).agg(F.count("*").alias("n_of_severity"))
    return findings.orderBy(severity_rank, *by).limit(limit).join(counts, severity_rank)


def folder_histogram(paths: DataFrame, path: str, limit: int = 6) -> DataFrame:
    """The folders with most files; a path without a folder counts to the root."""
    folder = F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "^$", ".")
    return paths.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(limit)


def group_depth(paths: DataFrame, path: str) -> DataFrame:
    """Each path with its group: the first segment, or the first two where one segment holds over half of all paths."""
    first = F.substring_index(path, "/", 1)
    counts = paths.groupBy(first.alias("s")).agg(F.count("*").alias("n")).agg((F.max("n") * 2 > F.sum("n")).alias("deep"))
    return paths.join(F.broadcast(counts)).withColumn("group", F.when(F.col("deep"), F.substring_index(path, "/", 2)).otherwise(first)).drop("deep")  # counts is one row


def best_of(rows: DataFrame, key: list[str], quality: list[Column]) -> DataFrame:
    """The row of each key that is best by the qualities in their order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*(q.alias(f"q{k}") for k, q in enumerate(quality)))).alias("best")).select(*key, "best.*")


def round_robin(ranked: DataFrame, bucket: str, order: list[Column], limit: int) -> DataFrame:
    """The buckets' rows in turns: all first ones, all second ones and so on; ``place`` counts from 1 in a bucket."""
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    # only the first ``limit`` of a bucket can be among the first ``limit`` of all
    return ranked.withColumn("place", place).where(F.col("place") <= limit).orderBy("place", bucket).limit(limit)


#: Places that points and spans meet in; a span is repeated for each such stretch that it lies over.
STRETCH = 64


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str) -> DataFrame:
    """Each point with the innermost span of its key that holds it, or null: the one that starts last, of these the shortest, then the last name.

    Points and spans meet by key and stretch of STRETCH places, so that a point is held against the spans near it and not against all
    of its key.  A null place is in no span.
    """
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    laid = spans.where(F.col(start) <= F.col(end)).select(key, start, end, name, F.explode(F.sequence(stretch(start), stretch(end))).alias("__stretch"))
    asked = points.select(key, at).distinct().withColumn("__stretch", stretch(at))
    inside = asked.join(laid, [key, "__stretch"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).groupBy(key, at).agg(F.max_by(name, F.struct(start, -F.col(end), name)).alias(name))
    return points.join(inside, [key, at], "left")


def fallback_join(names: DataFrame, symbols: DataFrame, contents: DataFrame, name: str, most_files: int, keep: int, rank: Column) -> DataFrame:
    """name, path, source: where a name is a symbol; of the others, the first ``keep`` files by ``rank`` that mention it, none for
    names in over ``most_files`` files."""
    exact = names.join(symbols, name).select(name, "path", F.lit("symbol").alias("source"))
    missing = names.join(symbols.select(name).distinct(), name, "left_anti")
    found = missing.join(contents, name).select(name, "path").distinct()
    few = found.groupBy(name).count().where(F.col("count") <= most_files).select(name)
    place = F.row_number().over(Window.partitionBy(name).orderBy(rank, "path"))
    rest = found.join(few, name).withColumn("place", place).where(F.col("place") <= keep)
    return exact.unionByName(rest.select(name, "path", F.lit("content").alias("source")))


def suite_scores(cases: DataFrame, suite: str, passed: Column) -> DataFrame:
    """Cases, passed ones and their share, by suite."""
    return cases.groupBy(suite).agg(F.count("*").alias("n_cases"), F.count_if(passed).alias("n_passed"), F.round(F.avg(F.coalesce(passed, F.lit(False)).cast("double")), 6).alias("pass_rate"))


def log_statistics(lines: DataFrame, level: str, at: str, by: str) -> DataFrame:
    """Count, first and last time of each level of each log."""
    return lines.groupBy(by, level).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
