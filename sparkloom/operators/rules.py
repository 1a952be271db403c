"""Rules over tables: line scans, legal moves, clamps, criteria, merged signals, accounts of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan_lines(texts: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, int, str]]) -> DataFrame:
    """id, line, rule, severity: the lines of each text that a rule (name, severity, regex) fits; lines count from 1."""
    lines = texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "body"))
    hits = F.filter(F.array(*(F.when(F.col("body").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in rules)), lambda h: h.isNotNull())
    return lines.select(id_col, (F.col("at") + 1).alias("line"), F.inline(hits))


def verdicts(findings: DataFrame, id_col: str) -> DataFrame:
    """id, n by severity 0 to 2, and the verdict of the worst: block, warn or note."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    worst = F.min("severity")
    return findings.groupBy(id_col).agg(n(0), n(1), n(2), F.when(worst == 0, "block").when(worst == 1, "warn").otherwise("note").alias("verdict"))


def line_diff(before: DataFrame, after: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, added, removed: lines by which two versions of a text differ, as multisets; carriage returns don't count."""
    def lines(df: DataFrame, sign: int) -> DataFrame:
        body = F.explode(F.split(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\r\n", "\n"), "\n"))
        return df.select(id_col, body.alias("line")).groupBy(id_col, "line").agg(F.count("*").alias("n")).withColumn("n", F.col("n") * sign)

    change = lines(before, -1).unionByName(lines(after, 1)).groupBy(id_col, "line").agg(F.sum("n").alias("n"))
    return change.groupBy(id_col).agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


def move_faults(history: DataFrame, item: str, order: str, state: str, legal: dict[str, list[str]], start: str) -> DataFrame:
    """Rows of a history whose state may not follow the one before; the first follows ``start``."""
    before = F.coalesce(F.lag(state).over(Window.partitionBy(item).orderBy(order)), F.lit(start))
    pairs = [F.lit(f"{a}>{b}") for a, to in legal.items() for b in to]
    return history.withColumn("before", before).where(~F.array_contains(F.array(*pairs), F.concat_ws(">", "before", state)))


def funnel(history: DataFrame, item: str, state: str, stages: list[str]) -> DataFrame:
    """stage, n: how many items ever came to each stage."""
    return history.where(F.col(state).isin(stages)).groupBy(F.col(state).alias("stage")).agg(F.countDistinct(item).alias("n"))


def clamped(rank: Column, ceilings: dict[str, int], origin: Column, default: int) -> Column:
    """A state's rank, at most its origin's ceiling."""
    ceiling = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ceilings.items() for x in kv)), origin), F.lit(default))
    return F.least(rank, ceiling)


def merged_signals(signals: DataFrame, by: str, largest: list[str], any_of: list[str]) -> DataFrame:
    """One row a key: the largest of some signals, whether any of others is set."""
    return signals.groupBy(by).agg(*(F.max(c).alias(c) for c in largest), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in any_of))


def criteria(facts: DataFrame, by: str, tests: dict[str, Column]) -> DataFrame:
    """Whether each criterion holds for all rows of a key, and whether all do."""
    each = {n: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)) for n, c in tests.items()}
    done = facts.groupBy(by).agg(*(c.alias(n) for n, c in each.items()))
    accepted = F.lit(True)
    for n in each:
        accepted = accepted & F.col(n)
    return done.withColumn("accepted", accepted)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break rules, with the broken ones' names in order."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)


def call_accounts(calls: DataFrame, by: list[str], latency: str, tokens: str, failed: Column) -> DataFrame:
    """Calls, failures, tokens, and mean and largest latency."""
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.count_if(failed).alias("n_failed"), F.sum(tokens).alias("tokens"), F.round(F.avg(latency), 4).alias("mean_latency"), F.max(latency).alias("max_latency"))


def totals(rows: DataFrame, whole: str, part: str) -> DataFrame:
    """n, whole, part and empty over the rows whose part is known."""
    return rows.where(F.col(part).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(whole), F.lit(0)).alias("whole"), F.coalesce(F.sum(part), F.lit(0)).alias("part"), (F.count("*") == 0).alias("empty"))


def area_relations(edges: DataFrame, area: DataFrame) -> DataFrame:
    """area, n_in, n_out, n_within: edges (src, dst) by the areas (node, area) of their ends."""
    met = edges.join(area.select(F.col("node").alias("src"), F.col("area").alias("a")), "src").join(area.select(F.col("node").alias("dst"), F.col("area").alias("b")), "dst").groupBy("a", "b").agg(F.count("*").alias("n"))
    sides = met.select(F.col("a").alias("area"), F.when(F.col("a") == F.col("b"), "within").otherwise("out").alias("way"), "n").unionByName(met.where("a <> b").select(F.col("b").alias("area"), F.lit("in").alias("way"), "n"))
    of = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("n"))), F.lit(0)).alias(f"n_{way}")
    return sides.groupBy("area").agg(of("in"), of("out"), of("within"))


def through_hubs(imports: DataFrame, hubs: DataFrame) -> DataFrame:
    """src, dst: imports, and what lies behind imported hubs (re-exporting files) one hop further.

    Hubs give what they import as arrays, as long as one file's imports.  These are dealt to their importers, and become pairs, of which
    each stays once, only where all of an importer meets.
    """
    own = imports.select("src", "dst").distinct()
    given = imports.select(F.col("src").alias("hub"), "dst").join(hubs.select(F.col("node").alias("hub")).distinct(), "hub", "left_semi").groupBy("hub").agg(F.collect_set("dst").alias("dsts"))
    behind = own.select("src", F.col("dst").alias("hub")).join(given, "hub").select("src", F.array_remove("dsts", F.col("src")).alias("dsts"))
    return own.select("src", F.array("dst").alias("dsts")).unionByName(behind).repartition("src").select("src", F.explode("dsts").alias("dst")).distinct()


def named_importers(imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """src, dst, name: who imports a wanted name (dst, name) by its name or with a star; ``imports`` has names as an array."""
    met = imports.join(wanted, "dst").where(F.array_contains("names", F.col("name")) | F.array_contains("names", F.lit("*")))
    return met.select("src", "dst", "name").distinct()


def entity_symbols(entities: DataFrame, symbols: DataFrame) -> DataFrame:
    """entity, name, id: symbols by name without case; entities from prose (hint is false) must match exactly, and names all in
    capitals only constants."""
    met = entities.join(symbols, F.lower("entity") == F.lower("name"))
    exact = F.col("hint") | (F.col("entity") == F.col("name"))
    capitals = F.col("entity").rlike("^[A-Z][A-Z0-9_]*_[A-Z0-9_]*$")
    return met.where(exact & (~capitals | (F.col("kind") == "constant"))).select("entity", "name", "id")


def rare_terms(terms: DataFrame, names: DataFrame, most: int = 40, keep: int = 12) -> DataFrame:
    """q, term, weight: of each question the ``keep`` rarest terms that at most ``most`` names have, weighing 1 / log2(2 + df)."""
    df = names.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.countDistinct("id").alias("df")).where(F.col("df") <= most)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("df", "term"))
    return terms.join(df, "term").withColumn("rank", rank).where(F.col("rank") <= keep).select("q", "term", F.round(1 / F.log2(F.col("df") + 2), 6).alias("weight"))


def hashed_vector(texts: DataFrame, id_col: str, words: Column, dims: int = 256) -> DataFrame:
    """id, dim, value: word counts hashed to signed dimensions, 1 + ln(tf) each, of length 1; a text without words has none."""
    h = F.md5("word")
    counts = texts.select(id_col, F.explode(words).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("tf"))
    part = lambda at: F.conv(F.substring(h, at, 6), 16, 10).cast("long")
    signed = F.when(part(7) % 2 == 0, 1.0).otherwise(-1.0) * (1 + F.log(F.col("tf").cast("double")))
    raw = counts.select(id_col, (part(1) % dims).alias("dim"), signed.alias("x")).groupBy(id_col, "dim").agg(F.sum("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(id_col)))
    return raw.withColumn("norm", norm).where("norm > 0").select(id_col, "dim", F.round(F.col("x") / F.col("norm"), 5).alias("value")).where("abs(value) > 0")
