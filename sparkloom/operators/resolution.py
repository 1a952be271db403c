"""What calls and imports mean: resolution of names, and doing over only what a change of files can have changed.

Tables: calls (src, file, name), symbols (name, file, symbol), imports (file,
imported), wanted keys (src, key) and their providers (key, dst).  Resolved calls
keep file and name, so that they can be replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

# fixed values: confidence of a call to a symbol of its own file, of an imported file, of the only symbol of that name, and of a name alone
OWN, IMPORTED, ONLY, UNKNOWN = 0.95, 0.8, 0.3, 0.2


# names of a file are found in so many parts of what another defines
PARTS = 64


def _defined(symbols: DataFrame) -> DataFrame:
    """name, file, symbol of the symbols that files define, dealt by file; all that reads them shares one shuffle."""
    return symbols.select("name", "file", "symbol").where("name IS NOT NULL AND file IS NOT NULL AND symbol IS NOT NULL").repartition("file").distinct()


def only_symbols(symbols: DataFrame) -> DataFrame:
    """name, symbol of names that one symbol has; names are counted before anything is paired."""
    loose = symbols.select("name", "file", "symbol").where("name IS NOT NULL AND file IS NULL AND symbol IS NOT NULL").distinct()
    return _defined(symbols).unionByName(loose).groupBy("name").agg(F.count("*").alias("n"), F.first("symbol").alias("symbol")).where("n = 1").select("name", "symbol")


def _definitions(symbols: DataFrame) -> DataFrame:
    """file, hashes, parts: what a file defines in one row, as hashes of names and as PARTS arrays of (h, name, symbol), by hash."""
    each = _defined(symbols).withColumn("h", F.hash("name"))
    parts = each.groupBy("file", F.pmod("h", F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("h", "name", "symbol")).alias("own"))
    whole = parts.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("part", "own"))).alias("of"))
    none = F.array().cast("array<struct<h:int,name:string,symbol:string>>")
    dense = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.coalesce(F.element_at("of", k), none))
    return whole.select("file", F.flatten(F.transform(F.map_values("of"), lambda x: x["h"])).alias("hashes"), dense.alias("parts"))


def _joined(strings: Column) -> Column:
    """One string of several, which is far shorter in a shuffle than an array of them."""
    return F.array_join(F.transform(strings, lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))), "\n")


def _parted(joined: Column) -> Column:
    """The strings of ``_joined``, which were one at least."""
    return F.transform(F.split(joined, "\n"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def _packed_targets(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """src, file, name, dsts, confidence: each call's surest targets in one row, dealt by file.

    A file asks itself and the files that it imports for all its names at once, and each answers in one row, so that what travels is
    packed: hashes on the way there, names and symbols on the way back.  Answers that only a hash called for meet no call.
    Rows stay with their file from then on.  Rows are as long as what a file calls, or its own and imported files define.
    """
    # written, as they are read twice and few beside the calls
    places = stage(calls.select("file", "name").distinct(), "places")
    asked = places.where("file IS NOT NULL AND name IS NOT NULL").groupBy("file").agg(F.collect_set(F.hash("name")).alias("names"))
    linked = imports.select("file", "imported").where("file <> imported").repartition("file").distinct().join(asked, "file")
    to = linked.select(F.col("imported").alias("at"), "file", "names").unionByName(asked.select(F.col("file").alias("at"), "file", "names"))
    answer = lambda h: F.filter(F.get("parts", F.pmod(h, F.lit(PARTS))), lambda x: x["h"] == h)
    met = to.join(_definitions(symbols).withColumnRenamed("file", "at"), "at").withColumn("known", F.array_intersect("names", "hashes")).where(F.size("known") > 0)
    found = met.select("file", F.when(F.col("at") == F.col("file"), OWN).otherwise(IMPORTED).alias("sure"), F.flatten(F.transform("known", answer)).alias("x"))
    answers = found.select("file", "sure", _joined(F.col("x.name")).alias("names"), _joined(F.col("x.symbol")).alias("symbols"))
    only = places.join(only_symbols(symbols), "name").select("file", F.lit(ONLY).alias("sure"), _joined(F.array("name")).alias("names"), _joined(F.array("symbol")).alias("symbols"))
    each = answers.unionByName(only).repartition("file").select("file", "sure", F.explode(F.arrays_zip(_parted(F.col("names")).alias("name"), _parted(F.col("symbols")).alias("symbol"))).alias("x"))
    given = each.select("file", "x.name", F.lit(None).cast("string").alias("src"), "sure", "x.symbol")
    callers = calls.select("file", "name", "src").repartition("file").distinct().withColumns({"sure": F.lit(None).cast("double"), "symbol": F.lit(None).cast("string")})
    place = Window.partitionBy("file", "name")
    best = callers.unionByName(given).withColumn("best", F.max("sure").over(place)).withColumn("dsts", F.collect_set(F.when(F.col("sure") == F.col("best"), F.col("symbol"))).over(place)).where("sure IS NULL")
    dsts = F.when(F.col("best").isNotNull(), F.col("dsts")).otherwise(F.array(F.concat(F.lit("callee:"), F.col("name"))))
    return best.select("src", "file", "name", dsts.alias("dsts"), F.coalesce("best", F.lit(UNKNOWN)).alias("confidence"))


def call_targets(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """src, file, name, dst, confidence: each call's surest targets, or the placeholder ``callee:name``.

    Symbols of the call's own file come before those of imported files, these before the only symbol of the name in all files.
    Callers and definitions meet by file and name, never by a name that many share.
    """
    return _packed_targets(calls, symbols, imports).select("src", "file", "name", F.explode("dsts").alias("dst"), "confidence")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst, confidence: the surest of several calls from one place to another.

    A place that calls from one file alone is done with where that file's calls lie; only targets of places in several files are
    dealt out again, by place.
    """
    files = calls.groupBy("src").agg(F.min("file").alias("a"), F.max("file").alias("b"), F.count("*").alias("n"), F.count("file").alias("named"))
    several = stage(files.where("a <> b OR (named > 0 AND named < n)").select(F.col("src").alias("several")), "several")
    surest = lambda df, *by: df.groupBy(*by, "src", "dst").agg(F.max("confidence").alias("confidence")).select("src", "dst", "confidence")
    if several.isEmpty():
        return surest(call_targets(calls, symbols, imports), "file")
    of = lambda how: calls.join(several, F.col("src").eqNullSafe(F.col("several")), how)
    return surest(call_targets(of("left_anti"), symbols, imports), "file").unionByName(surest(call_targets(of("left_semi"), symbols, imports)))


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    """The different rows of either side, dealt by file: ``old`` and ``new`` say which sides have each."""
    rows = old.withColumns({"old": F.lit(True), "new": F.lit(False)}).unionByName(new.withColumns({"old": F.lit(False), "new": F.lit(True)}))
    return rows.repartition("file").groupBy(*old.columns).agg(F.max("old").alias("old"), F.max("new").alias("new"))


def _affected_places(calls: DataFrame, old_symbols: DataFrame, symbols: DataFrame, old_imports: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """file, whole, names: a row for each file in which targets may differ, of all names if ``whole``, else of those with hashes in ``names``.

    Whole are changed files and those whose imports differ.  In others it is names whose symbols differ in the file or one that it
    imports, and names that have become, or ceased to be, one symbol's alone.
    """
    pick = lambda df: df.select("name", "file", "symbol")
    both = _both(pick(old_symbols), pick(symbols))
    moved = both.where("old <> new").select("file", "name").distinct()
    # the only symbol of a name, before and after
    one = lambda side: F.when(F.count(F.when(F.col(side), 1)) == 1, F.first(F.when(F.col(side), F.struct("symbol")), True))
    turned = both.groupBy("name").agg(one("old").alias("before"), one("new").alias("after")).where("NOT (before <=> after)").select(F.lit(None).cast("string").alias("file"), "name")
    # one pass over the symbols gives both
    apart = stage(moved.withColumn("turned", F.lit(False)).unionByName(turned.withColumn("turned", F.lit(True))), "moved")
    moved, turned = apart.where("NOT turned").select("file", F.hash("name").alias("h")), apart.where("turned").select("name")
    linked = _both(old_imports.select("file", "imported"), imports.select("file", "imported")).where("old <> new").select("file")
    whole = stage(changed.select("file").unionByName(linked).distinct(), "whole")
    packed = moved.groupBy(F.col("file").alias("imported")).agg(F.collect_set("h").alias("names"))
    near = imports.select("file", "imported").distinct().join(whole, "file", "left_anti").join(packed, "imported").select("file", F.lit(False).alias("whole"), "names")
    own = moved.select("file", F.lit(False).alias("whole"), F.array("h").alias("names"))
    alone = calls.join(turned, "name", "left_semi").select("file", F.hash("name").alias("h")).distinct().select("file", F.lit(False).alias("whole"), F.array("h").alias("names"))
    every = whole.select("file", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("names"))
    return every.unionByName(own).unionByName(near).unionByName(alone).repartition("file").groupBy("file").agg(F.max("whole").alias("whole"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))


def _reached(rows: DataFrame, places: DataFrame, others: bool = False) -> DataFrame:
    """The rows that a change reaches, or the others, by their file and name; without a file a row is always reached."""
    at = places.withColumnRenamed("file", "at")
    met = F.col("file").isNull() | (F.col("at").isNotNull() & (F.col("whole") | F.array_contains("names", F.hash("name"))))
    return rows.join(at, F.col("file") == F.col("at"), "left").where(~met if others else met).select(rows.columns)


def affected_calls(calls: DataFrame, old_symbols: DataFrame, symbols: DataFrame, old_imports: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """src, file, name of the calls whose targets may differ from before: those in a changed file (file), in one whose imports differ, in
    one that imports a file where the name's symbols differ, and all of a name that has become, or ceased to be, one symbol's alone."""
    places = _affected_places(calls, old_symbols, symbols, old_imports, imports, changed)
    return _reached(calls.select("src", "file", "name"), places).distinct()


def re_resolve_calls(
    resolved: DataFrame, calls: DataFrame, old_symbols: DataFrame, symbols: DataFrame, old_imports: DataFrame, imports: DataFrame, changed: DataFrame
) -> DataFrame:
    """``resolved`` (src, file, name, dst, confidence) brought up to changed files: equal to resolving all calls anew.

    Only affected calls are resolved; rows of changed files and of affected calls are replaced, all others stay as they are.  Deleted
    files are changed ones without calls, symbols and imports.  A change reaches calls and ``resolved`` by file and name alone, so each
    meets a row for each file.
    """
    places = stage(_affected_places(calls, old_symbols, symbols, old_imports, imports, changed), "reached")
    again = stage(_reached(calls.select("src", "file", "name"), places).distinct(), "affected")
    kept = _reached(resolved.select("src", "file", "name", "dst", "confidence"), places, True)
    return kept.unionByName(call_targets(again, symbols, imports))


def _differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that one side lacks."""
    a, b = old.distinct(), new.distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def import_targets(wanted: DataFrame, provided: DataFrame, most: int = 8) -> DataFrame:
    """src, key, dst, confidence: each wanted key to its providers, 1.0 if one, 0.6 if several, ``external:key`` at 0.2 if none or over ``most``."""
    each = provided.distinct()
    counts = each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    usable = each.join(counts, "key")
    met = wanted.distinct().join(usable, "key", "left")
    confidence = F.when(F.col("n").isNull(), UNKNOWN).when(F.col("n") == 1, 1.0).otherwise(0.6)
    return met.select("src", "key", F.coalesce("dst", F.concat(F.lit("external:"), F.col("key"))).alias("dst"), confidence.alias("confidence"))


def re_resolve_imports(resolved: DataFrame, wanted: DataFrame, old_provided: DataFrame, provided: DataFrame, changed: DataFrame, most: int = 8) -> DataFrame:
    """``resolved`` (src, key, dst, confidence) brought up to changed sources (src) and providers: equal to resolving all keys anew."""
    moved = stage(_differences(old_provided, provided).select("key").distinct(), "moved")
    own = wanted.distinct()
    again = stage(own.join(moved, "key", "left_semi").unionByName(own.join(changed.select("src").distinct(), "src", "left_semi")).distinct(), "affected")
    kept = resolved.join(changed.select("src").distinct(), "src", "left_anti").join(moved, "key", "left_anti")
    return kept.select("src", "key", "dst", "confidence").unionByName(import_targets(again, provided.join(again.select("key").distinct(), "key", "left_semi"), most))
