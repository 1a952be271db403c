"""Names and paths that questions mention, and the files and symbols that they are.

Everything is found by keys: a path by each of its ends, a symbol by its lower-cased
name, a mention by the name itself.  Names in ordinary prose must match exactly, those
that are meant (in backticks, or given as hints) in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..storage import stage

# fixed values: endings of files, names of files without one, names that are none, words before and after a name that a request introduces
FILE_ENDING = r"\.(py|cs|ts|tsx|js|jsx|java|go|sql|md|json|ya?ml|toml)$"
BARE_FILES = {"README": "README.md", "CHANGELOG": "CHANGELOG.md", "CONTRIBUTING": "CONTRIBUTING.md", "LICENSE": "LICENSE", "Dockerfile": "Dockerfile", "Makefile": "Makefile"}
DOT_FILE = r"^\.(?:env(?:\.[\w-]+)?|gitignore|gitattributes|dockerignore|editorconfig)$"
NO_NAMES = "The This That What When Where Which How Why SQL API HTTP JSON URL TODO".split()
CALLED = r"\b(?:called|named)\s+`?([A-Za-z_]\w*)`?"
INTRODUCED = (
    r"(?i)\b(?:add|adds|adding|new|create|creates|creating|introduce|introduces)\b[^.?!\n`]{0,48}?`?\b([A-Za-z_]\w*)`?\s+(?:column|field|table|index|function|method|class|parameter|param|"
    r"attribute|property|endpoint|route|flag|setting|constant|variable|type|enum|event|tool|handler|job|check|state|status|key)\b"
)
# fixed values: a name in more files than this is a word, unless it is meant; files that stand for a name without a symbol
COMMON_FILES, FALLBACK_FILES = 12, 3
CONFIGURATION = ("yaml", "toml", "json", "ini", "dockerfile", "makefile", "shell")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _named(values: Column, kind: str, explicit: bool, order: int) -> Column:
    return F.transform(values, lambda v, i: F.struct(v.alias("entity"), F.lit(kind).alias("kind"), F.lit(explicit).alias("explicit"), F.lit(order).alias("order"), i.alias("i")))


def _bare(text: Column) -> Column:
    """Runs of path signs, without dots and dashes at their ends that close a sentence."""
    return F.filter(F.transform(_all(text, r"[\w./-]+"), lambda x: F.rtrim(x, F.lit("."))), lambda x: x != "")


def is_camel(word: Column) -> Column:
    return word.rlike("^[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*$|^[a-z]+[A-Z][A-Za-z0-9]*$")


def is_snake(word: Column) -> Column:
    return word.rlike("^[A-Za-z][A-Za-z0-9_]*[A-Za-z0-9]$") & word.contains("_") & ~word.contains("__")


def identifier_like(name: Column) -> Column:
    """With an underscore inside, a dot or a hump: not an ordinary word."""
    return name.rlike("[^_]_+[^_]|[.]|[a-z][A-Z]|^[A-Z][a-z0-9]+[A-Z]")


def extract(questions: DataFrame) -> DataFrame:
    """q, entity, kind (path or identifier), explicit, is_new, place of questions (q, text) and, where there are such columns, their
    hints (arrays symbols and paths); each once, in order of appearance by kind of mention, hints first.

    What stands in backticks is meant: a path if it has a slash or a file's ending, else a name up to its brackets.  In prose, paths
    are runs of path signs with a folder or a known ending; names have humps or underscores; parts of dotted names of over two letters
    count too.  ``is_new``: the text itself introduces the name.  A null text has none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    hints = {c: F.coalesce(F.col(c), none) if c in questions.columns else none for c in ("paths", "symbols")}
    file_like = lambda x: x.contains("/") | x.rlike(FILE_ENDING)
    # what is taken out of a text once, before its mentions become rows
    dots = F.filter(t.dotted(text), lambda x: x.contains(".") & ~x.rlike(FILE_ENDING))
    ticks = F.filter(F.transform(_all(text, r"`([^`\n]{1,200})`", 1), lambda x: F.trim(x)), lambda x: x != "")
    parts = {"introduced": F.concat(_all(text, CALLED, 1), _all(text, INTRODUCED, 1)), "ticked": ticks, "runs": _bare(text), "words": _all(text, r"\w+"), "dotted": dots, "paths": hints["paths"], "symbols": hints["symbols"]}
    once = questions.select("q", *(c.alias(name) for name, c in parts.items()))
    ticked, runs, words, dotted = (F.col(c) for c in ("ticked", "runs", "words", "dotted"))
    folder = lambda x: x.rlike(r"^[\w.-]+/") & ~x.contains("//") & x.rlike(r"[^/]\.[A-Za-z0-9]{1,8}$")
    paths = F.filter(runs, lambda x: folder(x) | (x.rlike(r"^[\w-]+\.[a-z]+$") & x.rlike(FILE_ENDING)))
    bare = F.create_map(*(F.lit(x) for kv in BARE_FILES.items() for x in kv))
    known = F.filter(F.transform(runs, lambda x: F.element_at(bare, F.regexp_replace(x, r"\.md$", ""))), lambda x: x.isNotNull())
    pieces = F.filter(F.flatten(F.transform(dotted, lambda x: F.split(x, "\\."))), lambda x: F.length(x) > 2)
    found = F.concat(
        _named(F.col("paths"), "path", True, 0), _named(F.col("symbols"), "identifier", True, 1), _named(F.filter(ticked, file_like), "path", True, 2),
        _named(F.transform(F.filter(ticked, lambda x: ~file_like(x)), lambda x: F.substring_index(x, "(", 1)), "identifier", True, 3), _named(paths, "path", False, 4), _named(known, "path", False, 5),
        _named(F.filter(runs, lambda x: x.rlike(DOT_FILE)), "path", False, 6), _named(F.filter(words, is_camel), "identifier", False, 7), _named(F.filter(words, is_snake), "identifier", False, 8), _named(pieces, "identifier", False, 9),
    )
    rows = once.select("q", "introduced", F.explode(found).alias("x")).select("q", "introduced", "x.*")
    own = F.trim("entity")
    trimmed = F.when(F.col("kind") == "path", F.rtrim(F.ltrim(own, F.lit("([{\"'")), F.lit(".,;:)]}\"'"))).otherwise(F.trim(own, F.lit(".,;:()[]{}\"'")))
    clean = rows.withColumn("entity", trimmed).where((F.col("entity") != "") & (F.length("entity") <= 200) & ~F.col("entity").isin(NO_NAMES))
    each = clean.groupBy("q", "kind", "entity").agg(F.max("explicit").alias("explicit"), F.min(F.struct("order", "i")).alias("at"), F.max(F.array_contains("introduced", F.col("entity"))).alias("introduced"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("at", "kind", "entity"))
    return each.select("q", "entity", "kind", "explicit", ((F.col("kind") == "identifier") & F.col("introduced")).alias("is_new"), place.alias("place"))


def path_ends(paths: DataFrame) -> DataFrame:
    """key, path: each path under itself and under what follows any of its slashes."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return paths.select(F.explode(ends).alias("key"), "path")


def matching_files(entities: DataFrame, files: DataFrame) -> DataFrame:
    """q, entity, path: files (path) that a named path is, or ends."""
    asked = entities.where("kind = 'path'").select("q", "entity", F.trim(F.col("entity"), F.lit("/")).alias("key")).where("key <> ''")
    return asked.join(path_ends(files.select("path").distinct()), "key").select("q", "entity", "path").distinct()


def matching_symbols(entities: DataFrame, symbols: DataFrame) -> DataFrame:
    """q, entity and the columns of symbols (path, name, qualified, kind, ...) that a name means.

    A dotted name is a qualified one, in any case; where there is none, its last part is a name.  A name in prose must have the
    symbol's case, and in capitals with an underscore can only be a variable or field.
    """
    asked = entities.where("kind = 'identifier'").select("q", "entity", "explicit", F.lower("entity").alias("low"))
    dotted = asked.where(F.col("entity").contains("."))
    by_qualified = dotted.join(symbols.withColumn("low", F.lower("qualified")), "low").drop("low")
    rest = asked.where(~F.col("entity").contains(".")).unionByName(dotted.join(by_qualified.select("q", "entity").distinct(), ["q", "entity"], "left_anti"))
    last = F.element_at(F.split("entity", "\\."), -1)
    by_name = rest.withColumn("low", F.lower(last)).join(symbols.withColumn("low", F.lower("name")), "low").drop("low")
    shouted = last.contains("_") & (last == F.upper(last)) & last.rlike("[A-Z]")
    exact = by_name.where(F.col("explicit") | ((last == F.col("name")) & (~shouted | F.col("kind").isin("variable", "field"))))
    return by_qualified.unionByName(exact).drop("explicit")


def mentioning_files(entities: DataFrame, matched: DataFrame, names: DataFrame) -> DataFrame:
    """q, entity, path, place: for names without a symbol, the first files whose text has them as a whole word, in their case.

    ``names`` (path, language, name, chunks): names of files with the number of chunks that hold each.  Migrations come first, then
    documents, configuration and others, and busier files before others.  A name that isn't meant and is in over COMMON_FILES files
    stands for none; a dotted name is tried whole, then by its last part.
    """
    open_ = entities.where("kind = 'identifier' AND NOT is_new").join(matched.select("q", "entity").distinct(), ["q", "entity"], "left_anti").where(F.length("entity") >= 3)
    last = F.element_at(F.split("entity", "\\."), -1)
    tried = F.array_compact(F.array(F.when(F.col("explicit") | identifier_like(F.col("entity")), F.col("entity")), F.when((last != F.col("entity")) & (F.length(last) >= 3) & (F.col("explicit") | identifier_like(last)), last)))
    asked = open_.select("q", "entity", "explicit", F.posexplode(tried).alias("turn", "name"))
    # those that are asked for are found once and written, as making names of texts takes long
    names = stage(names.join(asked.select("name").distinct(), "name", "left_semi"), "named")
    # counted first, so that a word of everyday is never paired with all its files
    spread = names.groupBy("name").agg(F.countDistinct("path").alias("n_files"))
    good = asked.join(spread, "name").where(F.col("explicit") | (F.col("n_files") <= COMMON_FILES))
    first = good.groupBy("q", "entity").agg(F.min(F.struct("turn", "name")).alias("best")).select("q", "entity", F.col("best.name").alias("name"))
    low = F.lower("path")
    kind = F.when(low.contains("migrations/") | low.contains("/alembic/") | (F.col("language") == "sql"), 0).when(low.rlike(r"\.(md|rst|txt|adoc)$|^docs/|/docs/"), 1).when(F.col("language").isin(*CONFIGURATION), 2).otherwise(3)
    # the best files of a name are the same for all questions
    top = names.join(first.select("name").distinct(), "name", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(kind, F.desc("chunks"), "path"))).where(F.col("place") <= FALLBACK_FILES)
    return first.join(top, "name").select("q", "entity", "path", "place")


def exact_retriever(questions: DataFrame, files: DataFrame, symbols: DataFrame, names: DataFrame, limit: int = 10) -> DataFrame:
    """q, id, rank: files and symbols that questions name, files by path first, then symbols (exported ones, then no variables or
    sections, by path) up to ``limit``; files that merely mention a name come after them, beyond the limit."""
    entities = stage(extract(questions), "entities")
    found_files = matching_files(entities, files).groupBy("q", "path").agg(F.min("entity").alias("entity"))
    meant = stage(matching_symbols(entities, symbols), "meant")
    mentions = mentioning_files(entities, meant, names).groupBy("q", "path").agg(F.min("place").alias("place"))
    later = F.col("kind").isin("variable", "section").cast("int")
    one = meant.groupBy("q", "path", "qualified").agg(F.min(F.struct((~F.col("exported")).cast("int").alias("hidden"), later.alias("later"))).alias("o"))
    none = F.lit(0)
    rows = found_files.select("q", F.concat(F.lit("file:"), "path").alias("id"), F.lit(0).alias("turn"), F.struct(none.alias("hidden"), none.alias("later"), "path", F.lit("").alias("qualified")).alias("o"))
    rows = rows.unionByName(one.select("q", F.concat(F.lit("symbol:"), "path", F.lit("::"), "qualified").alias("id"), F.lit(1).alias("turn"), F.struct(F.col("o.hidden").alias("hidden"), F.col("o.later").alias("later"), "path", "qualified").alias("o")))
    within = rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("turn", "o"))).where(F.col("n") <= limit)
    # a file named by its path isn't named again by a mention
    extra = mentions.join(found_files.select("q", "path"), ["q", "path"], "left_anti").select("q", F.concat(F.lit("file:"), "path").alias("id"), F.lit(2).alias("turn"), F.struct("place", none.alias("later"), "path", F.lit("").alias("qualified")).alias("o"))
    both = within.select("q", "id", "turn", F.struct("o.hidden", "o.later", "o.path", "o.qualified").alias("o")).unionByName(extra.select("q", "id", "turn", F.struct(F.col("o.place").alias("hidden"), "o.later", "o.path", "o.qualified").alias("o")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("turn", "o"))).select("q", "id", "rank")
