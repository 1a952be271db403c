"""Symbols, calls and imports of source files as tables, and the calls resolved through them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import in_batches
from ..functions import text as t
from ..functions.source import facts
from .resolution import import_targets, resolve_calls

#: Texts that are taken out of an Arrow batch together.
SLICE = 64
FACTS = "path string, language string, fact string, kind string, name string, qualified string, start_line int, end_line int, detail string"

SCHEMA = pa.schema([*((c, pa.string()) for c in ("path", "language", "fact", "kind", "name", "qualified")), ("start_line", pa.int32()), ("end_line", pa.int32()), ("detail", pa.string())])


def source_facts(files: DataFrame, *wanted: str) -> DataFrame:
    """Facts of files (path, language, text), of all kinds or those ``wanted``: one Arrow pass where they lie, a text at a time.

    Null texts and unknown languages have none.  Text that doesn't parse gives what can be told: brackets that never close end with
    the text.  Repeated rows give repeated facts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for path, language, text in zip(*(c.to_pylist() for c in batch.slice(k, SLICE).columns), strict=True):
                    for fact in facts(language, text or "", wanted or None):
                        yield path, language, *fact

    return files.select("path", "language", "text").mapInArrow(lambda batches: in_batches(rows(batches), SCHEMA), FACTS)


def symbol_key(path, qualified):
    return F.when(qualified != "", F.concat(F.lit("symbol:"), path, F.lit("::"), qualified)).otherwise(F.concat(F.lit("file:"), path))


def provided_keys(found: DataFrame) -> DataFrame:
    """key, dst: the names under which files can be imported: Python modules by every end of their path, packages and their types, script
    files by their path without its ending."""
    paths = found.select("path", "language").distinct()
    python = paths.where("language = 'python'").select(F.explode(t.suffix_keys(F.regexp_replace("path", "/__init__\\.py$", ".py"))).alias("key"), "path")
    script = paths.where("language IN ('typescript', 'javascript')").select(F.regexp_replace("path", "(/index)?\\.[a-z]+$", "").alias("key"), "path")
    package = found.where("fact = 'provides'").select("path", F.col("name").alias("package"))
    types = found.where("fact = 'symbol' AND language IN ('java', 'csharp') AND kind IN ('class', 'interface', 'enum', 'struct')").join(package, "path").select(F.concat_ws(".", "package", "name").alias("key"), "path")
    namespaces = found.where("fact = 'provides' AND language = 'csharp'").select(F.col("name").alias("key"), "path")
    return python.unionByName(script).unionByName(types).unionByName(namespaces).select("key", F.concat(F.lit("file:"), F.col("path")).alias("dst")).distinct()


def wanted_keys(found: DataFrame) -> DataFrame:
    """src, key of imports: what a statement names, and in Python each name in it as a module of its own; leading dots go up from the file."""
    own = found.where("fact = 'import'").select("path", "language", "name", "detail")
    folders = F.split("path", "/")
    dots = F.length(F.regexp_extract("name", "^\\.*", 0))
    above = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots, F.lit(0))), ".")
    rest = F.regexp_replace("name", "^\\.+", "")
    module = F.when(dots > 0, F.concat_ws(".", F.when(above != "", above), F.when(rest != "", rest))).otherwise(F.col("name"))
    python = own.where("language = 'python'").select("path", module.alias("module"), F.filter(F.split("detail", ","), lambda x: ~x.isin("", "*")).alias("names"))
    inner = python.select("path", F.explode(F.concat(F.array("module"), F.transform("names", lambda x: F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), x)))).alias("key"))
    # a relative path of a script: folders that .. leaves are dropped one by one
    base = F.array_join(F.slice(folders, F.lit(1), F.size(folders) - 1), "/")
    parts = F.split(F.concat_ws("/", F.when(base != "", base), F.col("name")), "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x.isin(".", ""), a).when((x == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    script = own.where("language IN ('typescript', 'javascript')").select("path", F.when(F.col("name").startswith("."), F.regexp_replace(F.array_join(walked, "/"), "(/index)?(\\.[jt]sx?)?$", "")).otherwise(F.col("name")).alias("key"))
    other = own.where("language NOT IN ('python', 'typescript', 'javascript')").select("path", F.col("name").alias("key"))
    return inner.unionByName(script).unionByName(other).where("key <> ''").select(F.concat(F.lit("file:"), F.col("path")).alias("src"), "key").distinct()


def import_edges(found: DataFrame) -> DataFrame:
    """src, key, dst, confidence of imports, and of those that nobody provides ``external:key``; a file doesn't import itself."""
    return import_targets(wanted_keys(found), provided_keys(found)).where("src <> dst")


def call_edges(found: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst, confidence of calls: from the symbol or file that they stand in to the symbol that they mean."""
    calls = found.where("fact = 'call' AND kind = 'calls'").select(symbol_key(F.col("path"), F.col("qualified")).alias("src"), F.col("path").alias("file"), "name")
    symbols = found.where("fact = 'symbol'").select("name", F.col("path").alias("file"), symbol_key(F.col("path"), F.col("qualified")).alias("symbol"))
    known = imports.where(F.col("dst").startswith("file:")).select(F.expr("substring(src, 6)").alias("file"), F.expr("substring(dst, 6)").alias("imported")).distinct()
    return resolve_calls(calls, symbols, known)
