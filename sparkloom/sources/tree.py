"""A folder of files as a table, and what changed in it since a stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: bytes looked at for a NUL, languages by ending and by whole name
HEAD = 8192
ENDINGS = {
    "py": "python", "pyi": "python", "cs": "csharp", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "sql": "sql", "md": "markdown", "rst": "text", "txt": "text",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "ini": "ini", "cfg": "ini", "xml": "xml", "csproj": "xml", "html": "html", "css": "css", "sh": "shell", "ps1": "powershell", "csv": "csv", "proto": "protobuf", "gradle": "gradle",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "makefile"}


def language(path: Column) -> Column:
    """By a file's name or ending, in any case; ``unknown`` for others."""
    base = F.lower(F.substring_index(path, "/", -1))
    of = lambda table, key: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return F.coalesce(of(NAMES, base), F.when(base.contains("."), of(ENDINGS, F.substring_index(base, ".", -1))), F.lit("unknown"))


def blob_hash(content: Column) -> Column:
    """The hash that git gives a file of these bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\0")), "utf-8"), content))


def read_tree(spark: SparkSession, folder: str, most_bytes: int = 1 << 20, glob: str | None = None) -> DataFrame:
    """path (below the folder), size, modified, language, status, blob_sha1, unix_sha1, text of every file.

    Executors list and read; a file's bytes leave with its row.  status: ``text``; ``binary``, with a NUL among its first bytes or no
    valid UTF-8; ``large``, over ``most_bytes``, of which neither text nor hashes are taken.  ``unix_sha1`` is the hash with line ends
    as LF, null where that is the same.  Spark's reader leaves out files without a byte.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    top = F.lit(folder.rstrip("/") + "/")
    # the scheme that the reader puts before a path may be spelled in several ways
    below = F.element_at(F.split(F.col("path"), F.concat(F.lit("\\Q"), F.regexp_replace(top, "^[a-z]+:/*", "/"), F.lit("\\E")), 2), 2)
    small = F.col("length") <= most_bytes
    content = F.when(small, F.col("content"))
    text = F.try_validate_utf8(content.cast("string"))
    binary = F.coalesce(F.locate("\0", F.substring(content, 1, HEAD).cast("string")) > 0, F.lit(False)) | (small & text.isNull())
    rows = raw.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), content.alias("content"), binary.alias("binary"), small.alias("small"), text.alias("text"))
    unix = F.when(~F.col("binary") & F.col("text").contains("\r\n"), blob_hash(F.encode(F.replace("text", F.lit("\r\n"), F.lit("\n")), "utf-8")))
    status = F.when(~F.col("small"), "large").when(F.col("binary"), "binary").otherwise("text")
    return rows.select("path", "size", "modified", language(F.col("path")).alias("language"), status.alias("status"), F.when(F.col("small"), blob_hash(F.col("content"))).alias("blob_sha1"), unix.alias("unix_sha1"), F.when(status == "text", F.col("text")).alias("text"))


def compare(tree: DataFrame, state: DataFrame) -> DataFrame:
    """path, change (added, changed, deleted) of a tree against a stored state (path, size, blob_sha1).

    A file whose line ends alone differ, so that its hash with LF is the stored one, is unchanged.  Large files have no hash: they are
    changed when their size is.
    """
    now = tree.select("path", F.col("size").alias("new_size"), F.col("blob_sha1").alias("new_sha1"), "unix_sha1")
    both = now.join(state.select("path", F.col("size").alias("old_size"), F.col("blob_sha1").alias("old_sha1")), "path", "full")
    same = F.when(F.col("new_sha1").isNull() | F.col("old_sha1").isNull(), F.col("new_size") == F.col("old_size")).otherwise((F.col("new_sha1") == F.col("old_sha1")) | F.coalesce(F.col("unix_sha1") == F.col("old_sha1"), F.lit(False)))
    change = F.when(F.col("new_size").isNull(), "deleted").when(F.col("old_size").isNull(), "added").when(~same, "changed")
    return both.select("path", change.alias("change")).where(F.col("change").isNotNull())
