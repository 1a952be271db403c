"""Reading: browse and keyset pages, line slices, content hashes, predicates on JSON, arrays and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def browse(items: DataFrame, updated: str, id_col: str, limit: int, where: Column | None = None) -> DataFrame:
    """The newest rows first, equal times by id."""
    return (items if where is None else items.where(where)).orderBy(F.desc(updated), id_col).limit(limit)


def key_page(rows: DataFrame, key: str, after: str, limit: int, prefix: str | None = None) -> DataFrame:
    """The page that follows ``after`` in the bytewise order of a key; 1 to 1000 rows.  A prefix is plain text, not a pattern."""
    found = rows.where(F.col(key) > after)
    if prefix:
        found = found.where(F.col(key).startswith(prefix))
    return found.orderBy(key).limit(max(1, min(limit, 1000)))


def line_slice(text: Column, start: int, end: int, most: int = 200) -> Column:
    """Lines ``start`` to ``end`` of a text, counted from 1, ``most`` at most."""
    return F.array_join(F.slice(F.split(text, "\n"), start, min(end, start + most - 1) - start + 1), "\n")


def blob_sha1(text: Column) -> Column:
    """The hash that git gives a file with this text."""
    return F.sha1(F.concat(F.lit("blob "), F.octet_length(text).cast("string"), F.lit("\0"), text))


def json_equals(column: str, path: str, value: str) -> Column:
    return F.get_json_object(column, path) == value


def any_of(words: Column, wanted: list[str]) -> Column:
    """Whether an array overlaps a list."""
    return F.arrays_overlap(words, F.array(*map(F.lit, wanted)))


def all_of(words: Column, wanted: list[str]) -> Column:
    """Whether an array contains a whole list."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), words)) == 0


def name_rank(name: Column, qualified: Column, query: str) -> Column:
    """0 for an exact name, 1 for a prefix, 2 for a part, 3 where only the qualified name has it; else null.  Case doesn't count."""
    low, q = F.lower(name), query.lower()
    return F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(q), 2).when(F.lower(qualified).contains(q), 3)


def name_search(symbols: DataFrame, name: str, qualified: str, query: str, limit: int) -> DataFrame:
    """The best-named rows: by rank, length of the qualified name, then the qualified name itself."""
    ranked = symbols.withColumn("name_rank", name_rank(F.col(name), F.col(qualified), query)).where("name_rank IS NOT NULL")
    return ranked.orderBy("name_rank", F.length(qualified), qualified).limit(limit)
