"""Full-text search with a query syntax, ranked by the density of covers.

A query is alternatives joined by ``or``; an alternative is words and "phrases"
that must all be there, and -words or -"phrases" that must not.  A cover is a
shortest stretch of a text that satisfies an alternative: it contains no other.
Each cover counts the mean weight of its words, less the more others stand between.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..storage import stage
from .search import top_k

# fixed values: weights of a word in a title and in a body
TITLE, BODY = 1.0, 0.1


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def parsed(queries: DataFrame) -> DataFrame:
    """q, clause, item, excluded, place, n_words, term: a row for each word of queries (q, text) that isn't a stop word.

    Several words in one item, in quotes or joined by signs, are a phrase; a stop word in it keeps its place.
    """
    items = F.regexp_extract_all(F.col("text"), F.lit('-?"[^"]*"|[^\\s"]+'), F.lit(0))
    split = queries.select("q", items.alias("items")).withColumn("is_or", F.transform("items", lambda x: F.lower(x) == "or"))
    clause = F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.size(F.filter(F.slice("is_or", F.lit(1), i), lambda x: x)))
    rows = split.where(F.size("items") > 0).select("q", F.posexplode(F.arrays_zip("items", "is_or", clause.alias("clause"))).alias("item", "x")).where(~F.col("x.is_or"))
    each = rows.select("q", "x.clause", "item", F.col("x.items").startswith("-").alias("excluded"), F.posexplode(words(F.col("x.items"))).alias("place", "word"))
    kept = each.where(~F.array_contains(t.strings(t.STOP_WORDS), F.col("word")))
    sizes = kept.groupBy("q", "clause", "item").agg(F.count("*").alias("n_words"))
    return kept.join(sizes, ["q", "clause", "item"]).select("q", "clause", "item", "excluded", "place", "n_words", t.stem(F.col("word")).alias("term"))


def positions(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc, term, pos, weight: where the stems in ``terms`` stand in docs (doc, title, body); a body's words come after its title's.

    The title's words are counted before words become rows: beside the generator they would be counted anew for every word.
    """
    title, body = (words(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "body"))
    held = docs.select("doc", F.size(title).alias("n_title"), F.concat(title, body).alias("words"))
    each = held.select("doc", "n_title", F.posexplode("words").alias("pos", "word"))
    found = t.of_stems(each, "word", terms)
    return found.select("doc", "term", "pos", F.when(F.col("pos") < F.col("n_title"), TITLE).otherwise(BODY).alias("weight"))


def covers(found: list[tuple[int, int, int, int, list, list]], sizes: dict[int, int]) -> tuple[int, int, int, float]:
    """Number of covers, ends of the shortest and summed density, of occurrences (end, start, clause, item, positions, weights)."""
    weight_at = {p: w for *_, ps, ws in found for p, w in zip(ps, ws, strict=True)}
    at = sorted(weight_at)
    inverse = [0.0, *accumulate(1 / weight_at[p] for p in at)]
    last: dict[int, dict[int, int]] = {}
    n, before, shortest, density = 0, -1, None, 0.0
    for end, here in groupby(sorted(f[:4] for f in found), key=lambda f: f[0]):
        for _, start, clause, item in here:
            own = last.setdefault(clause, {})
            own[item] = max(start, own.get(item, -1))
        begin = max((min(own.values()) for clause, own in last.items() if len(own) == sizes[clause]), default=-1)
        if begin <= before:
            continue  # no alternative is satisfied, or the stretch holds the cover before
        before = begin
        i, j = bisect_left(at, begin), bisect_right(at, end)
        noise = max(end - begin - (j - i - 1), 0)
        n += 1
        density += (j - i) / (inverse[j] - inverse[i]) / (1 + noise)
        if shortest is None or end - begin < shortest[1] - shortest[0]:
            shortest = begin, end
    return n, *shortest, density


FOUND = "q bigint, doc bigint, n_covers int, first int, last int, score double"


def cover_search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """q, doc, n_covers, first, last, score of every document that satisfies a query; first and last are the words of the shortest cover.

    Words are compared by stem; an alternative without a word that must be there matches nothing.  Null titles and bodies have no words.  A document's occurrences of a
    query are one row, and no longer than the document.
    """
    asked = stage(parsed(queries), "asked")
    index = stage(positions(docs, asked), "positions")
    met = index.join(asked, "term")
    key = ["q", "doc", "clause", "item", "excluded"]
    at = F.struct("pos", "weight")
    # a single word stands where it stands; only words of phrases have to meet
    single = met.where("n_words = 1").select(*key, F.col("pos").alias("start"), F.col("pos").alias("end"), F.array(at).alias("at"))
    phrases = met.where("n_words > 1").groupBy(*key, (F.col("pos") - F.col("place")).alias("base"), "n_words").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sort_array(F.collect_list(at)).alias("at"), F.count("*").alias("n"))
    hits = stage(single.unionByName(phrases.where(F.col("n") == F.col("n_words")).select(single.columns)), "occurrences")
    needed = asked.where(~F.col("excluded")).groupBy("q", "clause").agg(F.countDistinct("item").cast("int").alias("needed"))
    state = hits.groupBy("q", "doc", "clause").agg(F.countDistinct(F.when(~F.col("excluded"), F.col("item"))).alias("has"), F.max("excluded").alias("barred"))
    good = state.join(F.broadcast(needed), ["q", "clause"]).where(~F.col("barred") & (F.col("has") == F.col("needed"))).select("q", "doc", "clause", "needed")
    rows = hits.where(~F.col("excluded")).join(good, ["q", "doc", "clause"])
    each = F.struct("end", "start", "clause", "item", F.col("at.pos").alias("pos"), F.col("at.weight").alias("weight"), "needed")
    grouped = rows.groupBy("q", "doc").agg(F.collect_list(each).alias("found")).select(F.col("q").cast("long"), F.col("doc").cast("long"), "found")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            # nested values are taken a column at a time, not a row at a time
            bounds, each = batch.column(2).offsets.to_pylist(), batch.column(2).values
            end, start, clause, item, needed = (each.field(c).to_pylist() for c in ("end", "start", "clause", "item", "needed"))
            cuts = each.field("pos").offsets.to_pylist()
            pos, weight = each.field("pos").values.to_pylist(), each.field("weight").values.to_pylist()
            for q, doc, i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds, bounds[1:]):
                occurrences = [(end[k], start[k], clause[k], item[k], pos[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]]) for k in range(i, j)]
                out.append((q, doc, *covers(occurrences, dict(zip(clause[i:j], needed[i:j], strict=True)))))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], x) for k, x in enumerate(types)], [f.split()[0] for f in FOUND.split(", ")])

    return grouped.mapInArrow(step, FOUND).withColumn("score", F.round("score", 6))


def text_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k documents of each query with the densest covers."""
    return top_k(cover_search(docs, queries), k)
