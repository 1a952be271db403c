"""Queries over files and their chunks: cutting, search by field, paths and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunks, content, covers, diffs
from ..storage import stage
from .files import files
from .registry import Tables, query
from .search_queries import _FILLER, _stem_sql, distinct, kept, tok


@query()
def file_chunks(spark, sf_dir):
    """All files in chunks; no SQL: a greedy walk over lines, tested against brute force."""
    done = chunks.file_chunks(files(Tables(spark, sf_dir)))
    return done.select("path", "language", "ordinal", "start_line", "end_line", "heading", F.sha2("text", 256).alias("text_sha256"), F.size("names").alias("n_names"))


@query()
def chunk_search(spark, sf_dir):
    """The benchmark's texts as questions to the chunks of all files; no SQL, as file_chunks; content_search holds the ranking against SQL."""
    d = Tables(spark, sf_dir)
    # written once: the search reads its chunks three times, and each reading would cut all files anew
    cut = stage(chunks.file_chunks(files(d)).select("path", "ordinal", "heading", "text", "names"), "chunks")
    return content.content_search(cut, _questions(d))


def _questions(d):
    """The benchmark's texts, each with a source and a number that files are named by."""
    k = F.col("item_id")
    return d.benchmark.select(k.alias("q"), F.concat("text", F.lit(" of src"), k % 10, F.lit(", ADR "), k).alias("text"))


def _sections(d):
    """Ten documents to a file, each a chunk with its first line as heading: chunks that SQL can make too."""
    path = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/adr-"), (F.col("doc_id") / 10).cast("long"), F.lit(".md"))
    text = F.coalesce("text", F.lit(""))
    return d.documents.select(path.alias("path"), (F.col("doc_id") % 10).alias("ordinal"), F.substring_index(text, "\n", 1).alias("heading"), text.alias("text"), t.names(text).alias("names"))


_ENDINGS = "|".join(t.FILE_ENDINGS)
_BARE = f"list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*'), lambda w: regexp_replace(w, '(?i)\\.(?:{_ENDINGS})$', ''))"
_NAMES = f"flatten(list_transform({_BARE}, lambda w: list_filter(list_concat(CASE WHEN contains(w, '.') THEN [w] ELSE [] END, string_split(w, '.')), lambda p: length(p) <= 120 AND (length(p) >= 3 OR contains(p, '.')))))"
_CHUNKS = f"""
bq AS (SELECT item_id, text || ' of src' || (item_id % 10) || ', ADR ' || item_id AS text FROM benchmark),
chunks AS (SELECT 'docs/' || coalesce(source, 'none') || '/adr-' || (doc_id // 10) || '.md' AS path, doc_id % 10 AS ordinal, split_part(coalesce(text, ''), chr(10), 1) AS heading, coalesce(text, '') AS text FROM documents),
qt AS (SELECT item_id AS q, {kept(tok('text'))} AS ts FROM bq),
qw AS (SELECT q, {_stem_sql('w')} AS term, min(pos) AS pos FROM (SELECT q, unnest(d) AS w, unnest(range(0, len(d))) AS pos FROM (SELECT q, ({distinct('ts')})[1:48] AS d FROM qt)) GROUP BY ALL),
tagged AS (SELECT path, ordinal, unnest({tok('text')}) AS w, 0 AS h, 0 AS p FROM chunks UNION ALL SELECT path, ordinal, unnest({tok('heading')}), 1, 0 FROM chunks UNION ALL SELECT path, ordinal, unnest({tok('path')}), 0, 1 FROM chunks),
post AS (SELECT path, ordinal, term, max(h) AS h, max(p) AS p FROM (SELECT path, ordinal, {_stem_sql('w')} AS term, h, p FROM tagged) WHERE term IN (SELECT term FROM qw) GROUP BY path, ordinal, term),
wt AS (SELECT q, term, idf, df <= 3 AS rare FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(idf, 9) DESC, pos) AS place FROM (
  SELECT q, term, pos, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM qw JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) USING (term), (SELECT count(*) AS n FROM chunks) WHERE df <= 0.5 * n)) WHERE place <= 10),
cn AS (SELECT path, ordinal, name FROM (SELECT path, ordinal, name, row_number() OVER (PARTITION BY path, ordinal ORDER BY min(pos)) AS r FROM (
  SELECT path, ordinal, unnest(ns) AS name, unnest(range(0, len(ns))) AS pos FROM (SELECT path, ordinal, {_NAMES} AS ns FROM chunks)) GROUP BY path, ordinal, name) WHERE r <= 300),
qn AS (SELECT q, name FROM (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY min(pos)) AS r FROM (
  SELECT item_id AS q, unnest(ns) AS name, unnest(range(0, len(ns))) AS pos FROM (SELECT item_id, {_NAMES} AS ns FROM bq)) WHERE regexp_matches(name, '[A-Za-z0-9]_[A-Za-z0-9]|[.]|[a-z][A-Z]') GROUP BY q, name) WHERE r <= 20),
hits AS (SELECT q, path, ordinal, sum(word)::BIGINT AS n_words, sum(rare)::BIGINT AS n_rare, max(named) AS named, round(sum(points), 6) AS score FROM (
  SELECT q, path, ordinal, 1 AS word, rare::INT AS rare, 0 AS named, idf * (1 + 0.5::DOUBLE * h + 0.4::DOUBLE * p) AS points FROM post JOIN wt USING (term)
  UNION ALL SELECT DISTINCT q, path, ordinal, 0, 0, 1, 2.5::DOUBLE FROM cn JOIN qn USING (name)) GROUP BY q, path, ordinal),
best AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY q, path) AS matches, row_number() OVER (PARTITION BY q, path ORDER BY score DESC, ordinal) AS of_file FROM hits) WHERE of_file = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, matches DESC, path) AS rank, max(score) OVER (PARTITION BY q) AS top FROM best),
enough AS (SELECT q, path, ordinal, n_words, matches, score, rank, top FROM placed LEFT JOIN (SELECT q, count(*) AS known FROM wt GROUP BY q) USING (q)
  WHERE score >= 0.3 * top AND (n_words >= greatest(1, least(2, coalesce(known, 0))) OR n_rare > 0 OR named > 0))
"""


@query(f"WITH {_CHUNKS} SELECT q, path, ordinal, n_words, matches, score, rank FROM enough WHERE rank <= 10")
def content_search(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return content.content_search(_sections(d), _questions(d))


def _match(a: str, b: str) -> str:
    n = f"greatest(4, least(length({a}), length({b})) - 1)"
    return f"({a} = {b} OR (least(length({a}), length({b})) >= 4 AND left({a}, {n}) = left({b}, {n})))"


def _covered(stems: str, words: str) -> str:
    return f"list_filter({stems}, lambda a: len(list_filter({words}, lambda w: {_match('a', _stem_sql('w'))})) > 0)"


_PATHS = f"""
qs AS (SELECT q, ({distinct('s')})[1:24] AS stems, numbers FROM (SELECT q, list_transform({distinct('ts')}, lambda t: {_stem_sql('t')}) AS s, numbers FROM (
  SELECT item_id AS q, list_filter(({distinct('k')})[1:72], lambda t: length(t) >= 4 AND NOT list_contains({_FILLER}, t) AND NOT list_contains({_FILLER}, {_stem_sql('t')})) AS ts,
    list_distinct(regexp_extract_all(text, '(?i)\\b(?:adr|rfc|decision)[ #-]*0*([0-9]+)', 1))[1:4] AS numbers FROM (SELECT item_id, text, {kept(tok('text'))} AS k FROM bq)))),
pf AS (SELECT DISTINCT path FROM chunks),
pw AS (SELECT path, {tok("translate(path, '/.-', '   ')")} AS words, regexp_extract(lower(path), '(?:^|/)(?:adr[-_ ]?)?0*([0-9]+)[-_. ][^/]*$', 1) AS number FROM pf),
named AS (SELECT q, path, list_contains(numbers, number)::INT AS numbered, {_covered('stems', 'words')} AS terms FROM qs, pw
  WHERE len(list_filter(stems, lambda s: contains(lower(path), s))) > 0 OR (list_contains(numbers, number) AND regexp_matches(lower(path), '(^|/)((adrs?|decisions?|rfcs?)/|adr[-_ ]?)0*[0-9]+[-_. ][^/]*$')))
"""


@query(f"WITH {_CHUNKS}, {_PATHS} SELECT q, path, numbered, array_to_string(terms, ' ') AS terms FROM named")
def path_search(spark, sf_dir):
    """Files whose path holds a stem of the question or the number that it names."""
    d = Tables(spark, sf_dir)
    return content.path_hits(_sections(d).select("path").distinct(), _questions(d)).withColumn("terms", F.array_join("terms", " "))


_RETRIEVED = """
shared AS (SELECT q, term, count(*) AS n_paths FROM (SELECT q, unnest(terms) AS term FROM named) GROUP BY ALL),
bonus AS (SELECT q, path, bonus FROM (SELECT n.q, n.path, 5.0::DOUBLE * numbered + CASE WHEN len(terms) >= 2 THEN 1.0::DOUBLE WHEN len(terms) = 1 AND n_paths <= 3 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS bonus
  FROM named n LEFT JOIN shared s ON s.q = n.q AND s.term = n.terms[1]) WHERE bonus > 0),
total AS (SELECT q, path, round(sum(points), 6) AS score FROM (SELECT q, path, score / max(score) OVER (PARTITION BY q) AS points FROM enough WHERE rank <= 20 UNION ALL SELECT q, path, bonus FROM bonus) GROUP BY q, path)
SELECT q, path, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, path) AS rank FROM total) WHERE rank <= 10
"""


@query(f"WITH {_CHUNKS}, {_PATHS}, {_RETRIEVED}")
def content_retriever(spark, sf_dir):
    """Hits by text and by file name in one list."""
    d = Tables(spark, sf_dir)
    return content.content_retriever(_sections(d), _questions(d))


@query()
def text_search(spark, sf_dir):
    """Two words or two others but not a fifth, out of each benchmark text, in documents with their first line as title; no SQL: tested
    against all stretches of small texts."""
    d = Tables(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    docs = d.documents.select(F.col("doc_id").alias("doc"), F.substring_index(text, "\n", 1).alias("title"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)").alias("body"))
    w = F.col("w")
    asked = F.concat_ws(" ", w[0], w[1], F.lit("or"), w[2], w[3], F.concat(F.lit("-"), w[4]))
    queries = d.benchmark.select(F.col("item_id").alias("q"), t.significant_terms(F.col("text"), 5).alias("w")).where(F.size("w") == 5).select("q", asked.alias("text"))
    return covers.text_search(docs, queries)


@query()
def file_diffs(spark, sf_dir):
    """All files against an edited version: lines moved, dropped, added or left as they are, by the text's length; no SQL: tested against
    dynamic programming."""
    before = files(Tables(spark, sf_dir)).select("path", "text")
    lines, k = F.split("text", "\n"), F.length("text") % 4
    moved = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.slice(lines, 1, 1))
    dropped = F.concat(F.filter(lines, lambda x: F.length(x) % 5 > 0), F.array(F.lit("one more line")))
    after = before.withColumn("text", F.when(k == 0, F.array_join(moved, "\n")).when(k == 1, F.array_join(dropped, "\n")).when(k == 2, None).otherwise(F.col("text")))
    done = diffs.file_diffs(before, after)
    return done.select("path", "additions", "deletions", F.size("hunks").alias("n_hunks"), F.sha2(F.to_json("hunks"), 256).alias("hunks_sha256"))
