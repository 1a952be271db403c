"""Queries over text: terms, ranking, fusion, copies, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import search
from .registry import Tables, query

# DuckDB's side of the token functions
_HUMPS = r"string_split(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')"


def tok(x: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all(replace({x}, '_', ' '), '[A-Za-z0-9]+'), lambda w: CASE WHEN len({_HUMPS}) > 1
      THEN list_concat([lower(w)], list_transform({_HUMPS}, lambda p: lower(p))) ELSE [lower(w)] END))"""


def distinct(x: str) -> str:
    """Distinct elements in the order of their first appearance."""
    return f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda z: list_position({x}, z[1]) = z[2]), lambda z: z[1])"


_STOP = "[" + ", ".join(f"'{w}'" for w in t.STOP_WORDS) + "]"
_FILLER = "[" + ", ".join(f"'{w}'" for w in t.FILLER_WORDS) + "]"


def kept(x: str) -> str:
    return f"list_filter({x}, lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t) AND NOT regexp_full_match(t, '[0-9]+'))"


TERMS = f"""
q AS (SELECT item_id AS q, {kept(tok('text'))} AS ts FROM benchmark),
terms AS (SELECT q, term, pos FROM (SELECT q, unnest(d) AS term, unnest(range(0, len(d))) AS pos FROM (SELECT q, ({distinct('ts')})[1:12] AS d FROM q))),
idx AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM idx WHERE term IN (SELECT term FROM terms) GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT q, term, idf FROM (
  SELECT q, term, idf, row_number() OVER (PARTITION BY q ORDER BY round(idf, 9) DESC, pos) AS r FROM (
    SELECT q, term, pos, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM terms JOIN df USING (term), n WHERE df <= n / 2)) WHERE r <= 10),
hits AS (SELECT q, doc, count(*) AS n_terms, round(sum(idf), 6) AS score FROM idx JOIN w USING (term) GROUP BY q, doc),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM hits) WHERE rank <= 10)
"""


@query(f"WITH {TERMS} SELECT q, doc, n_terms, score, rank FROM ranked")
def idf_search(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return search.idf_search(d.documents, d.benchmark).select("q", "doc", "n_terms", "score", "rank")


@query(f"""WITH {TERMS} SELECT q, doc, n_terms, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM ranked) WHERE score >= 0.3 * best AND n_terms >= 2""")
def relative_floor(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return search.relative_floor(search.idf_search(d.documents, d.benchmark)).select("q", "doc", "n_terms", "score", "rank")


@query(f"WITH {TERMS} SELECT term, df FROM df")
def document_frequency(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return search.document_frequency(search.postings(d.documents), search.question_terms(d.benchmark))


@query(f"SELECT q AS item_id, CASE WHEN len(d) > 0 THEN array_to_string(d, ' or ') ELSE text END AS or_query, len(d)::BIGINT AS n_terms FROM (SELECT item_id AS q, text, ({distinct('ts')})[1:12] AS d FROM (SELECT item_id, text, {kept(tok('text'))} AS ts FROM benchmark))")
def or_queries(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return d.benchmark.select("item_id", t.or_query(F.col("text")).alias("or_query"), F.size(t.significant_terms(F.col("text"))).cast("long").alias("n_terms"))


def _stem_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) - {len(s)} >= {t.MIN_STEM} THEN left({w}, length({w}) - {len(s)})" for s in t.SUFFIXES) + f" ELSE {w} END"


@query(f"SELECT stem, count(*) AS n_words, sum(n)::BIGINT AS n_uses FROM (SELECT {_stem_sql('w')} AS stem, w, count(*) AS n FROM (SELECT unnest({tok('text')}) AS w FROM documents) GROUP BY w) GROUP BY stem HAVING count(*) > 1")
def word_families(spark, sf_dir):
    """Stems that several words share."""
    words = Tables(spark, sf_dir).documents.select(F.explode(t.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(t.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n_words"), F.sum("n").alias("n_uses")).where("n_words > 1")


@query(f"""WITH a AS (SELECT item_id, list_filter({kept(tok('text'))}, lambda t: length(t) >= 4 AND NOT list_contains({_FILLER}, t) AND NOT list_contains({_FILLER}, {_stem_sql('t')})) AS ts FROM (
  SELECT item_id, text FROM benchmark)),
  b AS (SELECT item_id, list_transform({distinct('ts')}, lambda t: {_stem_sql('t')}) AS s FROM a)
SELECT item_id, array_to_string(({distinct('s')})[1:16], ' ') AS terms FROM b""")
def query_terms(spark, sf_dir):
    return Tables(spark, sf_dir).benchmark.select("item_id", F.array_join(t.query_terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT sha256(array_to_string({tok('text')}, ' ')) AS digest, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_digest_groups(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    return docs.groupBy(t.digest(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")


@query()
def near_copies(spark, sf_dir):
    """No SQL: DuckDB takes minutes over the shingles of long texts; tested against brute force."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text", F.col("lang").alias("subject"))
    return search.near_copies(docs)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS q, d.vec_id AS doc, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT q, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM s WHERE score >= 0.05) WHERE rank <= 10""")
def vector_search(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return search.vector_search(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector")))


_FUSED = f"""{TERMS},
fts AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY n_terms DESC, doc) AS rank FROM hits),
src AS (SELECT q, doc, 'content' AS source, rank FROM ranked UNION ALL SELECT q, doc, 'exact', rank FROM fts WHERE rank <= 10),
fused AS (SELECT q, doc, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, round(sum(CASE source WHEN 'content' THEN 1.0::DOUBLE ELSE 1.6::DOUBLE END / (60 + rank)), 9) AS score FROM src GROUP BY q, doc)"""


def _fused(d):
    terms, index = search.question_index(d.documents, d.benchmark)
    weights = search.idf_weights(terms, search.document_frequency(index, terms), d.documents)
    hits = index.join(weights, "term").groupBy("q", "doc").agg(F.round(F.sum("idf"), 6).alias("idf"), F.count("*").alias("n"))
    content = search.top_k(hits.select("q", "doc", F.col("idf").alias("score")), 10).select("q", "doc", F.lit("content").alias("source"), "rank")
    exact = search.top_k(hits.select("q", "doc", F.col("n").alias("score")), 10).select("q", "doc", F.lit("exact").alias("source"), "rank")
    return search.rrf(content.unionByName(exact))


@query(f"WITH {_FUSED} SELECT q, doc, sources, score FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(Tables(spark, sf_dir))


@query(f"""WITH {_FUSED}, m AS (SELECT f.q, f.doc, f.score, l.quality, d.doc_id % 10 = 0 AS overlay, d.lang = 'en' AS own FROM fused f JOIN documents d ON f.doc = d.doc_id LEFT JOIN labels l ON f.doc = l.doc_id)
SELECT q, doc, round(score * CASE quality WHEN 1 THEN 1.1::DOUBLE WHEN 0 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END * 1.0::DOUBLE * (1 - 0.2::DOUBLE * least((doc % 1000) / 365.0::DOUBLE, 1.0)) * CASE WHEN overlay THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * (1 + 0.5::DOUBLE * CASE WHEN own THEN 1.0 ELSE 0.0 END), 6) AS final FROM m""")
def reranked(spark, sf_dir):
    """Trust from labels, age and overlay from doc_id, lexical overlap from lang: stand-ins for an item's own columns."""
    d = Tables(spark, sf_dir)
    labels = d.labels.select(F.col("doc_id").alias("doc"), "quality")
    docs = d.documents.select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 10 == 0).alias("is_overlay"), (F.col("doc_id") % 1000).alias("age_days"), (F.col("lang") == "en").cast("double").alias("overlap"))
    items = _fused(d).join(docs, "doc").join(labels, "doc", "left").withColumn("trust", F.when(F.col("quality") == 1, "VERIFIED").when(F.col("quality") == 0, "RAW").otherwise("OBSERVED")).withColumn("health", F.lit("CURRENT"))
    return search.rerank(items).select("q", "doc", "final")


@query()
def context_pack(spark, sf_dir):
    """Greedy packing of each question's fused hits into a token budget; no SQL: a skip-and-continue fold."""
    d = Tables(spark, sf_dir)
    cost = d.documents.select(F.col("doc_id").alias("doc"), t.token_estimate(F.col("text")).alias("cost"))
    return search.pack(_fused(d).join(cost, "doc"), "q", 2000, 5)


def _measures(docs):
    return docs.select("doc_id", t.token_estimate(F.col("text")).alias("tokens"), F.sha2(t.normal(F.col("text")), 256).alias("normal_sha256"))


@query("SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS normal_sha256 FROM documents")
def text_measures(spark, sf_dir):
    return _measures(Tables(spark, sf_dir).documents)


@query()
def text_measures_all(spark, sf_dir):
    """Every document, whatever its language, null included; no SQL: lower() of other scripts is the engine's own, a test holds it against brute force."""
    return _measures(Tables(spark, sf_dir).documents)


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?i)([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@', '\1***@', 'g'), '(?i)((?:password|passwd|secret|token|api_?key)\s*[=:]\s*)[^\s,;]+', '\1***', 'g')) AS redacted_sha256,
regexp_matches(text, '(?i)(?:password|passwd|secret|token|api_?key)\s*[=:]') AS had_secret FROM documents""")
def redaction(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    return docs.select("doc_id", F.sha2(t.redact(F.col("text")), 256).alias("redacted_sha256"), F.col("text").rlike("(?i)(?:password|passwd|secret|token|api_?key)\\s*[=:]").alias("had_secret"))


@query(f"""WITH q AS (SELECT item_id, {tok('text')} AS w FROM benchmark), s AS (SELECT item_id, list_distinct(list_transform(w, lambda t: {_stem_sql('t')})) AS w FROM q),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS n, len(a.w) AS na FROM s a JOIN s b ON a.item_id <> b.item_id)
SELECT a, b, round(n::DOUBLE / na, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(n::DOUBLE / na, 6) DESC, b) AS r FROM p WHERE n > 0) WHERE r <= 3""")
def term_overlap(spark, sf_dir):
    """For each item the three others that cover most of its stems: joined on stems, not on all pairs."""
    each = Tables(spark, sf_dir).benchmark.select("item_id", F.explode(F.array_distinct(F.transform(t.tokens(F.col("text")), t.stem))).alias("s"))
    n = each.groupBy(F.col("item_id").alias("a")).agg(F.count("*").alias("na"))
    met = each.select(F.col("item_id").alias("a"), "s").join(each.select(F.col("item_id").alias("b"), "s"), "s").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")).join(n, "a")
    rated = met.select("a", "b", F.round(F.col("n") / F.col("na"), 6).alias("overlap"))
    return rated.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("overlap"), "b"))).where("r <= 3").drop("r")
