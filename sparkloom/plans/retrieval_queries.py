"""Queries of the retrieval pipeline over documents and the questions of the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governor, retrieval, search
from ..storage import stage
from .registry import Tables, query
from .search_queries import TERMS

LEVEL = retrieval.Level(per_source=10, results=20, depth=2)
_key = lambda c: F.concat(F.lit("d:"), F.col(c).cast("string"))


def _batches(d, per_source=LEVEL.per_source):
    """Hits by content, by number of terms, and by nearness to the best content hit's vector; and the terms' overlap."""
    terms, index = search.question_index(d.documents, d.benchmark)
    weights = search.idf_weights(terms, search.document_frequency(index, terms), d.documents)
    hits = stage(index.join(weights, "term").groupBy("q", "doc").agg(F.round(F.sum("idf"), 6).alias("idf"), F.count("*").alias("n")), "hits")
    content = stage(search.top_k(hits.select("q", "doc", F.col("idf").alias("score")), per_source), "content")
    exact = search.top_k(hits.select("q", "doc", F.col("n").alias("score")), per_source)
    best = content.where("rank = 1").select("q", F.col("doc").alias("best"))
    vectors = d.embeddings.join(best.select(F.col("best").alias("vec_id")).distinct(), "vec_id", "left_semi")
    near = search.vector_search(d.embeddings, vectors.select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector")), per_source)
    vector = best.join(near.withColumnRenamed("q", "best"), "best")
    total = terms.groupBy("q").agg(F.count("*").alias("n_all"))
    overlap = index.join(terms, "term").groupBy("q", "doc").agg(F.count("*").alias("n")).join(total, "q")
    batches = {name: df.select("q", _key("doc").alias("doc"), "rank") for name, df in (("content", content), ("exact", exact), ("vector", vector))}
    return batches, overlap.select("q", _key("doc").alias("doc"), (F.col("n") / F.col("n_all")).alias("overlap"))


def _edges(d):
    """A document leads to the next one and to the one at half its id: stand-ins for references."""
    own = d.documents.select("doc_id")
    after = own.select(_key("doc_id").alias("src"), F.concat(F.lit("d:"), (F.col("doc_id") + 1).cast("string")).alias("dst"), F.lit("references").alias("kind"), F.lit(0.9).alias("confidence"))
    half = own.where("doc_id > 0").select(_key("doc_id").alias("src"), F.concat(F.lit("d:"), F.expr("doc_id div 2").cast("string")).alias("dst"), F.lit("imports").alias("kind"), F.lit(0.7).alias("confidence"))
    return after.unionByName(half)


def _items(d):
    """Trust from labels, health from the language, age and overlay from the id: stand-ins for an item's own columns."""
    trust = F.when(F.col("quality") == 1, "VERIFIED").when(F.col("quality") == 0, "RAW").otherwise("OBSERVED")
    health = F.when(F.col("lang") == "en", "CURRENT").otherwise("STALE")
    rated = d.documents.join(d.labels.select("doc_id", "quality"), "doc_id", "left")
    return rated.select(_key("doc_id").alias("doc"), "text", F.col("lang").alias("subject"), trust.alias("trust"), health.alias("health"), (F.col("doc_id") % 1000).alias("age_days"), (F.col("doc_id") % 10 == 0).alias("is_overlay"))


@query(f"""WITH {TERMS}, cov AS (SELECT q, doc, count(*) AS n FROM idx JOIN terms USING (term) GROUP BY q, doc), nt AS (SELECT q, count(*) AS n_all FROM terms GROUP BY q),
fts AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY n_terms DESC, doc) AS rank FROM hits),
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), best AS (SELECT q, doc AS b FROM ranked WHERE rank = 1),
vs AS (SELECT a.vec_id AS b, c.vec_id AS doc, round(list_cosine_similarity(a.e, c.e), 6) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id IN (SELECT b FROM best)),
vr AS (SELECT b, doc, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc) AS rank FROM vs WHERE score >= 0.05),
src AS (SELECT q, 'd:' || doc AS doc, 'content' AS source, rank, 1.0::DOUBLE AS w FROM ranked UNION ALL SELECT q, 'd:' || doc, 'exact', rank, 1.6::DOUBLE FROM fts WHERE rank <= 10
  UNION ALL SELECT q, 'd:' || doc, 'vector', rank, 0.9::DOUBLE FROM best JOIN vr USING (b) WHERE rank <= 10),
f1 AS (SELECT q, doc, bool_or(source = 'exact') AS exact, round(sum(w / (60 + rank)), 9) AS score FROM src GROUP BY q, doc),
s0 AS (SELECT q, doc AS node, 1.0::DOUBLE AS c FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY exact DESC, score DESC, doc) AS place FROM f1) WHERE exact OR place <= 8),
e AS (SELECT 'd:' || doc_id AS src, 'd:' || (doc_id + 1) AS dst, 0.9::DOUBLE AS confidence FROM documents UNION ALL SELECT 'd:' || doc_id, 'd:' || (doc_id // 2), 0.7::DOUBLE FROM documents WHERE doc_id > 0),
s1 AS (SELECT q, dst AS node, max(least(c, confidence)) AS c FROM s0 JOIN e ON node = src WHERE (q, dst) NOT IN (SELECT (q, node) FROM s0) GROUP BY q, dst),
s2 AS (SELECT q, dst AS node, max(least(c, confidence)) AS c FROM s1 JOIN e ON node = src WHERE (q, dst) NOT IN (SELECT (q, node) FROM s0) AND (q, dst) NOT IN (SELECT (q, node) FROM s1) GROUP BY q, dst),
i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY dst),
x AS (SELECT q, node, distance, round(c / (1 + log10(1 + coalesce(n, 0))), 6) AS value FROM (SELECT q, node, 1 AS distance, c FROM s1 UNION ALL SELECT q, node, 2, c FROM s2) LEFT JOIN i USING (node)),
g AS (SELECT q, node AS doc, row_number() OVER (PARTITION BY q ORDER BY distance, value DESC, node) AS rank FROM x),
f2 AS (SELECT q, doc, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT q, doc, source, rank, w FROM src UNION ALL SELECT q, doc, 'graph', rank, 0.9::DOUBLE FROM g WHERE rank <= 30) GROUP BY q, doc),
m AS (SELECT f.q, f.doc, f.sources, f.score, d.doc_id, d.lang, l.quality, coalesce(cov.n / nt.n_all, 0.0) AS overlap FROM f2 f JOIN documents d ON f.doc = 'd:' || d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN cov ON cov.q = f.q AND cov.doc = d.doc_id LEFT JOIN nt ON nt.q = f.q)
SELECT q, doc, sources, round(score * CASE quality WHEN 1 THEN 1.1::DOUBLE WHEN 0 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END * CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * (1 - 0.2::DOUBLE * least((doc_id % 1000) / 365.0::DOUBLE, 1.0))
  * CASE WHEN doc_id % 10 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * (1 + 0.5::DOUBLE * overlap), 6) AS final FROM m""")
def retrieval_reranked(spark, sf_dir):
    """The pipeline without the marking of copies, which SQL can't express."""
    d = Tables(spark, sf_dir)
    batches, overlap = _batches(d)
    fused = retrieval.widen(stage(retrieval.fuse(batches, LEVEL.per_source), "fused"), batches, _edges(d), LEVEL)
    return search.rerank(retrieval.with_factors(fused, _items(d), overlap)).select("q", "doc", "sources", "final")


@query()
def retrieval_pipeline(spark, sf_dir):
    """The whole pipeline; no SQL: copies are marked best first, which a test holds against brute force."""
    d = Tables(spark, sf_dir)
    batches, overlap = _batches(d)
    return retrieval.retrieve(batches, _edges(d), _items(d), overlap, LEVEL)


@query("""SELECT item_id, regexp_matches(text, '(?i)\\b(?:tests?|specs?|test suites?|unit tests?)\\b(?:$|[^/_\\w-])') AS asks_tests,
  regexp_matches(text, '(?i)\\b(?:break(?:s|ing)?|broken|renam\\w+|regress\\w*|affect(?:ed|s)?|impact(?:ed|s)?|what else|ripple|blast radius|depend(?:s|ent|ents)? on|what do i (?:need|have) to (?:touch|change|add|update)|which files)\\b') AS considers_tests,
  regexp_matches(text, '(?i)\\b(?:docs?|documentation|adrs?|readme|runbook|changelog|documented|threat model)\\b(?:$|[^/_\\w-])') AS asks_docs,
  regexp_matches(text, '(?i)\\bwhy\\b|\\brationale\\b|\\bjustif(?:y|ication|ied)\\b|\\btrade-?offs?\\b|\\bmotivation\\b|\\bthe reasons?\\b|\\bwhat(?:''s| is) the reason\\b') AS asks_rationale
FROM (SELECT doc_id AS item_id, coalesce(text, '') AS text FROM documents)""")
def intents(spark, sf_dir):
    """What each document, read as a request, asks for."""
    return Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("item_id"), *governor.intents(F.col("text")))


@query()
def governed_context(spark, sf_dir):
    """The best pack of each benchmark text as a question to the documents, levels raised where it isn't ready.

    Risk by the item's number is a stand-in; the questions are to knowledge alone.  No SQL: packs are folds and the levels a loop,
    which tests hold against a loop over single questions.
    """
    d = Tables(spark, sf_dir)
    most = max(level.per_source for level in governor.LEVELS.values())
    batches, overlap = _batches(d, most)
    batches, overlap = {name: stage(df, name) for name, df in batches.items()}, stage(overlap, "overlap")
    items = _items(d)
    said = items.select(F.col("doc").alias("id"), "trust", "health", F.col("text").alias("content"), F.substring_index("text", "\n", 1).alias("title"))

    def gather(name, level, now):
        asked = {k: df.join(now.select("q"), "q", "left_semi") for k, df in batches.items()}
        found = retrieval.retrieve(asked, _edges(d), items, overlap, level).select("q", F.col("doc").alias("id"), F.split("sources", ",").alias("sources"), F.col("final").alias("score"), "redundant_of")
        none = F.lit(None).cast("string")
        return found.join(said, "id").select("*", F.lit("KNOWLEDGE").alias("kind"), none.alias("path"), none.alias("subject"), F.array_contains("sources", "exact").alias("critical"))

    risk = F.element_at(F.array(*map(F.lit, governor.READY)), (F.col("item_id") % 4 + 1).cast("int"))
    questions = d.benchmark.select(F.col("item_id").alias("q"), "text", risk.alias("risk"), F.lit(None).cast("double").alias("health"))
    entities = spark.createDataFrame([], "q long, entity string, kind string, explicit boolean, is_new boolean, targets array<string>")
    edges = spark.createDataFrame([], "src_key string, dst_key string, kind string, confidence double")
    best = governor.govern(questions, gather, entities, edges)
    return best.select("q", "level", "ready", "coverage", "confidence", "n_blocking", "used", "truncated", F.size("items").alias("n_items"), F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", F.transform("items", lambda x: x["id"])).alias("ids"))
