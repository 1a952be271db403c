"""Queries for pages, slices, hashes, predicates and functional writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans, writes
from .registry import Tables, query

@query("SELECT event_id, event_type, ts FROM events WHERE event_type IN ('error', 'purchase') AND json_extract_string(props, '$.k') = '7' ORDER BY ts DESC, event_id LIMIT 40")
def browse_newest(spark, sf_dir):
    where = F.col("event_type").isin("error", "purchase") & scans.json_equals("props", "$.k", "7")
    return scans.browse(Tables(spark, sf_dir).events, "ts", "event_id", 40, where).select("event_id", "event_type", "ts")


@query("SELECT p_type || '/' || p_partkey AS path, p_size FROM part WHERE p_type || '/' || p_partkey > 'PROMO B' AND starts_with(p_type || '/' || p_partkey, 'P') ORDER BY path LIMIT 100")
def file_page(spark, sf_dir):
    rows = Tables(spark, sf_dir).part.select(F.concat_ws("/", "p_type", F.col("p_partkey").cast("string")).alias("path"), "p_size")
    return scans.key_page(rows, "path", "PROMO B", 100, "P")


@query("SELECT doc_id, coalesce(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)), '') AS slice FROM documents")
def line_slice(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", scans.line_slice(F.coalesce("text", F.lit("")), 2, 900, 3).alias("slice"))


@query("SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob_sha1 FROM documents")
def blob_hashes(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", scans.blob_sha1(F.col("text")).alias("blob_sha1"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_extract_string(props, '$.k')::INT > 50) AS n_high, count(*) FILTER (WHERE json_extract_string(props, '$.missing') IS NULL) AS n_without FROM events GROUP BY event_type")
def json_predicates(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(k > 50).alias("n_high"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("n_without"))


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS words FROM part)
SELECT p_partkey, list_has_any(words, ['brass', 'steel']) AS has_any, list_has_all(words, ['promo', 'brass']) AS has_all FROM w""")
def array_predicates(spark, sf_dir):
    words = F.split(F.lower("p_type"), " ")
    return Tables(spark, sf_dir).part.select("p_partkey", scans.any_of(words, ["brass", "steel"]).alias("has_any"), scans.all_of(words, ["promo", "brass"]).alias("has_all"))


@query("""SELECT name, qualified, name_rank FROM (SELECT p_name AS name, p_brand || '.' || p_name || '.' || p_partkey AS qualified,
  CASE WHEN lower(p_name) = 'a' THEN 0 WHEN starts_with(lower(p_name), 'a') THEN 1 WHEN contains(lower(p_name), 'a') THEN 2 WHEN contains(lower(p_brand || '.' || p_name || '.' || p_partkey), 'a') THEN 3 END AS name_rank FROM part)
WHERE name_rank IS NOT NULL ORDER BY name_rank, length(qualified), qualified LIMIT 200""")
def symbol_search(spark, sf_dir):
    symbols = Tables(spark, sf_dir).part.select(F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string")).alias("qualified"))
    return scans.name_search(symbols, "name", "qualified", "A", 200)


@query("""SELECT sha256(s_suppkey || chr(31) || s_name) AS id, pos, source FROM (SELECT s_suppkey, s_name, unnest([0, 1]) AS pos, unnest(['nation:' || s_nationkey, 'name:' || s_name]) AS source FROM supplier)""")
def insert_with_provenance(spark, sf_dir):
    rows = Tables(spark, sf_dir).supplier.withColumn("from", F.array(F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")), F.concat(F.lit("name:"), F.col("s_name"))))
    return writes.insert_with_provenance(rows, ["s_suppkey", "s_name"], "from", F.lit("2024-06-01").cast("timestamp"))[1]


_E = "SELECT o_custkey AS src, o_orderkey AS dst, o_totalprice AS weight FROM orders"


@query(f"""WITH e AS ({_E}), l AS (SELECT * FROM e WHERE src % 3 <> 0), n AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM e WHERE src % 6 = 0 UNION ALL SELECT src, dst, 2.0::DOUBLE FROM e WHERE src % 4 = 0)
SELECT * FROM l UNION ALL SELECT src, dst, min(weight) FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src = n.src AND l.dst = n.dst) GROUP BY src, dst""")
def replace_edges(spark, sf_dir):
    edges = Tables(spark, sf_dir).orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("weight"))
    new = edges.where("src % 6 = 0").withColumn("weight", F.lit(1.0)).union(edges.where("src % 4 = 0").withColumn("weight", F.lit(2.0)))
    return writes.replace_edges(edges, edges.where("src % 3 = 0"), new, ["src", "dst"])


@query("""WITH c AS (SELECT l_orderkey AS item, l_partkey AS key, 'old' AS hash FROM lineitem), n AS (SELECT o_orderkey AS item, o_custkey % 7 AS key, 'h' || o_orderkey AS hash FROM orders WHERE o_orderkey % 5 = 0)
SELECT item, key, hash FROM c WHERE item % 5 <> 0 UNION ALL SELECT item, key, max(hash) FROM n GROUP BY item, key""")
def replace_set(spark, sf_dir):
    d = Tables(spark, sf_dir)
    current = d.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("key"), F.lit("old").alias("hash"))
    fifth = d.orders.where("o_orderkey % 5 = 0")
    new = fifth.select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 7).alias("key"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("hash"))
    owners = d.lineitem.where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("item"))
    return writes.replace_set(current, owners, new, "item", "key", "hash")


@query("""SELECT o_custkey AS path, o_orderkey AS symbol FROM orders WHERE o_custkey % 4 NOT IN (0, 1) UNION ALL SELECT c_custkey, -c_custkey FROM customer WHERE c_custkey % 4 = 0""")
def apply_changes(spark, sf_dir):
    d = Tables(spark, sf_dir)
    index = d.orders.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("symbol"))
    changed = d.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("path"), (-F.col("c_custkey")).alias("symbol"))
    return writes.apply_changes(index, changed, d.customer.where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("path")), "path")


@query("SELECT o_orderkey, o_orderstatus AS before, 'P' AS after FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'O'")
def set_with_history(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus")
    wanted = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("O").alias("expected"), F.lit("P").alias("new"))
    return writes.set_with_history(orders, wanted, "o_orderkey", "o_orderstatus")[1]


@query("""SELECT doc_id, n_chars, CASE WHEN ref IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN ref END AS ref, CASE WHEN ref IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN sha256(ref::VARCHAR) END AS ref_hash
FROM (SELECT doc_id, n_chars, lang, doc_id // 2 AS ref FROM documents) WHERE lang = 'en'""")
def export_rows(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    items = docs.select("doc_id", "n_chars", "lang", F.expr("doc_id div 2").alias("ref")).withColumn("ref_hash", F.sha2(F.col("ref").cast("string"), 256))
    return writes.export_rows(items, docs.where("lang = 'en'").select("doc_id"), F.col("lang") == "en", "ref", "ref_hash", ["lang"])


@query("""SELECT user_id::VARCHAR AS chain, count(*) AS n, list_reduce(list_prepend(repeat('0', 64), list(event_id || ':' || event_type ORDER BY ts, event_id)), lambda h, x: sha256(h || x)) AS head FROM events GROUP BY user_id""")
def hash_chain(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.withColumn("record", F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))
    links = writes.hash_chain(rows, "user_id", ["ts", "event_id"], "record")
    return links.groupBy("chain").agg(F.count("*").alias("n"), F.max_by("link", "place").alias("head"))


@query("SELECT user_id::VARCHAR AS chain, CASE WHEN user_id % 3 = 0 THEN 'edited' ELSE 'truncated' END AS fault FROM events WHERE user_id % 3 < 2 GROUP BY user_id HAVING count(*) > 1")
def chain_faults(spark, sf_dir):
    """Every third chain has its first record changed, every other third lost its last one."""
    rows = Tables(spark, sf_dir).events.withColumn("record", F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))
    links = writes.hash_chain(rows, "user_id", ["ts", "event_id"], "record")
    ends = links.groupBy("chain").agg(F.count("*").alias("n"), F.max_by("link", "place").alias("head")).where("n > 1")
    third = F.col("chain").cast("long") % 3
    kept = links.join(ends.select("chain", "n"), "chain").where((third != 1) | (F.col("place") < F.col("n")))
    return writes.chain_faults(kept.withColumn("record", F.when((third == 0) & (F.col("place") == 1), "changed").otherwise(F.col("record"))), ends)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_discount * 5 >= 0.7 THEN 'DERIVED' ELSE 'OBSERVED' END AS trust FROM lineitem")
def promoted(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.withColumn("confidence", 1 - F.col("l_discount") * 5)
    return writes.promoted(rows, "confidence").select("l_orderkey", "l_linenumber", "trust")
