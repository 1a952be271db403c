"""Queries for scans, precedence, change detection and functional writes."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import tables
from .registry import Tables, query


@query("""WITH i AS (SELECT d.doc_id, CASE lang WHEN 'en' THEN 'default' WHEN 'de' THEN 'project' WHEN 'fr' THEN 'ephemeral' ELSE 'local' END AS vault,
  CASE WHEN n_chars > 1000 THEN 'p1' WHEN n_chars > 500 THEN 'p2' END AS project, CASE quality WHEN 1 THEN 'CURRENT' WHEN 0 THEN 'QUARANTINED' ELSE 'UNVERIFIED' END AS health,
  CASE WHEN n_chars > 5000 THEN TIMESTAMP '2024-01-01' WHEN n_chars > 3000 THEN TIMESTAMP '2025-01-01' END AS expires_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, vault FROM i WHERE (vault = 'default' OR vault = 'project' AND project = 'p1' OR vault = 'ephemeral' AND (project IS NULL OR project = 'p1'))
AND health NOT IN ('QUARANTINED', 'SUPERSEDED') AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-06-01')""")
def visible_items(spark, sf_dir):
    """An item's vault, project, health and expiry stand in for columns that documents lack: from lang, length and labels."""
    d = Tables(spark, sf_dir)
    lang, n, q = F.col("lang"), F.col("n_chars"), F.col("quality")
    items = d.documents.join(d.labels, "doc_id", "left").select(
        "doc_id", F.when(lang == "en", "default").when(lang == "de", "project").when(lang == "fr", "ephemeral").otherwise("local").alias("vault"), F.when(n > 1000, "p1").when(n > 500, "p2").alias("project"),
        F.when(q == 1, "CURRENT").when(q == 0, "QUARANTINED").otherwise("UNVERIFIED").alias("health"), F.when(n > 5000, F.lit("2024-01-01")).when(n > 3000, F.lit("2025-01-01")).cast("timestamp").alias("expires_at"),
    )
    return tables.visible(items, ["default", "project", "ephemeral"], "p1", datetime.datetime(2024, 6, 1)).select("doc_id", "vault")


@query("SELECT c_custkey, c_name, pos FROM customer JOIN (VALUES (40, 0), (7, 1), (99, 2), (-5, 3), (1, 4)) AS w(k, pos) ON c_custkey = k")
def multi_get(spark, sf_dir):
    return tables.get_many(Tables(spark, sf_dir).customer.select("c_custkey", "c_name"), "c_custkey", [40, 7, 99, -5, 1])


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 'overlay' ELSE 'committed' END AS scope
FROM orders WHERE o_orderpriority <> '2-HIGH'""")
def overlay_precedence(spark, sf_dir):
    """Urgent orders are changed in the overlay, high ones deleted there."""
    orders = Tables(spark, sf_dir).orders
    priority = F.col("o_orderpriority")
    over = orders.where(priority.isin("1-URGENT", "2-HIGH")).select("o_orderkey", F.when(priority == "1-URGENT", "X").otherwise("deleted").alias("status"))
    return tables.prefer_overlay(orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), over, ["o_orderkey"])


_AFTER = "after AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name || '!' ELSE p_name END AS p_name FROM part WHERE p_size > 5 UNION ALL SELECT p_partkey + 1000000000, p_name FROM part WHERE p_size = 1)"


@query(f"WITH {_AFTER} SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey, CASE WHEN b.p_name IS NULL THEN 'added' WHEN a.p_name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM part b FULL JOIN after a ON a.p_partkey = b.p_partkey WHERE a.p_name IS DISTINCT FROM b.p_name")
def snapshot_changes(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    after = part.where("p_size > 5").select("p_partkey", F.when(F.col("p_size") < 10, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"))
    after = after.union(part.where("p_size = 1").select(F.col("p_partkey") + 1000000000, "p_name"))
    digest = F.sha2("p_name", 256).alias("digest")
    return tables.changes(part.select("p_partkey", digest), after.select("p_partkey", digest), "p_partkey", "digest")


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 'renamed' ELSE p_name END AS p_name FROM part")
def upsert(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return tables.upsert(part.select("p_partkey", "p_name"), part.where("p_size < 5").select("p_partkey", F.lit("renamed").alias("p_name")), ["p_partkey"])


@query("SELECT s_suppkey * 20 AS key, s_name AS name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey * 20)")
def insert_ignore(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return tables.insert_ignore(d.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), d.supplier.select((F.col("s_suppkey") * 20).alias("key"), F.col("s_name").alias("name")), ["key"])


@query("SELECT p_brand, (count(*) + count(*) FILTER (WHERE p_size > 25))::BIGINT AS n FROM part GROUP BY p_brand")
def increment(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    counts = lambda df: df.groupBy("p_brand").agg(F.count("*").alias("n"))
    return tables.increment(counts(part), counts(part.where("p_size > 25")), "p_brand", ["n"])


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AS applied FROM orders""")
def compare_and_set(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    wanted = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("O").alias("expected"), F.lit("X").alias("value"))
    return tables.compare_and_set(orders.select("o_orderkey", "o_orderstatus"), wanted, "o_orderkey", "o_orderstatus")


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS i FROM lineitem) WHERE i = 1""")
def latest_rows(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey")
    return tables.latest(rows, ["l_partkey"], [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""WITH c AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS i, count(*) OVER () AS m FROM c)
SELECT CASE WHEN m > 5 AND i >= 5 THEN 'OTHER' ELSE name END AS name, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def other_bucket(spark, sf_dir):
    counts = Tables(spark, sf_dir).part.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return tables.other_bucket(counts, "name", "n", 5)


@query()
def table_signature(spark, sf_dir):
    """No SQL: sha1 over summed row hashes; tested for its reaction to changes."""
    return tables.signature(Tables(spark, sf_dir).part, ["p_partkey", "p_name", "p_size"])
