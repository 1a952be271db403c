"""Queries over relations in the graph: walks both ways, callers, siblings, successors, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .graph_queries import EDGES, edges
from .registry import Tables, query

_key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

# two levels against the edges, from parts: orders, then customers; the layers of the graph make each level final
_IN = """i0 AS (SELECT 'p:' || p_partkey AS root, 'p:' || p_partkey AS node, 1.0::DOUBLE AS c FROM part WHERE p_size = 7),
i1 AS (SELECT root, src AS node, max(least(c, confidence)) AS c FROM i0 JOIN edges ON dst = node WHERE confidence >= 0.5 GROUP BY ALL),
i2 AS (SELECT root, src AS node, max(least(c, confidence)) AS c FROM i1 JOIN edges ON dst = node WHERE confidence >= 0.5 GROUP BY ALL),
inward AS (SELECT root, node, 0 AS distance, c FROM i0 UNION ALL SELECT root, node, 1, c FROM i1 UNION ALL SELECT root, node, 2, c FROM i2)"""


def _inward(d):
    seeds = d.part.where("p_size = 7").select(_key("p:", "p_partkey").alias("root")).withColumn("node", F.col("root"))
    return graph.walk(edges(d), seeds, 2, "in")


@query(f"WITH {EDGES}, {_IN} SELECT root, node, distance, round(c, 6) AS confidence FROM inward")
def walk_in(spark, sf_dir):
    return _inward(Tables(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {EDGES}, b AS (SELECT src AS here, dst AS there, confidence FROM edges UNION ALL SELECT dst, src, confidence FROM edges), s AS (SELECT here, there, confidence FROM b WHERE confidence >= 0.5),
h AS (SELECT dst AS here FROM edges GROUP BY dst HAVING count(*) > 40), n0 AS (SELECT 'n:' || n_nationkey AS root, 'n:' || n_nationkey AS node, 1.0::DOUBLE AS c FROM nation),
n1 AS (SELECT root, there AS node, max(least(c, confidence)) AS c FROM n0 JOIN s ON node = here WHERE here NOT IN (SELECT here FROM h) AND there <> root GROUP BY ALL),
n2 AS (SELECT root, there AS node, max(least(c, confidence)) AS c FROM n1 JOIN s ON node = here WHERE here NOT IN (SELECT here FROM h) AND (root, there) NOT IN (SELECT (root, node) FROM (SELECT root, node FROM n0 UNION ALL SELECT root, node FROM n1)) GROUP BY ALL)
SELECT root, node, 0 AS distance, c AS confidence FROM n0 UNION ALL SELECT root, node, 1, round(c, 6) FROM n1 UNION ALL SELECT root, node, 2, round(c, 6) FROM n2""")
def walk_both(spark, sf_dir):
    d = Tables(spark, sf_dir)
    seeds = d.nation.select(_key("n:", "n_nationkey").alias("root")).withColumn("node", F.col("root"))
    return graph.walk(edges(d), seeds, 2, "both", hub_limit=40).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {EDGES}, {_IN}, w AS (SELECT 'o:' || o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT root, node, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY distance, c DESC, node) AS rank FROM inward WHERE distance > 0 AND node IN (SELECT node FROM w)) WHERE rank <= 8""")
def tests_for(spark, sf_dir):
    """Urgent orders stand for tests, parts for what they test."""
    d = Tables(spark, sf_dir)
    wanted = d.orders.where("o_orderpriority = '1-URGENT'").select(_key("o:", "o_orderkey").alias("node"))
    return graph.nearest_of(_inward(d), wanted).select("root", "node", "distance", "rank")


@query("""WITH c AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 'callee:' || l_partkey ELSE 'symbol:' || l_partkey END AS dst, 'o:' || l_orderkey AS src, 1 - l_discount * 9 AS confidence FROM lineitem)
SELECT p_partkey::VARCHAR AS name, src, round(max(confidence), 6) AS confidence FROM c JOIN part ON dst = 'callee:' || p_partkey WHERE confidence >= 0.2 GROUP BY ALL""")
def unresolved_callers(spark, sf_dir):
    d = Tables(spark, sf_dir)
    dst = F.when(F.col("l_partkey") % 3 == 0, _key("callee:", "l_partkey")).otherwise(_key("symbol:", "l_partkey"))
    calls = d.lineitem.select(_key("o:", "l_orderkey").alias("src"), dst.alias("dst"), (1 - F.col("l_discount") * 9).alias("confidence"))
    return graph.unresolved_callers(calls, d.part.select(F.col("p_partkey").cast("string").alias("name"))).withColumn("confidence", F.round("confidence", 6))


@query("""WITH c AS (SELECT c_nationkey AS src, c_custkey AS dst FROM customer), r AS (SELECT c_custkey % 4 AS root, c_custkey AS node, c_custkey % 2 AS distance FROM customer WHERE c_custkey % 7 = 0),
f AS (SELECT root, src, min(distance) AS distance FROM r JOIN c ON node = dst GROUP BY ALL)
SELECT root, dst AS node, min(distance) + 1 AS distance, 0.5::DOUBLE AS confidence FROM f JOIN c ON f.src = c.src WHERE (root, dst) NOT IN (SELECT (root, node) FROM r) GROUP BY root, dst""")
def sibling_expansion(spark, sf_dir):
    customer = Tables(spark, sf_dir).customer
    contains = customer.select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"))
    k = F.col("c_custkey")
    return graph.siblings(contains, customer.where("c_custkey % 7 = 0").select((k % 4).alias("root"), k.alias("node"), (k % 2).alias("distance")))


@query("""WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN c_custkey - 2 WHEN c_custkey % 50 > 40 THEN c_custkey + 1 ELSE c_custkey + 9 END AS nxt FROM customer WHERE c_custkey % 7 <> 0),
w AS (SELECT id, nxt AS last, 1 AS hops FROM s UNION ALL SELECT w.id, s.nxt, hops + 1 FROM w JOIN s ON w.last = s.id WHERE hops < 60)
SELECT s.id, e.last, e.hops::BIGINT AS hops, e.id IS NULL AS cycle FROM s LEFT JOIN (SELECT * FROM w WHERE last NOT IN (SELECT id FROM s)) e ON s.id = e.id""")
def supersession(spark, sf_dir):
    k = F.col("c_custkey")
    after = F.when(k % 50 == 0, k - 2).when(k % 50 > 40, k + 1).otherwise(k + 9)
    return graph.supersession(Tables(spark, sf_dir).customer.where("c_custkey % 7 <> 0").select(k.alias("id"), after.alias("superseded_by")))


@query(f"""WITH {EDGES}, s AS (SELECT 'c:' || c_custkey AS node FROM customer WHERE c_custkey % 5 = 0), m AS (SELECT node, dst AS other, kind, 'out' AS way FROM edges JOIN s ON src = node UNION SELECT node, src, kind, 'in' FROM edges JOIN s ON dst = node)
SELECT node, other, kind, way, coalesce(n_name, split_part(other, ':', 2)) AS label FROM m LEFT JOIN nation ON other = 'n:' || n_nationkey""")
def file_relations(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return graph.relations(edges(d), d.customer.where("c_custkey % 5 = 0").select(_key("c:", "c_custkey").alias("node")), d.nation.select(_key("n:", "n_nationkey").alias("node"), F.col("n_name").alias("label")))


@query("""WITH v AS (SELECT p_partkey AS path, CASE WHEN p_size < 5 THEN 'overlay' ELSE 'committed' END AS scope FROM part WHERE p_size >= 3),
y AS (SELECT l_partkey AS path, count(*) AS n FROM lineitem GROUP BY ALL), i AS (SELECT l_partkey AS path, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey IN (SELECT path FROM v) AND l_suppkey <> l_partkey GROUP BY ALL)
SELECT v.path, scope, coalesce(y.n, 0) AS n_symbols, coalesce(i.n, 0) AS n_imports FROM v LEFT JOIN y ON v.path = y.path LEFT JOIN i ON v.path = i.path""")
def project_overview(spark, sf_dir):
    d = Tables(spark, sf_dir)
    path = F.col("p_partkey").alias("path")
    over = d.part.where("p_size < 5").select(path, F.when(F.col("p_size") < 3, "deleted").otherwise("active").alias("status"))
    return graph.overview(d.part.select(path), over, d.lineitem.select(F.col("l_partkey").alias("path")), d.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("""SELECT p_brand, p_type, count(*) AS n_files, sum(p_size)::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r <= 30 GROUP BY p_brand, p_type""")
def capped_families(spark, sf_dir):
    return graph.capped_families(Tables(spark, sf_dir).part, "p_brand", "p_type", "p_size", "p_partkey", 30)


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part)
SELECT p_brand, p_partkey, place, 0 AS n_more FROM r WHERE place <= 6 UNION ALL SELECT p_brand, NULL, 7, count(*) - 6 FROM part GROUP BY p_brand HAVING count(*) > 6""")
def tree_rows(spark, sf_dir):
    return graph.outline(Tables(spark, sf_dir).part, "p_brand", "p_partkey", "p_size", 6)
