"""Impact of changes in the graph of orders: parts stand for symbols, customers for files, nations for what imports them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impact
from .graph_queries import EDGES, edges
from .registry import Tables, query
from .relation_queries import _key


def _changes(d):
    symbols = d.part.where("p_size = 7").select(_key("p:", "p_partkey").alias("root"), _key("p:", "p_partkey").alias("node"), _key("p:", "p_partkey").alias("path"), F.lit(False).alias("is_file"), _key("c:", "p_partkey").alias("file"))
    files = d.customer.where("c_custkey % 50 = 0").select(_key("c:", "c_custkey").alias("root"), _key("c:", "c_custkey").alias("node"), _key("c:", "c_custkey").alias("path"), F.lit(True).alias("is_file"), F.lit(None).cast("string").alias("file"))
    lost = d.nation.select(_key("x:", "n_nationkey").alias("root"), _key("x:", "n_nationkey").alias("node"), _key("x:", "n_nationkey").alias("path"), F.lit(True).alias("is_file"), F.lit(None).cast("string").alias("file"))
    return symbols.unionByName(files).unionByName(lost)


def _paths(d):
    """Urgent orders are tests, nations of even keys schema, customers of every 40th key security."""
    parts = [("p:", d.part, "p_partkey", "false", "false", "false"), ("c:", d.customer, "c_custkey", "false", "false", "c_custkey % 40 = 0"), ("o:", d.orders, "o_orderkey", "o_orderpriority = '1-URGENT'", "false", "false"),
             ("n:", d.nation, "n_nationkey", "false", "n_nationkey % 2 = 0", "false"), ("r:", d.region, "r_regionkey", "false", "false", "false")]
    out = None
    for prefix, df, key, test, schema, security in parts:
        own = df.select(_key(prefix, key).alias("path"), F.lit(True).alias("is_code"), F.expr(test).alias("is_test"), F.expr(schema).alias("is_schema"), F.expr(security).alias("is_security"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {EDGES}, k AS (SELECT src, dst, CASE kind WHEN 'contains' THEN 'imports' ELSE kind END AS kind, confidence FROM edges WHERE confidence >= 0.5),
t AS (SELECT 'p:' || p_partkey AS root, 'p:' || p_partkey AS node, FALSE AS is_file, 'c:' || p_partkey AS file FROM part WHERE p_size = 7 UNION ALL SELECT 'c:' || c_custkey, 'c:' || c_custkey, TRUE, NULL FROM customer WHERE c_custkey % 50 = 0),
s AS (SELECT root, 'callers' AS relation, node FROM t WHERE NOT is_file UNION ALL SELECT root, 'dependents', node FROM t WHERE is_file UNION ALL SELECT root, 'importers', file FROM t WHERE NOT is_file),
l0 AS (SELECT root, relation, node, 1.0::DOUBLE AS c FROM s),
l1 AS (SELECT root, relation, src AS node, max(least(c, confidence)) AS c FROM l0 JOIN k ON node = dst WHERE (relation = 'callers') = (kind <> 'imports') GROUP BY ALL),
l2 AS (SELECT root, relation, src AS node, max(least(c, confidence)) AS c FROM l1 JOIN k ON node = dst WHERE (relation = 'callers') = (kind <> 'imports') GROUP BY ALL),
e AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
p AS (SELECT 'o:' || o_orderkey AS path, o_orderpriority = '1-URGENT' AS is_test, FALSE AS is_schema, FALSE AS is_security FROM orders UNION ALL SELECT 'n:' || n_nationkey, FALSE, n_nationkey % 2 = 0, FALSE FROM nation UNION ALL SELECT 'c:' || c_custkey, FALSE, FALSE, c_custkey % 40 = 0 FROM customer),
m AS (SELECT root, node, bool_or(relation <> 'importers') AS consumes FROM e WHERE node <> root GROUP BY ALL),
a AS (SELECT root, count(*) FILTER (consumes) AS blast, count(*) FILTER (is_test) AS n_tests, bool_or(consumes AND coalesce(is_security, FALSE)) AS exposed, bool_or(consumes AND coalesce(is_schema, FALSE)) AS scripts FROM m LEFT JOIN p ON node = path GROUP BY root),
n AS (SELECT root, count(*) FILTER (relation = 'callers') AS n_callers, count(*) FILTER (relation = 'dependents') AS n_dependents, count(*) FILTER (relation = 'importers') AS n_importers, count(DISTINCT CASE WHEN relation <> 'importers' AND c < 0.6 THEN node END) AS weak FROM e GROUP BY root),
r AS (SELECT t.root, coalesce(n_callers, 0) AS n_callers, coalesce(n_dependents, 0) AS n_dependents, coalesce(n_importers, 0) AS n_importers, coalesce(blast, 0) AS blast, coalesce(n_tests, 0) AS n_tests, coalesce(exposed, FALSE) AS exposed, coalesce(scripts, FALSE) AS scripts, coalesce(weak, 0) AS weak,
  is_file AND split_part(t.root, ':', 2)::BIGINT % 40 = 0 AS security FROM t LEFT JOIN n ON n.root = t.root LEFT JOIN a ON a.root = t.root),
g AS (SELECT *, n_tests = 0 AS tests_missing, CASE WHEN blast >= 40 THEN 4 WHEN blast >= 15 THEN 3 WHEN blast >= 5 THEN 2 WHEN blast >= 1 THEN 1 ELSE 0 END + CASE WHEN security THEN 2 WHEN exposed THEN 1 ELSE 0 END + CASE WHEN scripts THEN 1 ELSE 0 END + CASE WHEN n_tests = 0 THEN 2 ELSE 0 END + CASE WHEN weak >= 5 THEN 1 ELSE 0 END AS points FROM r)
SELECT root, n_callers, n_dependents, n_importers, blast, n_tests, tests_missing, points, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][1 + greatest(CASE WHEN points >= 7 THEN 3 WHEN points >= 5 THEN 2 WHEN points >= 3 THEN 1 ELSE 0 END, CASE WHEN security THEN 2 ELSE 0 END)] AS risk FROM g
UNION ALL SELECT 'x:' || n_nationkey, 0, 0, 0, 0, 0, FALSE, NULL, 'MEDIUM' FROM nation""")
def impact_analysis(spark, sf_dir):
    """Orders and customers call parts, nations and regions import customers; the nations' own changes name no node."""
    d = Tables(spark, sf_dir)
    own = edges(d).withColumn("kind", F.when(F.col("kind") == "contains", "imports").otherwise(F.col("kind")))
    paths = _paths(d)
    return impact.analyze(own, _changes(d), paths.select(F.col("path").alias("node"), "path"), paths, depth=2)
