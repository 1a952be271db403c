"""Queries over the graph region -> nation -> customer -> order -> part, with typed edges and confidences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, resolution
from .registry import Tables, query


def edges(d: Tables):
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = [
        d.nation.select(key("r:", "n_regionkey").alias("src"), key("n:", "n_nationkey").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence")),
        d.customer.select(key("n:", "c_nationkey"), key("c:", "c_custkey"), F.lit("contains"), F.lit(0.95)),
        d.orders.select(key("c:", "o_custkey"), key("o:", "o_orderkey"), F.lit("calls"), F.lit(0.9)),
        d.lineitem.select(key("o:", "l_orderkey"), key("p:", "l_partkey"), F.lit("references"), 1 - F.col("l_discount") * 5),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


EDGES = """edges AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'contains', 0.95::DOUBLE FROM customer
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'calls', 0.9::DOUBLE FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'references', 1 - l_discount * 5 FROM lineitem
)"""

# the graph has layers, so a node's first level is the only one that reaches it
_LEVELS = "l0 AS (SELECT 'r:' || r_regionkey AS root, 'r:' || r_regionkey AS node, 1.0::DOUBLE AS c FROM region)" + "".join(
    f", l{k} AS (SELECT root, dst AS node, max(least(c, confidence)) AS c FROM l{k - 1} JOIN edges ON src = node WHERE confidence >= 0.5 GROUP BY ALL)" for k in range(1, 5)
)
WALK = f"{EDGES}, {_LEVELS}, walk AS (" + " UNION ALL ".join(f"SELECT root, node, {k} AS distance, c FROM l{k}" for k in range(5)) + ")"


def _walk(d):
    seeds = d.region.select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("root")).withColumn("node", F.col("root"))
    return graph.walk(edges(d), seeds, 4)


@query(f"WITH {WALK} SELECT root, node, distance, round(c, 6) AS confidence FROM walk")
def graph_walk(spark, sf_dir):
    return _walk(Tables(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {WALK}, i AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst), v AS (SELECT root, node, distance, round(c / (1 + log10(1 + coalesce(n, 0))), 6) AS value FROM walk LEFT JOIN i ON node = dst WHERE distance > 0)
SELECT root, node, distance, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY distance, value DESC, node) AS rank FROM v) WHERE rank <= 30""")
def graph_expansion(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return graph.expand_ranked(edges(d), _walk(d), 30)


@query(f"WITH {EDGES} SELECT dst AS node, count(*) AS in_degree FROM edges WHERE kind IN ('references', 'calls') GROUP BY dst")
def in_degree(spark, sf_dir):
    return graph.in_degree(edges(Tables(spark, sf_dir)), ["references", "calls"])


@query(f"""WITH {EDGES}, s AS (SELECT 'n:' || n_nationkey AS node FROM nation)
SELECT node, dst AS other, kind, 'out' AS way FROM edges JOIN s ON src = node UNION ALL SELECT node, src, kind, 'in' FROM edges JOIN s ON dst = node""")
def neighbourhood(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return graph.neighbourhood(edges(d), d.nation.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("node")))


_PATHS = "paths AS (SELECT DISTINCT p_brand || '/' || replace(p_type, ' ', '/') || '/' || p_partkey AS path, p_size AS size FROM part)"


def _paths(d):
    return d.part.select(F.concat_ws("/", "p_brand", F.translate("p_type", " ", "/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("size")).distinct()


@query(f"""WITH {_PATHS}, e AS (SELECT string_split(path, '/') AS p, size FROM paths), x AS (SELECT array_to_string(p[1:i], '/') AS dir, size FROM (SELECT p, size, unnest(range(1, len(p))) AS i FROM e))
SELECT dir, count(*) AS n, sum(size)::BIGINT AS total, len(string_split(dir, '/'))::INT AS depth FROM x GROUP BY dir""")
def folder_rollup(spark, sf_dir):
    return graph.rollup_paths(_paths(Tables(spark, sf_dir)), "size")


@query(f"""WITH {_PATHS}, e AS (SELECT path, string_split(path, '/') AS p FROM paths), x AS (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM e)
SELECT DISTINCT 'dir:' || array_to_string(p[1:i - 1], '/') AS src, CASE WHEN i = len(p) THEN 'file:' || path ELSE 'dir:' || array_to_string(p[1:i], '/') END AS dst FROM x""")
def containment(spark, sf_dir):
    return graph.containment(_paths(Tables(spark, sf_dir)))


_CROSS = """SELECT least(c.c_nationkey, s.s_nationkey) AS a, greatest(c.c_nationkey, s.s_nationkey) AS b, count(*) AS weight
FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"""


def _cross(d):
    e = d.lineitem.join(d.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"))
    groups = d.customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_nationkey").alias("grp")).union(d.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")), "s_nationkey"))
    return graph.cross_group(e, groups)


@query(_CROSS)
def cross_group_links(spark, sf_dir):
    return _cross(Tables(spark, sf_dir))


@query()
def strongest_links(spark, sf_dir):
    """Greedy with a cap on each end; no SQL: a skip-and-continue fold."""
    return graph.strongest_links(_cross(Tables(spark, sf_dir)))


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS node, 0 AS hop FROM part WHERE p_size = 50), d AS (SELECT DISTINCT l_orderkey + 1000000000 AS item, l_partkey AS key FROM lineitem UNION SELECT DISTINCT o_custkey + 5000000000, o_orderkey + 1000000000 FROM orders),
a AS (SELECT DISTINCT item AS node, 1 AS hop FROM s JOIN d ON key = node), b AS (SELECT DISTINCT item AS node, 2 AS hop FROM a JOIN d ON key = node)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def invalidation(spark, sf_dir):
    """Parts of one size changed: orders that hold them and their customers are stale."""
    d = Tables(spark, sf_dir)
    depends = d.lineitem.select((F.col("l_orderkey") + 1000000000).alias("item"), F.col("l_partkey").alias("key")).union(d.orders.select(F.col("o_custkey") + 5000000000, F.col("o_orderkey") + 1000000000)).distinct()
    return graph.propagate(depends, d.part.where("p_size = 50").select(F.col("p_partkey").alias("key")))


@query("""WITH p AS (SELECT DISTINCT p_brand || p_size AS key, 'part:' || p_type AS dst FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM p),
w AS (SELECT DISTINCT 'order:' || l_orderkey AS src, p_brand || p_size AS key FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT src, coalesce(dst, 'external:' || w.key) AS dst, max(CASE WHEN n IS NULL THEN 0.2::DOUBLE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) AS confidence FROM w LEFT JOIN (SELECT * FROM c WHERE n <= 8) c ON w.key = c.key GROUP BY 1, 2""")
def import_resolution(spark, sf_dir):
    """Orders import the keys of their parts, brand and size, from all parts' types."""
    d = Tables(spark, sf_dir)
    key = F.concat("p_brand", F.col("p_size").cast("string")).alias("key")
    provided = d.part.select(key, F.concat(F.lit("part:"), F.col("p_type")).alias("dst"))
    wanted = d.lineitem.join(d.part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("order:"), F.col("l_orderkey")).alias("src"), key)
    return resolution.import_targets(wanted, provided).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
