"""Interfaces described by the tables: a customer's orders as operations, in an old and a new version; XML of nations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts
from .registry import Tables, query


def _specs(d, new: bool):
    k = F.col("o_orderkey")
    parameter = lambda name, required: F.struct(F.lit(name).alias("name"), required.alias("required"))
    codes = F.array_compact(F.array(F.lit("200"), F.when(k % 3 == 0, "404"), F.when(k % 4 == 0, "500") if not new else F.lit(None).cast("string")))
    body = F.struct(
        (k % 11 == 0).alias("deprecated"), F.array(parameter("p", (k % 2 == 0) & F.lit(new)), parameter("q", F.lit(True))).alias("parameters"), F.map_from_arrays(codes, F.transform(codes, lambda c: F.struct(c.alias("description")))).alias("responses")
    )
    method = F.when(k % 6 == 0, "post").otherwise("get")
    item = F.to_json(F.map_from_arrays(F.array(method), F.array(body)))
    kept = d.orders.where(k % 5 != 0) if new else d.orders.where(k % 7 != 0)
    entry = F.concat(F.lit('"/orders/'), k.cast("string"), F.lit('": '), item)
    paths = kept.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("paths"))
    text = F.concat(F.lit('{"openapi": "3.0", "info": {"title": "customer '), F.col("o_custkey").cast("string"), F.lit('", "version": "1"}, "paths": {'), "paths", F.lit('}, "components": {"schemas": {"a": {}}, "securitySchemes": {"key": {}, "basic": {}}}}'))
    return paths.select(F.col("o_custkey").alias("name"), text.alias("text"))


_OPERATIONS = """ops AS (SELECT o_custkey AS name, CASE WHEN o_orderkey % 6 = 0 THEN 'POST' ELSE 'GET' END || ' /orders/' || o_orderkey AS operation, o_orderkey AS k FROM orders),
new AS (SELECT * FROM ops WHERE k % 5 <> 0), old AS (SELECT * FROM ops WHERE k % 7 <> 0)"""


@query(f"""WITH {_OPERATIONS} SELECT name, operation, 'p=' || (k % 2 = 0)::VARCHAR || ',q=true' AS parameters, '200' || CASE WHEN k % 3 = 0 THEN ',404' ELSE '' END AS responses, k % 11 = 0 AS deprecated FROM new""")
def api_operations(spark, sf_dir):
    found = contracts.operations(_specs(Tables(spark, sf_dir), True))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return found.select("name", "operation", told.alias("parameters"), F.array_join("responses", ",").alias("responses"), "deprecated")


@query(f"WITH {_OPERATIONS} SELECT name, 'customer ' || name AS title, '1' AS version, count(*)::INT AS paths, 1 AS schemas, 'basic,key' AS auth_schemes, count(*) AS operations FROM new GROUP BY name")
def api_summaries(spark, sf_dir):
    return contracts.summaries(_specs(Tables(spark, sf_dir), True))


@query(f"""WITH {_OPERATIONS}, named AS (SELECT DISTINCT name FROM new WHERE name IN (SELECT name FROM old))
SELECT name, change, operation, detail FROM (SELECT name, 'removed' AS change, operation, '' AS detail FROM old WHERE k % 5 = 0 UNION ALL SELECT name, 'added', operation, '' FROM new WHERE k % 7 = 0
  UNION ALL SELECT name, 'required', operation, 'p' FROM new WHERE k % 7 <> 0 AND k % 2 = 0 UNION ALL SELECT name, 'response', operation, '500' FROM new WHERE k % 7 <> 0 AND k % 4 = 0) WHERE name IN (SELECT name FROM named)""")
def api_breaking_changes(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return contracts.breaking(_specs(d, False), _specs(d, True))


@query("""SELECT 'n' || n_nationkey AS path, 'read' AS status, 'nation' AS root, 1 + count(c_custkey) * 2 + count(*) FILTER (WHERE c_acctbal < 0) AS elements, CASE WHEN count(c_custkey) = 0 THEN 1 WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN 4 ELSE 3 END AS max_depth,
count(c_custkey)::INT AS n_top FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def xml_structure(spark, sf_dir):
    """A nation's customers as XML, with comments and CDATA that hold tags."""
    d = Tables(spark, sf_dir)
    debt = F.when(F.col("c_acctbal") < 0, '<debt at="1>2"/>'.replace("1>2", "1")).otherwise("")
    one = F.concat(F.lit("<customer id='"), F.col("c_custkey").cast("string"), F.lit("'><!-- <no> --><name><![CDATA[<x>]]>"), debt, F.lit("</name></customer>"))
    rows = d.nation.join(d.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.concat(F.lit('<?xml version="1.0"?><nation xmlns="urn:n">'), F.array_join(F.collect_list(one), "\n"), F.lit("</nation>")).alias("text"))
    found = contracts.xml_structures(rows.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), "text"))
    return found.select("path", "status", "root", "elements", "max_depth", F.size("top_level").alias("n_top"))
