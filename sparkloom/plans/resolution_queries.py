"""Queries that resolve calls and imports, whole and after a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolution as r
from ..storage import stage
from .registry import Tables, query

# a customer's file calls its orders' parts by brand and size, imports suppliers whose lines it returned, and defines what stands on seventh lines;
# a supplier's file defines its parts
_LINES = """ln AS (SELECT 'o' || l_orderkey AS src, 'c' || o_custkey AS file, p_brand || p_size AS name, 's' || l_suppkey AS sfile, p_partkey, l_returnflag, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_STATE = f"""{_LINES},
calls AS (SELECT DISTINCT src, file, name FROM ln), imports AS (SELECT DISTINCT file, sfile AS imported FROM ln WHERE l_returnflag = 'R'),
symbols AS (SELECT DISTINCT name, sfile AS file, sfile || '::' || p_partkey AS symbol FROM ln UNION SELECT DISTINCT name, file, file || '::' || p_partkey FROM ln WHERE l_linenumber = 7),
only_one AS (SELECT name, min(symbol) AS symbol FROM symbols GROUP BY name HAVING count(*) = 1),
every AS (SELECT src, c.file, c.name, symbol AS dst, 0.95::DOUBLE AS c FROM calls c JOIN symbols s ON s.name = c.name AND s.file = c.file
  UNION SELECT src, c.file, c.name, symbol, 0.8::DOUBLE FROM calls c JOIN imports i ON i.file = c.file JOIN symbols s ON s.name = c.name AND s.file = i.imported
  UNION SELECT src, file, c.name, symbol, 0.3::DOUBLE FROM calls c JOIN only_one USING (name) UNION SELECT src, file, name, 'callee:' || name, 0.2::DOUBLE FROM calls),
targets AS (SELECT src, file, name, dst, c AS confidence FROM (SELECT *, max(c) OVER (PARTITION BY src, file, name) AS best FROM every) WHERE c = best)"""


def _lines(d):
    """Lines with their order's customer and their part's name, joined and written once for all that is made of them."""
    lines = d.lineitem.join(d.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(d.part, F.col("l_partkey") == F.col("p_partkey"))
    return stage(lines.select("l_orderkey", "o_custkey", "l_suppkey", "p_partkey", "p_brand", "p_size", "l_returnflag", "l_linenumber"), "lines")


def _state(lines):
    """calls, symbols and imports; their rows repeat."""
    own = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    rows = lines.select(own("o", "l_orderkey").alias("src"), own("c", "o_custkey").alias("file"), F.concat("p_brand", F.col("p_size").cast("string")).alias("name"), own("s", "l_suppkey").alias("sfile"), "p_partkey", "l_returnflag", "l_linenumber")
    symbol = lambda c: F.concat(F.col(c), F.lit("::"), F.col("p_partkey").cast("string")).alias("symbol")
    seventh = rows.where("l_linenumber = 7").select("name", "file", symbol("file"))
    symbols = rows.select("name", F.col("sfile").alias("file"), symbol("sfile")).unionByName(seventh)
    return rows.select("src", "file", "name"), symbols, rows.where("l_returnflag = 'R'").select("file", F.col("sfile").alias("imported"))


@query(f"WITH {_STATE} SELECT src, dst, max(confidence) AS confidence FROM targets GROUP BY src, dst")
def call_resolution(spark, sf_dir):
    return r.resolve_calls(*_state(_lines(Tables(spark, sf_dir))))


@query(f"WITH {_STATE} SELECT src, file, name, dst, confidence FROM targets")
def call_re_resolution(spark, sf_dir):
    """Calls resolved without every fiftieth part, then brought up to all parts; SQL resolves all at once."""
    lines = _lines(Tables(spark, sf_dir))
    missing = F.col("p_partkey") % 50 == 0
    old, new = _state(lines.where(~missing)), _state(lines)
    # files that lines of the missing parts say something of
    calls, symbols, _ = _state(lines.where(missing))
    changed = calls.select("file").unionByName(symbols.select("file")).distinct()
    return r.re_resolve_calls(r.call_targets(*old), new[0], old[1], new[1], old[2], new[2], changed)


_PROVIDED = """p AS (SELECT DISTINCT p_brand || p_size AS key, 'part:' || p_type AS dst FROM part), n AS (SELECT key, count(*) AS n FROM p GROUP BY key HAVING count(*) <= 8),
w AS (SELECT DISTINCT 'order:' || l_orderkey AS src, p_brand || p_size AS key FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT src, w.key AS key, coalesce(dst, 'external:' || w.key) AS dst, CASE WHEN n IS NULL THEN 0.2::DOUBLE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM w LEFT JOIN (SELECT * FROM p JOIN n USING (key)) u ON u.key = w.key"""


@query(f"WITH {_PROVIDED}")
def import_re_resolution(spark, sf_dir):
    """Imports of all parts' keys, resolved without every ninth part and then brought up to all."""
    d = Tables(spark, sf_dir)
    key = F.concat("p_brand", F.col("p_size").cast("string")).alias("key")
    provided = d.part.select(key, F.concat(F.lit("part:"), F.col("p_type")).alias("dst"), "p_partkey")
    wanted = d.lineitem.join(d.part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("src"), key)
    old = provided.where("p_partkey % 9 <> 0").select("key", "dst")
    before = stage(r.import_targets(wanted, old), "resolved")
    return r.re_resolve_imports(before, wanted, old, provided.select("key", "dst"), wanted.select("src").limit(0))
