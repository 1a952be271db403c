"""Source files that Spark writes from the tables, and what is extracted from them.

SQL states the symbols, imports and calls that each file must have, from the
same rows that the file was made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import entities, symbols
from ..storage import spread, stage
from .registry import Tables, query

_JAVA = """package shop.parts;
import shop.suppliers.Base;

/* class Fake { void no() { } } */
public class Part%d extends Base {
    private int size = %d; // if (x) { }
    @Override
    public String label(int n) {
        String s = "{ not a block }";
        if (n > 0) { return fmt%d(n); }
        return name%d();
    }
    int name%d() {
        return size;
    }
}
"""
_PYTHON = '''"""def no(): pass"""
from shop.suppliers import s%d as first
import os

LIMIT = %d


class Supplier%d:
    name: str = "class No:"

    def offer%d(self, x=(1,
            2)):
        def inner():
            return deep(x)
        return inner()


def total():
    return offer%d(LIMIT)  # again(1)
'''
_SCRIPT = """import { make } from './c%d';
export const RATE = 3;
export function ship%d<T>(x: { a: string }): T {
  return make%d(x, () => { return pack(x); });
}
"""
_SQL = """-- CREATE TABLE no (x int)
CREATE VIEW orders_%d AS
SELECT * FROM customer_%d JOIN part USING (k);
"""


def source_files(d: Tables):
    """path, language, text: a class for each part, a module for each supplier, a script for each customer, a view for each order.

    The rows are spread before texts are made of them: a row of a few bytes becomes a file that takes long to read.
    """
    file = lambda path, c, language, body, *values: (F.format_string(path, c).alias("path"), F.lit(language).alias("language"), F.format_string(body, *values).alias("text"))
    parts = spread(d.part.select("p_partkey", "p_size"), "p_partkey").select(*file("parts/Part%d.java", "p_partkey", "java", _JAVA, "p_partkey", "p_size", "p_size", "p_partkey", "p_partkey"))
    near = F.col("s_suppkey") % 10
    modules = spread(d.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey").select(*file("shop/suppliers/s%d.py", "s_suppkey", "python", _PYTHON, near, "s_nationkey", "s_suppkey", "s_suppkey", near))
    half = F.expr("c_custkey div 2")
    scripts = spread(d.customer.select("c_custkey"), "c_custkey").select(*file("web/c%d.ts", "c_custkey", "typescript", _SCRIPT, half, "c_custkey", half))
    views = spread(d.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select(*file("db/o%d.sql", "o_orderkey", "sql", _SQL, "o_orderkey", "o_custkey"))
    return parts.unionByName(modules).unionByName(scripts).unionByName(views)


_FACTS = """
j AS (SELECT 'parts/Part' || p_partkey || '.java' AS path, p_partkey AS p, p_size AS z FROM part), p AS (SELECT 'shop/suppliers/s' || s_suppkey || '.py' AS path, s_suppkey AS s, s_suppkey % 10 AS m FROM supplier),
t AS (SELECT 'web/c' || c_custkey || '.ts' AS path, c_custkey AS c, c_custkey // 2 AS h FROM customer), v AS (SELECT 'db/o' || o_orderkey || '.sql' AS path, o_orderkey AS o, o_custkey AS c FROM orders),
symbols AS (SELECT path, 'class' AS kind, 'Part' || p AS name, 'Part' || p AS qualified, 5 AS start_line, 16 AS end_line FROM j UNION ALL SELECT path, 'method', 'label', 'Part' || p || '.label', 8, 12 FROM j
  UNION ALL SELECT path, 'method', 'name' || p, 'Part' || p || '.name' || p, 13, 15 FROM j UNION ALL SELECT path, 'variable', 'LIMIT', 'LIMIT', 5, 5 FROM p UNION ALL SELECT path, 'class', 'Supplier' || s, 'Supplier' || s, 8, 15 FROM p
  UNION ALL SELECT path, 'field', 'name', 'Supplier' || s || '.name', 9, 9 FROM p UNION ALL SELECT path, 'method', 'offer' || s, 'Supplier' || s || '.offer' || s, 11, 15 FROM p
  UNION ALL SELECT path, 'function', 'inner', 'Supplier' || s || '.offer' || s || '.inner', 13, 14 FROM p UNION ALL SELECT path, 'function', 'total', 'total', 18, 19 FROM p
  UNION ALL SELECT path, 'variable', 'RATE', 'RATE', 2, 2 FROM t UNION ALL SELECT path, 'function', 'ship' || c, 'ship' || c, 3, 5 FROM t UNION ALL SELECT path, 'view', 'orders_' || o, 'orders_' || o, 2, 3 FROM v),
calls AS (SELECT path, 'Part' || p || '.label' AS qualified, 'fmt' || z AS name, 10 AS line FROM j UNION ALL SELECT path, 'Part' || p || '.label', 'name' || p, 11 FROM j
  UNION ALL SELECT path, 'Supplier' || s || '.offer' || s, 'deep', 14 FROM p UNION ALL SELECT path, 'Supplier' || s || '.offer' || s, 'inner', 15 FROM p UNION ALL SELECT path, 'total', 'offer' || m, 19 FROM p
  UNION ALL SELECT path, 'ship' || c, 'make' || h, 4 FROM t UNION ALL SELECT path, 'ship' || c, 'pack', 4 FROM t)"""


@query(f"WITH {_FACTS} SELECT path, kind, name, qualified, start_line, end_line FROM symbols")
def source_symbols(spark, sf_dir):
    found = symbols.source_facts(source_files(Tables(spark, sf_dir)), "symbol")
    return found.where("fact = 'symbol'").select("path", "kind", "name", "qualified", "start_line", "end_line")


@query(f"WITH {_FACTS} SELECT path, qualified, name, line FROM calls UNION ALL SELECT path, 'orders_' || o, 'customer_' || c, 3 FROM v UNION ALL SELECT path, 'orders_' || o, 'part', 3 FROM v")
def source_calls(spark, sf_dir):
    found = symbols.source_facts(source_files(Tables(spark, sf_dir)), "call")
    return found.where("fact = 'call'").select("path", "qualified", "name", F.col("start_line").alias("line"))


_IMPORTED = """wanted AS (SELECT path, 'shop.suppliers.Base' AS key FROM j UNION ALL SELECT path, unnest(['shop.suppliers', 'shop.suppliers.s' || m, 'os']) FROM p UNION ALL SELECT path, 'web/c' || h FROM t),
given AS (SELECT 'shop.parts.Part' || p AS key, path FROM j UNION ALL SELECT unnest(['s' || s, 'suppliers.s' || s, 'shop.suppliers.s' || s]), path FROM p UNION ALL SELECT 'web/c' || c, path FROM t),
edges AS (SELECT DISTINCT w.path AS src, w.key AS key, g.path AS dst FROM wanted w LEFT JOIN given g ON g.key = w.key WHERE g.path IS NULL OR g.path <> w.path)"""


@query(f"WITH {_FACTS}, {_IMPORTED} SELECT 'file:' || src AS src, key, coalesce('file:' || dst, 'external:' || key) AS dst, CASE WHEN dst IS NULL THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM edges")
def source_imports(spark, sf_dir):
    return symbols.import_edges(stage(symbols.source_facts(source_files(Tables(spark, sf_dir)), "symbol", "import", "provides"), "facts"))


_MET = """named AS (SELECT DISTINCT 'symbol:' || path || '::' || qualified AS src, path, name FROM calls), known AS (SELECT DISTINCT name, path, 'symbol:' || path || '::' || qualified AS symbol FROM symbols),
one AS (SELECT name, min(symbol) AS symbol FROM known GROUP BY name HAVING count(*) = 1),
every AS (SELECT src, n.name, symbol AS dst, 0.95::DOUBLE AS c FROM named n JOIN known k ON k.name = n.name AND k.path = n.path
  UNION SELECT n.src, n.name, symbol, 0.8::DOUBLE FROM named n JOIN edges e ON e.src = n.path JOIN known k ON k.name = n.name AND k.path = e.dst
  UNION SELECT src, n.name, symbol, 0.3::DOUBLE FROM named n JOIN one USING (name) UNION SELECT src, name, 'callee:' || name, 0.2::DOUBLE FROM named)"""


@query(f"WITH {_FACTS}, {_IMPORTED}, {_MET} SELECT src, dst, max(c) AS confidence FROM (SELECT *, max(c) OVER (PARTITION BY src, name) AS best FROM every) WHERE c = best GROUP BY src, dst")
def source_call_graph(spark, sf_dir):
    """From texts to resolved calls: own file, imported files, the only one of its name, or a placeholder."""
    found = stage(symbols.source_facts(source_files(Tables(spark, sf_dir))), "facts")
    return symbols.call_edges(found, symbols.import_edges(found))


_ASKED = """
asked AS (SELECT p_partkey AS q, p_partkey AS p, p_partkey % 10 AS s FROM part),
spread AS (SELECT c, path, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY path) AS place FROM v),
hits AS (SELECT q, 'file:parts/Part' || p || '.java' AS id, 0 AS turn, '' AS path, '' AS qualified FROM asked
  UNION ALL SELECT q, 'symbol:' || path || '::' || qualified, 1, path, qualified FROM asked JOIN symbols ON name IN ('name' || p, 'Supplier' || s, 'offer' || s, 'orders_' || p)
  UNION ALL SELECT q, 'file:' || path, 2, lpad(place::VARCHAR, 2, '0'), '' FROM asked JOIN spread ON c = p WHERE n <= 12 AND place <= 3)"""


@query(f"WITH {_FACTS}, {_ASKED} SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY turn, path, qualified) AS rank FROM hits")
def exact_hits(spark, sf_dir):
    """A question for each part that names its file, a method in backticks, a dotted name, a view and a table that only texts mention."""
    d = Tables(spark, sf_dir)
    files = stage(source_files(d), "files")
    # read for names, qualified names and what is left of these
    found = stage(symbols.source_facts(files, "symbol").where("fact = 'symbol'").select("path", "name", "qualified", "kind", F.lit(True).alias("exported")), "symbols")
    names = files.select("path", "language", F.explode(t.names(F.col("text"))).alias("name"), F.lit(1).alias("chunks"))
    k, s = F.col("p_partkey"), F.col("p_partkey") % 10
    text = F.format_string("why does `name%d(x)` of Part%d.java need Supplier%d.offer%d, orders_%d and customer_%d?", k, k, s, s, k, k)
    # as with the files, a question is made of a few bytes and takes long to read
    questions = spread(d.part.select("p_partkey"), "p_partkey").select(k.alias("q"), text.alias("text"))
    return entities.exact_retriever(questions, files, found, names)
