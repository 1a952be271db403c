"""Queries for coverage, risk, ranking quality, contradictions, joins by interval and fallback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import measures
from .registry import Tables, query


@query("""WITH s AS (SELECT source, count(*) AS files, count(DISTINCT l.doc_id) AS labelled, count(*) FILTER (WHERE n_chars > 1000) AS long FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)
SELECT source, files, labelled, round(coalesce(labelled / nullif(files, 0)::DOUBLE, 0), 6) AS label_coverage, round(coalesce(labelled / nullif(long, 0)::DOUBLE, 0), 6) AS per_long FROM s""")
def semantic_coverage(spark, sf_dir):
    d = Tables(spark, sf_dir)
    joined = d.documents.join(d.labels.select("doc_id", F.col("doc_id").alias("known")), "doc_id", "left")
    s = joined.groupBy("source").agg(F.count("*").alias("files"), F.countDistinct("known").alias("labelled"), F.count_if(F.col("n_chars") > 1000).alias("long"))
    ratio = lambda a, b: F.round(measures.share(F.col(a), F.col(b)), 6)
    return s.select("source", "files", "labelled", ratio("labelled", "files").alias("label_coverage"), ratio("labelled", "long").alias("per_long"))


_PARTS = """SELECT o_orderkey AS id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][o_orderkey % 4 + 1] AS risk, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS entity,
  CASE WHEN o_custkey % 5 > 0 THEN avg(CASE WHEN l_quantity < 40 THEN 1.0 ELSE 0.0 END)::DOUBLE END AS dep, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE AS evidence,
  CASE WHEN o_custkey % 3 > 0 THEN 1.0::DOUBLE END AS health, count(*) FILTER (WHERE l_discount > 0.09) AS blocking FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey"""
_RISKS = "(VALUES ('LOW', 0.55, 0.5), ('MEDIUM', 0.70, 0.8), ('HIGH', 0.85, 0.95), ('CRITICAL', 0.90, 1.0)) t(risk, least, least_dep)"


@query(f"""WITH p AS ({_PARTS}), c AS (SELECT *, round((0.4::DOUBLE * coalesce(entity, 0) + 0.3::DOUBLE * coalesce(dep, 0) + 0.2::DOUBLE * coalesce(evidence, 0) + 0.1::DOUBLE * coalesce(health, 0))
  / (CASE WHEN entity IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN dep IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN evidence IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN health IS NULL THEN 0 ELSE 0.1::DOUBLE END), 6) AS coverage FROM p)
SELECT id, c.risk, coverage, coverage >= least::DOUBLE AND coalesce(dep, 1.0) >= least_dep::DOUBLE AND blocking = 0 AS ready FROM c JOIN {_RISKS} ON c.risk = t.risk""")
def readiness(spark, sf_dir):
    """Orders as questions, their lines as evidence: shares of lines stand in for found entities, dependencies and evidence."""
    d = Tables(spark, sf_dir)
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    risks = F.array(*map(F.lit, measures.LEVEL_NAMES))
    rows = d.orders.join(d.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_custkey").agg(
        flag(F.col("l_returnflag") != "R").alias("entity"), flag(F.col("l_quantity") < 40).alias("dep"), flag(F.col("l_linestatus") == "F").alias("evidence"), F.count_if(F.col("l_discount") > 0.09).alias("blocking")
    )
    rows = rows.withColumn("dep", F.when(F.col("o_custkey") % 5 > 0, F.col("dep"))).withColumn("health", F.when(F.col("o_custkey") % 3 > 0, 1.0))
    rows = rows.withColumn("risk", F.element_at(risks, (F.col("o_orderkey") % 4 + 1).cast("int")))
    return measures.readiness(rows).select(F.col("o_orderkey").alias("id"), "risk", "coverage", "ready")


@query("""WITH r AS (SELECT c_custkey AS id, count(o_orderkey) AS blast, c_custkey % 11 = 0 AS security, c_custkey % 7 = 0 AS exposed, c_custkey % 13 = 0 AS schema, c_custkey % 5 = 0 AS scripts, c_custkey % 17 = 0 AS contract,
  c_custkey % 2 = 0 AS untested, c_custkey % 3 = 0 AS routes, c_custkey % 6 AS fixes, c_custkey % 4 AS rules, c_custkey % 9 AS weak_files, c_custkey % 8 AS unresolved FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey),
p AS (SELECT *, CASE WHEN blast >= 40 THEN 4 WHEN blast >= 15 THEN 3 WHEN blast >= 5 THEN 2 WHEN blast >= 1 THEN 1 ELSE 0 END + CASE WHEN security THEN 2 WHEN exposed THEN 1 ELSE 0 END + CASE WHEN schema THEN 2 WHEN scripts THEN 1 ELSE 0 END
  + contract::INT + CASE WHEN untested AND routes THEN 3 WHEN untested THEN 2 ELSE 0 END + (fixes >= 3)::INT + (rules > 0)::INT + (weak_files >= 5)::INT + (unresolved > 0)::INT AS points FROM r)
SELECT id, points, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][1 + greatest(CASE WHEN points >= 7 THEN 3 WHEN points >= 5 THEN 2 WHEN points >= 3 THEN 1 ELSE 0 END, CASE WHEN security THEN 2 WHEN schema THEN 1 ELSE 0 END)] AS risk FROM p""")
def risk_scores(spark, sf_dir):
    """Customers as changed files, their orders as dependents; the flags are remainders of the key."""
    d = Tables(spark, sf_dir)
    k = F.col("c_custkey")
    flags = {"security": k % 11 == 0, "exposed": k % 7 == 0, "schema": k % 13 == 0, "scripts": k % 5 == 0, "contract": k % 17 == 0, "untested": k % 2 == 0, "routes": k % 3 == 0, "fixes": k % 6, "rules": k % 4, "weak_files": k % 9, "unresolved": k % 8}
    rows = d.customer.join(d.orders, k == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("blast"))
    return measures.risk_points(rows.select("c_custkey", "blast", *(c.alias(n) for n, c in flags.items()))).select(F.col("c_custkey").alias("id"), "points", "risk")


_RANKED = """ranked AS (SELECT 'price' AS arm, o_custkey AS q, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
  UNION ALL SELECT 'date', o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) FROM orders),
want AS (SELECT DISTINCT o_custkey AS q, o_orderkey AS doc FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
cases AS (SELECT arm, q, count(*) AS n_relevant, count(rank) AS n_found, round(count(rank) / count(*)::DOUBLE, 6) AS recall, coalesce(min(rank) = 1, false) AS top1_hit
  FROM (SELECT a.arm, w.q, w.doc, r.rank FROM want w CROSS JOIN (SELECT DISTINCT arm FROM ranked) a LEFT JOIN ranked r ON r.arm = a.arm AND r.q = w.q AND r.doc = w.doc AND r.rank <= 5) GROUP BY arm, q)"""


def _cases(d):
    own = lambda arm, c: d.orders.select(F.lit(arm).alias("arm"), F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(c), "o_orderkey")).alias("rank"))
    want = d.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("doc"))
    return measures.ranking_quality(own("price", "o_totalprice").union(own("date", "o_orderdate")), want, 5)


@query(f"WITH {_RANKED} SELECT * FROM cases")
def ranking_quality(spark, sf_dir):
    """Customers as questions, urgent and high orders as relevant, two orders of theirs as arms."""
    return _cases(Tables(spark, sf_dir))


@query(f"WITH {_RANKED} SELECT arm, count(*) AS n_cases, round(avg(recall), 6) AS macro_recall, round(sum(n_found) / sum(n_relevant)::DOUBLE, 6) AS micro_recall, round(avg(top1_hit::INT), 6) AS top1 FROM cases GROUP BY arm")
def evaluation(spark, sf_dir):
    return measures.quality_by_arm(_cases(Tables(spark, sf_dir)))


@query("""WITH s AS (SELECT o_custkey AS subject, o_orderstatus AS saying, max({'t': substr(o_orderpriority, 1, 1), 'u': o_orderdate, 'i': -o_orderkey}) AS best FROM orders GROUP BY ALL), t AS (SELECT subject, max(best) AS top FROM s GROUP BY subject HAVING count(*) > 1)
SELECT s.subject, -top.i AS top, -best.i AS other FROM s JOIN t ON s.subject = t.subject WHERE best <> top""")
def contradictions(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select(F.col("o_custkey").alias("subject"), F.concat(F.lit("  "), "o_orderstatus").alias("saying"), "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("trust"), "o_orderdate")
    return measures.contradictions(rows, ["subject"], "saying", "o_orderkey", "trust", "o_orderdate")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS severity FROM lineitem), c AS (SELECT severity, count(*) AS n_of_severity FROM f GROUP BY severity)
SELECT l_orderkey, l_linenumber, f.severity, n_of_severity FROM (SELECT * FROM f ORDER BY severity, l_orderkey, l_linenumber LIMIT 300) f JOIN c ON f.severity = c.severity""")
def most_serious(spark, sf_dir):
    flag = F.col("l_returnflag")
    found = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.when(flag == "R", 0).when(flag == "A", 1).otherwise(2).alias("severity"))
    return measures.most_serious(found, "severity", ["l_orderkey", "l_linenumber"], 300)


_PATHS = "SELECT replace(p_type, ' ', '/') || '/' || p_partkey AS path, p_brand, p_size FROM part"


def _paths(d):
    return d.part.select(F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), F.col("p_partkey").cast("string")).alias("path"), "p_brand", "p_size")


@query(f"SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM ({_PATHS}) GROUP BY folder ORDER BY n DESC, folder LIMIT 6")
def folder_histogram(spark, sf_dir):
    return measures.folder_histogram(_paths(Tables(spark, sf_dir)), "path")


@query(f"""WITH p AS ({_PATHS}), s AS (SELECT split_part(path, '/', 1) AS s, count(*) AS n FROM p GROUP BY s), d AS (SELECT max(n) * 2 > sum(n) AS deep FROM s)
SELECT path, CASE WHEN deep THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS "group" FROM p, d""")
def group_depth(spark, sf_dir):
    return measures.group_depth(_paths(Tables(spark, sf_dir)), "path").select("path", "group")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def best_of(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return measures.best_of(rows, ["o_custkey"], [F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderkey")]).drop("o_orderstatus")


@query("""SELECT o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) ORDER BY place, o_orderpriority LIMIT 42""")
def round_robin(spark, sf_dir):
    return measures.round_robin(Tables(spark, sf_dir).orders, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 42).select("o_orderpriority", "o_orderkey", "place")


@query("""WITH s AS (SELECT o_custkey AS k, month(o_orderdate) AS a, month(o_orderdate) + o_orderkey % 4 AS z, o_orderkey AS name FROM orders), p AS (SELECT c_custkey AS k, unnest([3, 6, 9]) AS line FROM customer)
SELECT p.k, p.line, m.name FROM p LEFT JOIN (SELECT k, line, name FROM (SELECT p.k, p.line, s.name, row_number() OVER (PARTITION BY p.k, p.line ORDER BY a DESC, z, s.name DESC) AS r FROM p JOIN s ON p.k = s.k AND a <= line AND line <= z) WHERE r = 1) m ON p.k = m.k AND p.line = m.line""")
def innermost_span(spark, sf_dir):
    d = Tables(spark, sf_dir)
    month = F.month("o_orderdate")
    spans = d.orders.select(F.col("o_custkey").alias("k"), month.alias("a"), (month + F.col("o_orderkey") % 4).alias("z"), F.col("o_orderkey").alias("name"))
    points = d.customer.select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit(3), F.lit(6), F.lit(9))).alias("line"))
    return measures.innermost(points, spans, "k", "line", "a", "z", "name")


@query("""WITH n AS (SELECT p_partkey AS name FROM part), s AS (SELECT p_partkey AS name, 'part/' || p_partkey AS path FROM part WHERE p_size > 25), c AS (SELECT DISTINCT l_partkey AS name, 'supplier/' || l_suppkey AS path FROM lineitem),
m AS (SELECT c.name, c.path FROM c JOIN n ON c.name = n.name WHERE c.name NOT IN (SELECT name FROM s)), f AS (SELECT name FROM m GROUP BY name HAVING count(*) <= 12)
SELECT n.name, path, 'symbol' AS source FROM n JOIN s ON n.name = s.name UNION ALL
SELECT name, path, 'content' FROM (SELECT m.*, row_number() OVER (PARTITION BY m.name ORDER BY length(path), path) AS r FROM m JOIN f ON m.name = f.name) WHERE r <= 3""")
def fallback_join(spark, sf_dir):
    d = Tables(spark, sf_dir)
    path = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("path")
    symbols = d.part.where("p_size > 25").select(F.col("p_partkey").alias("name"), path("part/", "p_partkey"))
    contents = d.lineitem.select(F.col("l_partkey").alias("name"), path("supplier/", "l_suppkey"))
    return measures.fallback_join(d.part.select(F.col("p_partkey").alias("name")), symbols, contents, "name", 12, 3, F.length("path"))


@query("SELECT l_suppkey, count(*) AS n_cases, count(*) FILTER (WHERE l_quantity <= 25 AND l_returnflag IN ('N', 'A')) AS n_passed, round(avg((l_quantity <= 25 AND l_returnflag IN ('N', 'A'))::INT), 6) AS pass_rate FROM lineitem GROUP BY l_suppkey")
def suite_scores(spark, sf_dir):
    return measures.suite_scores(Tables(spark, sf_dir).lineitem, "l_suppkey", (F.col("l_quantity") <= 25) & F.col("l_returnflag").isin("N", "A"))


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL")
def log_statistics(spark, sf_dir):
    return measures.log_statistics(Tables(spark, sf_dir).events, "event_type", "ts", "user_id")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def orphans(spark, sf_dir):
    """Parts that no large line refers to: an anti-join."""
    d = Tables(spark, sf_dir)
    return d.part.select("p_partkey").join(d.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")
def shared_keys(spark, sf_dir):
    d = Tables(spark, sf_dir)
    return d.orders.select("o_orderkey").intersect(d.lineitem.where("l_quantity > 49").select("l_orderkey"))


@query("""SELECT s_suppkey, n_name, count(*) AS n, list_sort(list(DISTINCT p_brand)) AS brands FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def provider_capabilities(spark, sf_dir):
    """Suppliers as providers, brands as capabilities: the bridge joined both ways and gathered; brands are few."""
    d = Tables(spark, sf_dir)
    joined = d.lineitem.join(d.part, F.col("l_partkey") == F.col("p_partkey")).join(d.supplier.join(d.nation, F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("s_suppkey", "n_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("p_brand")).alias("brands"))


@query("""SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderstatus NOT IN ('P') JOIN nation ON c_nationkey = n_nationkey AND substr(c_mktsegment, 1, 1) <> substr(n_name, 1, 1) GROUP BY n_name""")
def linked_counts(spark, sf_dir):
    """A join on several conditions, and distinct counts of what is linked."""
    d = Tables(spark, sf_dir)
    own = d.customer.join(d.nation, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.substring("c_mktsegment", 1, 1) != F.substring("n_name", 1, 1)))
    return own.join(d.orders.where("o_orderstatus NOT IN ('P')"), F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"))


@query("SELECT event_id, event_type, ts, c_name FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey < 10 AND ts > TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 250")
def activity_join(spark, sf_dir):
    """The newest events with the run they belong to."""
    d = Tables(spark, sf_dir)
    own = d.events.where("ts > TIMESTAMP_NTZ '2024-01-05'").join(d.customer.where("c_nationkey < 10"), F.col("user_id") == F.col("c_custkey"))
    return own.select("event_id", "event_type", "ts", "c_name").orderBy(F.desc("ts"), F.desc("event_id")).limit(250)
