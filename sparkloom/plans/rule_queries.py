"""Queries for line scans, diffs, legal moves, criteria, accounts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from .registry import Tables, query

#: A table of rules of our own for invented prose; real scans bring theirs.  Whether a line matches doesn't depend on how long a run is.
RULES = [("long-number", 0, "[0-9]{9}"), ("address", 1, "[A-Za-z0-9._-]@[A-Za-z0-9-]+[.][a-z]"), ("licence", 2, "(?i)licen[cs]ed? under"), ("template", 2, "[{][{].*[}][}]")]
#: The last rule without going back: if no closing follows the first opening, none follows a later one.
LINEAR_RULES = [*RULES[:3], ("template", 2, "^(?>.*?[{][{]).*[}][}]")]
_SCAN = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), f AS (" + " UNION ALL ".join(
    f"SELECT doc_id, line, '{n}' AS rule, {s} AS severity FROM l WHERE regexp_matches(body, '{p}')" for n, s, p in RULES
) + ")"


def _scan(d):
    return rules.scan_lines(d.documents, "doc_id", "text", LINEAR_RULES)


@query(f"WITH {_SCAN} SELECT doc_id, line, rule, severity FROM f")
def static_scan(spark, sf_dir):
    return _scan(Tables(spark, sf_dir))


@query(f"WITH {_SCAN} SELECT doc_id, count(*) FILTER (WHERE severity = 0) AS n_0, count(*) FILTER (WHERE severity = 1) AS n_1, count(*) FILTER (WHERE severity = 2) AS n_2, CASE min(severity) WHEN 0 THEN 'block' WHEN 1 THEN 'warn' ELSE 'note' END AS verdict FROM f GROUP BY doc_id")
def scan_verdicts(spark, sf_dir):
    return rules.verdicts(_scan(Tables(spark, sf_dir)), "doc_id")


_SPLIT = "unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)))"


@query(f"""WITH a AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'one more line' WHEN doc_id % 3 = 1 THEN split_part(text, chr(10), 1) ELSE text END AS text FROM documents),
c AS (SELECT doc_id, line, sum(n) AS n FROM (SELECT doc_id, {_SPLIT} AS line, -1 AS n FROM a UNION ALL SELECT doc_id, {_SPLIT}, 1 FROM b) GROUP BY ALL)
SELECT doc_id, sum(greatest(n, 0))::BIGINT AS added, sum(greatest(-n, 0))::BIGINT AS removed FROM c GROUP BY doc_id""")
def line_diff(spark, sf_dir):
    before = Tables(spark, sf_dir).documents.select("doc_id", "text")
    k = F.col("doc_id") % 3
    after = before.withColumn("text", F.when(k == 0, F.concat("text", F.lit("\none more line"))).when(k == 1, F.substring_index("text", "\n", 1)).otherwise(F.col("text")))
    return rules.line_diff(before, after, "doc_id", "text")


_HISTORY = "h AS (SELECT o_custkey AS item, o_orderkey AS place, CASE o_orderstatus WHEN 'O' THEN 'PROPOSED' WHEN 'F' THEN 'ACCEPTED' ELSE 'REJECTED' END AS state FROM orders)"


def _history(d):
    s = F.col("o_orderstatus")
    return d.orders.select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("place"), F.when(s == "O", "PROPOSED").when(s == "F", "ACCEPTED").otherwise("REJECTED").alias("state"))


@query(f"""WITH {_HISTORY}, b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY item ORDER BY place), 'NEW') AS before FROM h)
SELECT item, place, before, state FROM b WHERE before || '>' || state NOT IN ('NEW>PROPOSED', 'PROPOSED>ACCEPTED', 'PROPOSED>REJECTED', 'ACCEPTED>PROPOSED')""")
def decision_faults(spark, sf_dir):
    legal = {"NEW": ["PROPOSED"], "PROPOSED": ["ACCEPTED", "REJECTED"], "ACCEPTED": ["PROPOSED"]}
    return rules.move_faults(_history(Tables(spark, sf_dir)), "item", "place", "state", legal, "NEW").select("item", "place", "before", "state")


@query(f"WITH {_HISTORY} SELECT state AS stage, count(DISTINCT item) AS n FROM h WHERE state IN ('PROPOSED', 'ACCEPTED') GROUP BY state")
def proposal_funnel(spark, sf_dir):
    return rules.funnel(_history(Tables(spark, sf_dir)), "item", "state", ["PROPOSED", "ACCEPTED"])


@query("SELECT p_partkey, least(p_size % 6, CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 2 WHEN 'ECONOMY' THEN 4 ELSE 5 END) AS rank FROM part")
def clamped_states(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", rules.clamped(F.col("p_size") % 6, {"PROMO": 2, "ECONOMY": 4}, F.substring_index("p_type", " ", 1), 5).alias("rank"))


@query("SELECT l_orderkey, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS open FROM lineitem GROUP BY l_orderkey")
def merged_signals(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.withColumn("returned", F.col("l_returnflag") == "R").withColumn("open", F.col("l_linestatus") == "O")
    return rules.merged_signals(rows, "l_orderkey", ["l_quantity", "l_discount"], ["returned", "open"])


@query("""WITH c AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS kept, bool_and(l_quantity < 45) AS small FROM lineitem GROUP BY l_orderkey) SELECT *, kept AND small AS accepted FROM c""")
def acceptance(spark, sf_dir):
    return rules.criteria(Tables(spark, sf_dir).lineitem, "l_orderkey", {"kept": F.col("l_returnflag") != "R", "small": F.col("l_quantity") < 45})


@query("""WITH b AS (SELECT c_custkey, list_filter([CASE WHEN NOT c_acctbal >= 0 THEN 'balance' END, CASE WHEN NOT c_nationkey < 20 THEN 'nation' END, CASE WHEN NOT (c_mktsegment <> 'BUILDING' OR c_acctbal > 1000) THEN 'segment' END], lambda x: x IS NOT NULL) AS broken FROM customer)
SELECT c_custkey, broken FROM b WHERE len(broken) > 0""")
def rule_violations(spark, sf_dir):
    own = {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey") < 20, "segment": (F.col("c_mktsegment") != "BUILDING") | (F.col("c_acctbal") > 1000)}
    return rules.violations(Tables(spark, sf_dir).customer, own).select("c_custkey", "broken")


@query("SELECT l_suppkey, l_returnflag, count(*) AS n_calls, count(*) FILTER (WHERE l_linestatus = 'F') AS n_failed, sum(l_quantity) AS tokens, round(avg(l_extendedprice), 4) AS mean_latency, max(l_extendedprice) AS max_latency FROM lineitem GROUP BY ALL")
def call_accounts(spark, sf_dir):
    return rules.call_accounts(Tables(spark, sf_dir).lineitem, ["l_suppkey", "l_returnflag"], "l_extendedprice", "l_quantity", F.col("l_linestatus") == "F")


@query("SELECT count(*) AS n, coalesce(sum(files), 0)::BIGINT AS whole, coalesce(sum(linked), 0)::BIGINT AS part, count(*) = 0 AS empty FROM (SELECT source, count(*) AS files, CASE WHEN count(*) % 2 = 0 THEN count(*) FILTER (WHERE n_chars > 900) END AS linked FROM documents GROUP BY source) WHERE linked IS NOT NULL")
def coverage_totals(spark, sf_dir):
    by = Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") > 900).alias("linked"))
    return rules.totals(by.withColumn("linked", F.when(F.col("files") % 2 == 0, F.col("linked"))), "files", "linked")


@query("""WITH e AS (SELECT p_brand AS a, n_name AS b FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
s AS (SELECT a AS area, CASE WHEN a = b THEN 'within' ELSE 'out' END AS way FROM e UNION ALL SELECT b, 'in' FROM e WHERE a <> b)
SELECT area, count(*) FILTER (WHERE way = 'in') AS n_in, count(*) FILTER (WHERE way = 'out') AS n_out, count(*) FILTER (WHERE way = 'within') AS n_within FROM s GROUP BY area""")
def area_relations(spark, sf_dir):
    d = Tables(spark, sf_dir)
    part = F.concat(F.lit("p:"), F.col("l_partkey").cast("string"))
    edges = d.lineitem.select(part.alias("src"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("dst"))
    area = d.part.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("area"))
    area = area.union(d.supplier.join(d.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")), "n_name"))
    return rules.area_relations(edges, area)


_IMPORTS = "i AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION SELECT s_suppkey, s_suppkey % 5 + 100 FROM supplier)"


@query(f"WITH {_IMPORTS} SELECT src, dst FROM i UNION SELECT i.src, j.dst FROM i JOIN i j ON i.dst = j.src WHERE i.dst % 2 = 0 AND i.src <> j.dst")
def reexports(spark, sf_dir):
    d = Tables(spark, sf_dir)
    imports = d.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).union(d.supplier.select("s_suppkey", F.col("s_suppkey") % 5 + 100))
    hubs = imports.select(F.col("dst").alias("node")).where("node % 2 = 0").distinct()
    return rules.through_hubs(imports, hubs)


@query("""WITH i AS (SELECT l_orderkey AS src, l_partkey AS dst, CASE WHEN l_linenumber = 1 THEN ['*'] ELSE [l_returnflag, l_linestatus] END AS names FROM lineitem), w AS (SELECT p_partkey AS dst, CASE WHEN p_size % 2 = 0 THEN 'R' ELSE 'O' END AS name FROM part)
SELECT DISTINCT src, i.dst, name FROM i JOIN w ON i.dst = w.dst WHERE list_contains(names, name) OR list_contains(names, '*')""")
def named_importers(spark, sf_dir):
    d = Tables(spark, sf_dir)
    names = F.when(F.col("l_linenumber") == 1, F.array(F.lit("*"))).otherwise(F.array("l_returnflag", "l_linestatus"))
    imports = d.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), names.alias("names"))
    return rules.named_importers(imports, d.part.select(F.col("p_partkey").alias("dst"), F.when(F.col("p_size") % 2 == 0, "R").otherwise("O").alias("name")))


@query("""WITH e AS (SELECT p_brand AS entity, bool_or(p_size > 48) AS hint FROM part GROUP BY p_brand UNION ALL SELECT 'MAX_SIZE', true UNION ALL SELECT 'max_size', false),
s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'MAX_SIZE' WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS name, CASE WHEN p_partkey % 18 = 0 THEN 'constant' ELSE 'class' END AS kind FROM part)
SELECT entity, name, id FROM e JOIN s ON lower(entity) = lower(name) WHERE (hint OR entity = name) AND (NOT regexp_matches(entity, '^[A-Z][A-Z0-9_]*_[A-Z0-9_]*$') OR kind = 'constant')""")
def entity_symbols(spark, sf_dir):
    d = Tables(spark, sf_dir)
    k = F.col("p_partkey")
    more = spark.createDataFrame([("MAX_SIZE", True), ("max_size", False)], "entity string, hint boolean")
    entities = d.part.groupBy(F.col("p_brand").alias("entity")).agg(F.bool_or(F.col("p_size") > 48).alias("hint")).union(more)
    name = F.when(k % 9 == 0, "MAX_SIZE").when(k % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand"))
    return rules.entity_symbols(entities, d.part.select(k.alias("id"), name.alias("name"), F.when(k % 18 == 0, "constant").otherwise("class").alias("kind")))


@query("""WITH t AS (SELECT DISTINCT s_suppkey AS q, lower(w) AS term FROM supplier, (SELECT unnest(['promo', 'brass', 'small', 'steel', 'nothing']) AS w)), n AS (SELECT p_partkey AS id, unnest(string_split(lower(p_type), ' ')) AS term FROM part),
f AS (SELECT term, count(DISTINCT id) AS df FROM n GROUP BY term HAVING df <= (SELECT count(*) FROM part) // 4)
SELECT q, t.term, round(1 / log2(2 + df), 6) AS weight FROM (SELECT t.q, t.term, df, row_number() OVER (PARTITION BY q ORDER BY df, t.term) AS r FROM t JOIN f ON t.term = f.term) t WHERE r <= 2""")
def symbol_terms(spark, sf_dir):
    d = Tables(spark, sf_dir)
    terms = d.supplier.select(F.col("s_suppkey").alias("q"), F.explode(F.array(*map(F.lit, ["promo", "brass", "small", "steel", "nothing"]))).alias("term"))
    names = d.part.select(F.col("p_partkey").alias("id"), F.explode(F.split(F.lower("p_type"), " ")).alias("term"))
    return rules.rare_terms(terms, names, d.part.count() // 4, 2)


_W = "string_split(lower(p_type), ' ')"


@query(f"""WITH w AS (SELECT p_partkey, unnest({_W}) AS word FROM part), c AS (SELECT p_partkey, word, count(*) AS tf FROM w GROUP BY ALL),
r AS (SELECT p_partkey, ('0x' || substr(md5(word), 1, 6))::BIGINT % 256 AS dim, sum(CASE WHEN ('0x' || substr(md5(word), 7, 6))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(tf))) AS x FROM c GROUP BY ALL)
SELECT p_partkey, dim, value FROM (SELECT p_partkey, dim, round(x / norm, 5) AS value FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY p_partkey)) AS norm FROM r) WHERE norm > 0) WHERE abs(value) > 0""")
def hashed_vectors(spark, sf_dir):
    return rules.hashed_vector(Tables(spark, sf_dir).part, "p_partkey", F.split(F.lower("p_type"), " "))
