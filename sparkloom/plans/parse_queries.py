"""Queries for pages, outlines, JSON summaries, paths, versions and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as t
from .registry import Tables, query


def _plain_sql(x: str) -> str:
    for name, sign in markup.ENTITIES.items():
        quoted = sign.replace("'", "''")
        x = f"replace({x}, '{name}', '{quoted}')"
    return x


def _tidy_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g'), ' ' || chr(10))"


def _visible_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in markup.HIDDEN:
        x = rf"regexp_replace({x}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?(?:{markup.BLOCKS})(?:\s[^>]*)?/?>', chr(10), 'g')"
    return _tidy_sql(_plain_sql(f"regexp_replace({x}, '<[^>]+>', '', 'g')"))


@query(f"SELECT page_id, {_tidy_sql(_plain_sql(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)'])))} AS title, {_visible_sql('html')} AS text FROM pages")
def page_text(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", markup.html_title(F.col("html")).alias("title"), markup.visible_text(F.col("html")).alias("text"))


_HEADING = _tidy_sql(_plain_sql("regexp_replace(h, '<[^>]+>', '', 'g')"))


@query(rf"""SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<h[1-3](?:\s[^>]*)?>(.*?)</h[1-3]>', 1), lambda h: {_HEADING}) AS headings,
list_slice(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1), 1, 100) AS links FROM pages""")
def page_outline(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", markup.headings(F.col("html")).alias("headings"), markup.links(F.col("html")).alias("links"))


@query(r"""WITH r AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS rest FROM pages)
SELECT page_id, regexp_replace(lower(regexp_replace(regexp_extract(rest, '^([^/]*)', 1), ':[0-9]+$', '')) || regexp_extract(rest, '^[^/]*(.*)$', 1), '/+$', '') AS bare FROM r""")
def bare_urls(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", markup.bare_url(F.col("url")).alias("bare"))


@query("SELECT event_id, json_keys(props) AS keys, json_type(props) = 'OBJECT' AS is_object, length(props) AS n_chars FROM events")
def json_summary(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("event_id", F.json_object_keys("props").alias("keys"), F.json_object_keys("props").isNotNull().alias("is_object"), F.length("props").alias("n_chars"))


@query(r"""WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS start FROM documents),
h AS (SELECT doc_id, n, start, regexp_extract(line, '^([A-Z][a-z]+) ', 1) AS title FROM l WHERE regexp_matches(line, '^([A-Z][a-z]+) '))
SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, n) AS "end", title FROM h""")
def section_outline(spark, sf_dir):
    """Lines that begin with a capitalised word stand for headings."""
    return markup.outline(Tables(spark, sf_dir).documents, "doc_id", "text", "^([A-Z][a-z]+) ")


_PATHS = "SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'src/migrations/' WHEN 3 THEN 'conf/' ELSE 'src/' END || replace(lower(p_type), ' ', '/') || CASE p_size % 5 WHEN 0 THEN '_test.py' WHEN 1 THEN '.md' WHEN 2 THEN '.sql' WHEN 3 THEN '.yaml' ELSE '.py' END AS path FROM part"


def _paths(d):
    k = F.col("p_size")
    head = F.when(k % 7 == 0, "tests/").when(k % 7 == 1, "docs/").when(k % 7 == 2, "src/migrations/").when(k % 7 == 3, "conf/").otherwise("src/")
    tail = F.when(k % 5 == 0, "_test.py").when(k % 5 == 1, ".md").when(k % 5 == 2, ".sql").when(k % 5 == 3, ".yaml").otherwise(".py")
    return d.part.select("p_partkey", F.concat(head, F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), tail).alias("path"))


@query(rf"""SELECT p_partkey, path, CASE WHEN regexp_matches(path, '(^|/)tests?/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(spec|test)\.[a-z]+$') THEN 'test' WHEN regexp_matches(path, '(^|/)docs?/|\.(md|rst|txt)$') THEN 'doc'
WHEN regexp_matches(path, '(^|/)migrations?/|\.sql$') THEN 'migration' WHEN regexp_matches(path, '\.(ya?ml|toml|ini|json|cfg)$|(^|/)dockerfile$') THEN 'config' ELSE 'code' END AS kind,
regexp_matches(path, '(?i)^(.*/)?standard/.*/.*\.py$') AS in_glob FROM ({_PATHS})""")
def path_kinds(spark, sf_dir):
    return _paths(Tables(spark, sf_dir)).select("p_partkey", "path", t.path_kind(F.col("path")).alias("kind"), F.col("path").rlike(t.glob_regex("standard/*/*.py")).alias("in_glob"))


@query(rf"""WITH p AS (SELECT p_partkey, string_split(regexp_replace(path, '\.[A-Za-z]+$', ''), '/') AS w FROM ({_PATHS}))
SELECT p_partkey, list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_slice(w, i, len(w)), '.')) AS keys FROM p""")
def module_keys(spark, sf_dir):
    return _paths(Tables(spark, sf_dir)).select("p_partkey", t.suffix_keys(F.col("path")).alias("keys"))


@query("""SELECT p_brand, p_partkey, version FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY a DESC, b DESC, c DESC, p_partkey DESC) AS r FROM
(SELECT p_brand, p_partkey, p_size || '.' || p_partkey % 12 || '.' || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '4' END AS version, p_size AS a, p_partkey % 12 AS b, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 4 END AS c FROM part)) WHERE r = 1""")
def newest_versions(spark, sf_dir):
    """The newest version of each brand's parts, by numbers and not by letters; parts that are no numbers count as 0."""
    k = F.col("p_partkey")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (k % 12).cast("string"), F.when(k % 3 == 0, "x").otherwise("4"))
    rows = Tables(spark, sf_dir).part.select("p_brand", "p_partkey", version.alias("version"))
    best = F.max_by(F.struct("p_partkey", "version"), F.struct(t.version_key(F.col("version")), "p_partkey"))
    return rows.groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.*")


@query(r"""SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*'), lambda w: length(w) BETWEEN 3 AND 120))) AS names FROM documents""")
def identifiers(spark, sf_dir):
    """All identifiers of each text; sorted, as SQL doesn't keep their order."""
    return Tables(spark, sf_dir).documents.select("doc_id", F.array_sort(t.identifiers(F.col("text"), 1 << 30)).alias("names"))


@query(r"""WITH h AS (SELECT page_id, ltrim(substr(html, 1, 400)) AS s FROM pages UNION ALL SELECT -doc_id - 1, ltrim(substr(text, 1, 400)) FROM documents UNION ALL SELECT 1000000000 + event_id, ltrim(substr(props, 1, 400)) FROM events)
SELECT page_id, CASE WHEN starts_with(s, '<?xml') THEN 'xml' WHEN regexp_matches(s, '(?i)^<!doctype html') OR starts_with(s, '<') AND regexp_matches(s, '(?i)<(html|body|div|p|h1)\b') THEN 'html' WHEN regexp_matches(s, '^<[A-Za-z_][\w:.-]*[\s>/]') THEN 'xml' WHEN regexp_matches(s, '^[\[{]') THEN 'json' WHEN regexp_matches(s, '(?m)^#{1,6} ') THEN 'markdown' ELSE 'text' END AS format FROM h""")
def sniffed_formats(spark, sf_dir):
    d = Tables(spark, sf_dir)
    rows = d.pages.select("page_id", F.col("html").alias("s")).union(d.documents.select(-F.col("doc_id") - 1, "text")).union(d.events.select(F.col("event_id") + 1000000000, "props"))
    return rows.select("page_id", t.sniff_format(F.col("s")).alias("format"))
