"""Files of several formats, made by Spark from the tables: what indexing and extraction queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables


def _file(path, language: str, text) -> list:
    return [path.alias("path"), F.lit(language).alias("language"), text.alias("text")]


def files(d: Tables) -> DataFrame:
    """path, language, text: documents as Markdown, pages as XML, a customer with its orders as YAML, parts as SQL, suppliers as TOML."""
    docs = d.documents.select(*_file(F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id"), F.lit(".md")), "markdown", F.col("text")))
    pages = d.pages.select(*_file(F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".xml")), "xml", F.col("html")))
    entry = F.format_string("  o%d:\n    status: %s\n    total: %.2f\n    priority: %s", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    entries = d.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("entries"))
    card = F.format_string("customer: %s\nsegment: %s\n# what was ordered\norders:\n%s", "c_name", "c_mktsegment", F.coalesce("entries", F.lit("")))
    customers = d.customer.join(entries, "c_custkey", "left").select(*_file(F.format_string("customers/%d.yaml", "c_custkey"), "yaml", card))
    row = F.format_string("-- one part\nINSERT INTO part (p_partkey, p_name, p_size)\nVALUES (%d, '%s', %d);\n\nUPDATE part SET p_retailprice = %.2f\nWHERE p_partkey = %d;", "p_partkey", "p_name", "p_size", "p_retailprice", "p_partkey")
    parts = d.part.select(*_file(F.format_string("parts/%d.sql", "p_partkey"), "sql", row))
    table = F.format_string("# a supplier\n[supplier]\nname = \"%s\"\n\n[supplier.account]\nbalance = %.2f", "s_name", "s_acctbal")
    suppliers = d.supplier.select(*_file(F.format_string("suppliers/%d.toml", "s_suppkey"), "toml", table))
    return docs.unionByName(pages).unionByName(customers).unionByName(parts).unionByName(suppliers)
