"""Pages, Markdown and JSON as Column expressions: titles, visible text, headings, links, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: elements whose content nobody sees, elements that break a line, and the entities that are read
HIDDEN = ["script", "style", "noscript", "template", "svg", "head"]
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _plain(text: Column) -> Column:
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _tidy(text: Column) -> Column:
    """Blanks collapsed in each line, empty lines gone."""
    text = F.regexp_replace(text, "[ \\t\\r\\f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, " ?\\n ?", "\n"), "\\n+", "\n"), F.lit(" \n"))


def html_title(html: Column) -> Column:
    return _tidy(_plain(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def visible_text(html: Column) -> Column:
    """What a reader sees: without comments, hidden elements and tags, a line for each block."""
    text = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in HIDDEN:
        text = F.regexp_replace(text, f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>", " ")
    text = F.regexp_replace(text, f"(?i)</?(?:{BLOCKS})(?:\\s[^>]*)?/?>", "\n")
    return _tidy(_plain(F.regexp_replace(text, "<[^>]+>", "")))


def headings(html: Column) -> Column:
    """Texts of h1 to h3 in their order."""
    found = F.regexp_extract_all(html, F.lit("(?is)<h[1-3](?:\\s[^>]*)?>(.*?)</h[1-3]>"), F.lit(1))
    return F.transform(found, lambda h: _tidy(_plain(F.regexp_replace(h, "<[^>]+>", ""))))


def links(html: Column, most: int = 100) -> Column:
    """Targets of links, in order, the first ``most``."""
    return F.slice(F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href=\"([^\"]*)\""), F.lit(1)), 1, most)


def bare_url(url: Column) -> Column:
    """Lower-case host and path, without scheme, port, query, fragment and last slash."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")
    return F.regexp_replace(F.concat(F.lower(F.regexp_replace(F.regexp_extract(rest, "^([^/]*)", 1), ":[0-9]+$", "")), F.regexp_extract(rest, "^[^/]*(.*)$", 1)), "/+$", "")


def outline(texts: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """id, start, end, title: sections of each text, from a line that fits ``pattern`` (its first group is the title) to the line
    before the next; lines count from 1."""
    lines = texts.select(id_col, F.size(F.split(text_col, "\n")).alias("n"), F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    heads = lines.where(F.col("line").rlike(pattern)).select(id_col, "n", (F.col("at") + 1).alias("start"), F.regexp_extract("line", pattern, 1).alias("title"))
    after = F.lead("start").over(Window.partitionBy(id_col).orderBy("start"))
    return heads.select(id_col, "start", F.coalesce(after - 1, F.col("n")).alias("end"), "title")
