"""Text functions as Column expressions: everything runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: stop words of the term selector
STOP_WORDS = """
a an the and or but if then else of to in on at by for from with without into over under is are was were be been being do
does did doing have has had it its this that these those as not no yes how what when where which who whom why can could
should would will shall may might must about after before between through during above below up down out off again further
once here there all any both each few more most other some such only own same so than too very just i you he she we they me
him her us them my your our their
""".split()

# fixed values: filler words that say nothing about a task
FILLER_WORDS = """
add adds added adding new update updates updated want wants need needs needed make makes made sure code codes default defaults
work works working use uses used using thing things way ways change changes changed changing touch touches look looks find
finds show shows get gets keep keeps let lets like also still even really actually already something anything everything
instead rather without whether happen happens happening behave behaves behaviour behavior break breaks broken else file files
function functions class classes method methods line lines name names type types value values case cases part parts kind
kinds step steps point plain simple basic just long time times one two three four five single every test tests tested testing
spec specs cover covers covered covering coverage
""".split()

# fixed values: suffixes of the light stemmer, in the order they are tried
SUFFIXES = "ility ation ement ments ings ions able ible ment ness ing ion ers ies ied ify ity ed er es ly s".split()
MIN_STEM = 4

# fixed value: where a word of several humps is split
_CAMEL = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


_HUMPED = "[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def tokens(text: Column) -> Column:
    """Identifier-aware tokens, lower-cased: words of ASCII letters and digits, ``_`` separating; a word of several humps gives itself, then its humps."""

    def humps(word: Column) -> Column:
        # a word of both cases is split, any other is itself; a lambda has no common subexpressions, so the split stands in it once
        return F.when(word.rlike(_HUMPED), F.array_insert(F.split(F.lower(F.regexp_replace(word, _CAMEL, "_")), "_"), 1, F.lower(word))).otherwise(F.array(F.lower(word)))

    return F.flatten(F.transform(F.regexp_extract_all(F.translate(text, "_", " "), F.lit("[A-Za-z0-9]+"), F.lit(0)), humps))


def significant_terms(text: Column, limit: int = 12) -> Column:
    """The first distinct tokens of three letters or more that are neither stop words nor numbers."""
    stop = strings(STOP_WORDS)
    kept = F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(kept), 1, limit)


def or_query(text: Column, limit: int = 12) -> Column:
    terms = significant_terms(text, limit)
    return F.when(F.size(terms) > 0, F.array_join(terms, " or ")).otherwise(text)


def stem(word: Column) -> Column:
    """Without the first suffix in the list that fits and leaves MIN_STEM letters."""
    w, out = F.lower(word), None
    for s in SUFFIXES:
        fits = w.endswith(s) & (F.length(w) - len(s) >= MIN_STEM)
        cut = F.substring(w, F.lit(1), F.length(w) - len(s))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(w)


def of_stems(rows: DataFrame, word: str, terms: DataFrame) -> DataFrame:
    """The rows whose lower-case ``word`` has a stem in ``terms`` (term), with it as ``term``.

    A stem keeps a word's first MIN_STEM letters, so most words are told apart by them and never stemmed.
    """
    wanted = terms.select("term").distinct()
    start = F.substring(word, 1, MIN_STEM)
    likely = rows.join(wanted.select(F.substring("term", 1, MIN_STEM).alias("start")).distinct(), start == F.col("start"), "left_semi")
    # of a word that may be null Spark would first ask whether its stem is null, and so stem it twice
    return likely.withColumn("term", stem(F.coalesce(F.col(word), F.lit("")))).join(wanted, "term", "left_semi")


def stems_match(a: Column, b: Column) -> Column:
    """Equal, or a shared start of MIN_STEM letters or more that lacks one letter of the shorter at most."""
    n = F.greatest(F.lit(MIN_STEM), F.least(F.length(a), F.length(b)) - 1)
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= MIN_STEM) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))


def query_terms(text: Column, limit: int = 16) -> Column:
    """Distinct stems of the significant terms without filler and short words."""
    filler = strings(FILLER_WORDS)
    terms = F.filter(significant_terms(text, 3 * limit), lambda t: (F.length(t) >= MIN_STEM) & ~F.array_contains(filler, t) & ~F.array_contains(filler, stem(t)))
    return F.slice(F.array_distinct(F.transform(terms, stem)), 1, limit)


def covered_terms(terms: Column, words: Column) -> Column:
    """The stems in ``terms`` that match the stem of some word."""
    return F.filter(terms, lambda t: F.exists(words, lambda w: stems_match(t, stem(w))))


def shingles(words: Column, n: int = 3) -> Column:
    """Distinct runs of n words; fewer words are one run, no words none."""
    # zipped with its own shifts: a lambda that slices ``words`` would evaluate them anew for each run
    runs = words
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(words, F.lit(k + 1), F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y))
    runs = F.slice(runs, F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0)))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def run_hashes(words: Column, n: int = 3) -> Column:
    """What ``shingles`` gives as 64-bit hashes, sorted, from hashes of the words: no run is written out as text."""
    runs = words
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(words, F.lit(k + 1), F.size(words)), lambda x, y: F.xxhash64(x, y))
    runs = F.slice(runs, F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0)))
    short = F.aggregate(F.slice(words, F.lit(2), F.size(words)), F.get(words, F.lit(0)), lambda x, y: F.xxhash64(x, y))
    return F.when(F.size(words) >= n, F.sort_array(F.array_distinct(runs))).when(F.size(words) > 0, F.array(short)).otherwise(F.array().cast("array<bigint>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def digest(text: Column) -> Column:
    """sha256 of the tokens joined by blanks: equal for texts that differ in case and punctuation only."""
    return F.sha2(F.array_join(tokens(text), " "), 256)


def normal(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+", " "))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def dotted(text: Column) -> Column:
    """Every run of names joined by dots, in order: a name is a letter or underscore and letters, digits and underscores.

    Dots that join no names are cut out first, as a pattern that repeats a group would recurse once a name.
    """
    return _dotted(_runs(text))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_.]+"), F.lit(0))


def _dotted(runs: Column) -> Column:
    """The names in runs of letters, digits, ``_`` and dots; most runs have no dot and aren't looked into."""
    parted = F.flatten(F.transform(runs, lambda w: F.when(w.contains("."), F.split(F.regexp_replace(w, "\\.(?![A-Za-z_])|(?<![A-Za-z0-9_])\\.", " "), " ")).otherwise(F.array(w))))
    # digits and dots, and nothing, come before all letters and ``_``
    return F.filter(F.transform(parted, lambda w: F.when(w < "A", F.regexp_replace(w, "^[0-9.]+", "")).otherwise(w)), lambda w: w != "")


def identifiers(text: Column, most: int = 300) -> Column:
    """Distinct words and dotted names of 3 to 120 characters, case kept."""
    found = dotted(text)
    return F.slice(F.array_distinct(F.filter(found, lambda w: F.length(w).between(3, 120))), 1, most)


# fixed values: endings of file names, which are no part of a dotted name
FILE_ENDINGS = "py md yaml yml json toml sql ts tsx js jsx sh txt lock cfg ini env html css csv xml".split()


def names(text: Column, most: int = 300) -> Column:
    """Distinct dotted names of up to 120 characters, without a file's ending, and their parts of 3 to 120, in order of appearance."""
    # a run that comes again has no new names, and one without a dot is one name
    ending = f"(?i)\\.(?:{'|'.join(FILE_ENDINGS)})$"
    bare = F.transform(_dotted(F.array_distinct(_runs(text))), lambda w: F.when(w.contains("."), F.regexp_replace(w, ending, "")).otherwise(w))
    of = lambda w: F.when(w.contains("."), F.concat(F.array(w), F.split(w, "\\."))).otherwise(F.array(w))
    each = F.transform(bare, lambda w: F.filter(of(w), lambda p: (F.length(p) <= 120) & ((F.length(p) >= 3) | p.contains("."))))
    return F.slice(F.array_distinct(F.flatten(each)), 1, most)


def document_numbers(text: Column, most: int = 4) -> Column:
    """Numbers that follow ADR, RFC or decision."""
    found = F.regexp_extract_all(text, F.lit("(?i)\\b(?:adr|rfc|decision)[ #-]*0*([0-9]+)"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, most)


def redact(text: Column) -> Column:
    """Credentials in URLs and values assigned to secret names become ***."""
    # a scheme begins where no letter or sign of one stands before, so that a long word is tried once and not from each letter
    masked = F.regexp_replace(text, "(?i)(?<![a-z0-9+.-])(?=[0-9+.-]*+[a-z])([a-z0-9+.-]++://)[^/\\s:@]++:[^/\\s@]++@", "$1***@")
    # most texts hold no URL and aren't searched for one
    urls = F.when(text.contains("://"), masked).otherwise(text)
    return F.regexp_replace(urls, "(?i)((?:password|passwd|secret|token|api_?key)\\s*[=:]\\s*)[^\\s,;]+", "$1***")


def sniff_format(text: Column) -> Column:
    """xml, html, json, markdown or text, by how a text starts."""
    head = F.ltrim(F.substring(text, 1, 400))
    return (
        F.when(head.startswith("<?xml"), "xml").when(head.rlike("(?i)^<!doctype html") | (head.startswith("<") & head.rlike("(?i)<(html|body|div|p|h1)\\b")), "html").when(head.rlike("^<[A-Za-z_][\\w:.-]*[\\s>/]"), "xml").when(head.rlike("^[\\[{]"), "json").when(head.rlike("(?m)^#{1,6} "), "markdown").otherwise("text")
    )


def path_kind(path: Column) -> Column:
    """test, doc, migration, config or code, by path."""
    p = F.lower(path)
    return (
        F.when(p.rlike("(^|/)tests?/|(^|/)test_[^/]*$|_test\\.[a-z]+$|\\.(spec|test)\\.[a-z]+$"), "test").when(p.rlike("(^|/)docs?/|\\.(md|rst|txt)$"), "doc").when(p.rlike("(^|/)migrations?/|\\.sql$"), "migration")
        .when(p.rlike("\\.(ya?ml|toml|ini|json|cfg)$|(^|/)dockerfile$"), "config").otherwise("code")
    )


def glob_regex(pattern: str) -> str:
    """A case-insensitive regex for a path glob; without a leading * or / it may match at any depth."""
    import re

    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?i)^{body if pattern[:1] in '*/' else '(.*/)?' + body}$"


def version_key(version: Column) -> Column:
    """Numbers of a dotted version as an array that compares in order; other parts count as 0."""
    return F.transform(F.split(version, "\\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def suffix_keys(path: Column) -> Column:
    """a/b/c.py -> a.b.c, b.c, c."""
    parts = F.split(F.regexp_replace(path, "\\.[A-Za-z]+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
