"""Files in chunks, and what is found in them."""

import random
import re
import time

import pytest

from sparkloom.functions import outline as o
from sparkloom.functions import text as t
from sparkloom.operators import chunks as c
from sparkloom.operators import content
from pyspark.sql import functions as F


def marks(language, text):
    strengths, headings = o.outline(language, text.split("\n"))
    return list(zip(strengths, headings, strict=True))


def test_markdown_headings_fences_and_underlines():
    text = "# One #\nbody\n\n## Two\n```\n# not a heading\n```\n### Three\ntext\n\nFour\n====\nend"
    assert marks("markdown", text) == [
        (2, "One"), (0, "One"), (0, "One"), (2, "One > Two"), (0, "One > Two"), (0, "One > Two"), (0, "One > Two"), (1, "One > Two > Three"), (0, "One > Two > Three"),
        (0, "One > Two > Three"), (2, "Four"), (0, "Four"), (0, "Four"),
    ]


def test_keys_comments_and_sections():
    assert marks("yaml", "a: 1\n# about b\nb:\n  c: 2\n    d: 3\n- e: 4\n---\n\nx") == [(2, "a"), (2, "b"), (0, "b"), (1, "b > c"), (0, "b > c"), (0, "b > c"), (2, "b > c"), (0, "b > c"), (1, "b > c")]
    assert [m[1] for m in marks("toml", "# top\n[tool.x]\ny = 1\n[[z]]\n")] == ["tool.x", "tool.x", "tool.x", "z", "z"]
    assert marks("sql", "-- why\n-- more\nCREATE TABLE a (\n x int);\nselect 1")[0] == (2, "CREATE TABLE a (") and marks("sql", "x\nselect 1")[1] == (2, "select 1")
    assert [m[1] for m in marks("ini", "[a]\nx=1\n[b]")] == ["a", "a", "b"]
    assert [m for m in marks("dockerfile", "FROM x AS build\nRUN a \\\n  RUN b\nCOPY c d\nfrom y")] == [(2, "stage build"), (1, "stage build"), (0, "stage build"), (1, "stage build"), (2, "FROM y")]
    assert [m[1] for m in marks("makefile", ".PHONY: all\nall: b\n\tcc x\nb := 1")] == ["", "all", "all", "all"]
    assert [m[1] for m in marks("shell", "function go() {\n}\nrun () {\n}")] == ["go", "go", "run", "run"]
    assert [m[1] for m in marks("python", "def up():\n    op.execute('x')\nclass A:\n    pass")] == ["def up", "up: op.execute('x')", "def A", "def A"]
    assert marks(None, "a\n\nb") == [(0, ""), (0, ""), (1, "")]


def test_json_records_and_keys():
    assert [m[0] for m in marks("json", '[\n  {\n    "a": 1\n  },\n  {\n    "a": 2\n  }\n]')] == [0, 2, 0, 0, 2, 0, 0, 0]
    assert [m[1] for m in marks("json", '{\n  "a": {\n    "b": 1\n  },\n  "c": 2\n}')] == ["", "a", "a", "a", "c", "c"]


def test_elements():
    text = '<?xml version="1.0"?>\n<Project>\n  <!-- <hidden> -->\n  <ItemGroup>\n    <Ref Include="Log" />\n    <deep><er><thing name="x"/></er></deep>\n  </ItemGroup>\n</Project>'
    assert [m[1] for m in marks("xml", text)] == ["", "Project", "Project", "Project > ItemGroup", 'Project > ItemGroup > Ref Include="Log"', "Project > ItemGroup > deep", "Project > ItemGroup > deep", "Project > ItemGroup > deep"]
    assert list(o.tags("a < b <c d='1'>e</c> <f")) == [(6, False, "c", " d='1'"), (16, True, "c", "")]


@pytest.mark.parametrize("text", ["<" * 200_000, "<a " * 100_000, "<!--" * 100_000, "<![CDATA[" * 50_000, "<a b='" * 50_000, "# " + "x # " * 100_000, "k" * 300_000 + ":", "=" * 300_000, "http" * 60_000, "a." * 150_000])
def test_long_odd_lines_take_no_time(spark, text):
    began = time.perf_counter()
    for language in o.FORMATS:
        o.outline(language, ["x", text, ""])
    assert time.perf_counter() - began < 8
    began = time.perf_counter()
    spark.createDataFrame([(text,)], "t string").select(t.redact(F.col("t")), F.size(t.tokens(F.col("t"))), F.size(t.names(F.col("t")))).collect()
    assert time.perf_counter() - began < 20


def plain_seams(sizes, strengths):
    """The rule as written, each chunk from scratch."""
    out, start = [], 0
    while start < len(sizes):
        end = start + 1
        while end < len(sizes):
            n, chars = end - start, sum(sizes[start:end]) + end - start
            if (strengths[end] == 2 and (n >= 8 or chars >= 400)) or (strengths[end] >= 1 and (n >= 40 or chars >= 1500)):
                break
            if n >= 60 or chars + sizes[end] + 1 > 2000:
                soft = [k for k in range(start + 1, end) if strengths[k] >= 1]
                if soft and soft[-1] - start >= max(1, n // 2):
                    end = soft[-1]
                break
            end += 1
        out.append((start, end))
        start = end
    return out


def test_seams_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(150)
        sizes = [rng.choice([0, 5, 30, 80, 400, 2000]) for _ in range(n)]
        strengths = [rng.choice([0] * rng.randrange(1, 12) + [1, 2]) for _ in range(n)]
        assert list(c.seams(sizes, strengths)) == plain_seams(sizes, strengths)


def test_chunks_rebuild_their_texts(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        lines = [rng.choice(["", "   ", "# head", "## sub", "word " * rng.randrange(30), "key: value", "x" * rng.randrange(50)]) for _ in range(rng.randrange(200))]
        rows.append((f"f{k}", rng.choice([*o.FORMATS, None, "odd"]), "\n".join(lines)))
    rows += [("null", "text", None), ("empty", "text", ""), ("blank", "text", " \n\n"), ("endless", "text", "ab cd " * 40_000), ("unbroken", None, "x" * 50_000), ("twice", "text", "a"), ("twice", "text", "a")]
    files = spark.createDataFrame([(*r, "z") for r in rows], "path string, language string, text string, ordinal string").repartition(3)
    got = {}
    for r in c.file_chunks(files).collect():
        got.setdefault(r["path"], []).append(r)
    assert not {"null", "empty", "blank"} & set(got) and len(got["twice"]) == 2
    for path, _, text in rows:
        if path == "twice" or path not in got:
            continue
        own = sorted(got[path], key=lambda r: r["ordinal"])
        lines = [line.rstrip() for line in text.split("\n")]
        assert [r["ordinal"] for r in own] == list(range(len(own)))
        assert all(len(r["text"]) <= 2000 and r["text"].count("\n") < 60 for r in own)
        if path in ("endless", "unbroken"):
            assert "".join(r["text"] for r in own) == text.rstrip() and {r["end_line"] for r in own} == {1}
            continue
        for r in own:
            assert r["text"] == "\n".join(lines[r["start_line"] - 1 : r["end_line"]])
        held = {i for r in own for i in range(r["start_line"], r["end_line"] + 1)}
        assert held >= {i + 1 for i, line in enumerate(lines) if line} and sum(r["end_line"] - r["start_line"] + 1 for r in own) == len(held)
    assert c.file_chunks(files.limit(0)).count() == 0


def test_stubs_and_secrets(spark):
    files = spark.createDataFrame([("a", "text", "one\n" * 30), ("b", "text", "password = hunter2 and\nhttps://u:p@host/x"), ("c", "text", "y" * 900)], "path string, language string, text string")
    got = {r["path"]: r for r in c.file_chunks(files, stub_chars=100, stub_line=500).collect()}
    assert got["a"]["status"] == "stub" and got["a"]["end_line"] == 12 and got["c"]["text"] == "y" * 200
    assert got["b"]["status"] == "chunked" and got["b"]["text"] == "password = *** and\nhttps://***@host/x"


def test_names(spark):
    text = "see pyproject.toml, shop.retention and uq_run_seq; a.b Retry.Policy.py"
    got = spark.createDataFrame([(text,)], "t string").select(t.names(F.col("t"))).first()[0]
    assert got == ["see", "pyproject", "shop.retention", "shop", "retention", "and", "uq_run_seq", "a.b", "Retry.Policy", "Retry", "Policy"]


def test_search_by_heading_path_and_name(spark):
    chunks = spark.createDataFrame(
        [("docs/a.md", 0, "Retention", "how long events are kept"), ("docs/a.md", 1, "", "retention again, run_seq"), ("docs/retention.md", 0, "", "nothing of it"), ("docs/adr-7-x.md", 0, "", "other words here"), *[(f"n{k}", 0, "", "common words of no use") for k in range(9)]],
        "path string, ordinal int, heading string, text string",
    ).withColumn("names", t.names(F.col("text")))
    questions = spark.createDataFrame([(1, "what is the retention of events"), (2, "where is run_seq"), (3, "common words"), (4, ""), (5, "what says ADR 7")], "q int, text string")
    hits = {(r["q"], r["path"]): r for r in content.content_search(chunks, questions).collect()}
    assert hits[1, "docs/a.md"]["ordinal"] == 0 and hits[1, "docs/a.md"]["matches"] == 2 and (1, "docs/retention.md") in hits
    assert hits[2, "docs/a.md"]["ordinal"] == 1 and not [k for k in hits if k[0] == 4]
    found = {(r["q"], r["path"]): r["score"] for r in content.content_retriever(chunks, questions).collect()}
    assert found[5, "docs/adr-7-x.md"] == content.NUMBERED + 1 and found[1, "docs/retention.md"] > hits[1, "docs/retention.md"]["score"] / hits[1, "docs/a.md"]["score"]
    assert content.content_search(chunks.limit(0), questions).count() == 0 and content.content_retriever(chunks, questions.limit(0)).count() == 0


def test_dotted_names_against_a_pattern(spark):
    import re

    rng = random.Random(9)
    texts = ["".join(rng.choice("aB_1.. -é") for _ in range(rng.randrange(40))) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(t.dotted(F.col("t"))).collect()]
    assert got == [re.findall(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*", x) for x in texts]


def brute_covers(title, body, clauses):
    """Minimal stretches by trying all of them; clauses: (wanted words, barred words), each a list of phrases as lists."""
    import re

    toks = re.findall("[a-z0-9]+", title.lower())
    n_title = len(toks)
    toks += re.findall("[a-z0-9]+", body.lower())

    def runs(phrase):
        return [(i, i + len(phrase) - 1) for i in range(len(toks) - len(phrase) + 1) if toks[i : i + len(phrase)] == phrase]

    good = [(pos, neg) for pos, neg in clauses if pos and all(runs(p) for p in pos) and not any(runs(p) for p in neg)]
    if not good:
        return None

    def satisfied(s, e):
        return any(all(any(s <= a and b <= e for a, b in runs(p)) for p in pos) for pos, _ in good)

    found = [(s, e) for s in range(len(toks)) for e in range(s, len(toks)) if satisfied(s, e) and not (s < e and (satisfied(s + 1, e) or satisfied(s, e - 1)))]
    at = {k for pos, _ in good for p in pos for a, b in runs(p) for k in range(a, b + 1)}
    score = 0.0
    for s, e in found:
        own = [k for k in at if s <= k <= e]
        score += len(own) / sum(1 / (1.0 if k < n_title else 0.1) for k in own) / (1 + (e - s) - (len(own) - 1))
    best = min(e - s for s, e in found)
    return len(found), best, round(score, 6)


def test_covers_against_all_stretches(spark):
    from sparkloom.operators import covers

    rng = random.Random(6)
    words = ["fox", "dog", "cat", "owl", "pig", "hen"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4))), " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(40)] + [(100, None, None), (101, "", "")]
    asked = {
        1: ("fox", [([["fox"]], [])]), 2: ("fox dog", [([["fox"], ["dog"]], [])]), 3: ("fox or dog cat", [([["fox"]], []), ([["dog"], ["cat"]], [])]),
        4: ('"owl pig" -hen', [([["owl", "pig"]], [["hen"]])]), 5: ('cat dog owl OR "hen pig"', [([["cat"], ["dog"], ["owl"]], []), ([["hen", "pig"]], [])]), 6: ("the -fox", []), 7: ("", []),
        8: ('owl-pig or -"fox dog" cat', [([["owl", "pig"]], []), ([["cat"]], [["fox", "dog"]])]), 9: ("or fox or", [([["fox"]], [])]), 10: ('fox dog or dog', [([["fox"], ["dog"]], []), ([["dog"]], [])]), 11: ('"owl pig" hen or pig cat', [([["owl", "pig"], ["hen"]], []), ([["pig"], ["cat"]], [])]),
    }
    queries = spark.createDataFrame([(q, x) for q, (x, _) in asked.items()], "q long, text string")
    got = {(r["q"], r["doc"]): (r["n_covers"], r["last"] - r["first"], r["score"]) for r in covers.cover_search(spark.createDataFrame(docs, "doc long, title string, body string"), queries).collect()}
    want = {(q, i): x for q, (_, clauses) in asked.items() for i, title, body in docs if (x := brute_covers(title or "", body or "", clauses))}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_paths_are_stemmed_once_and_not_for_each_question(spark):
    from sparkloom.functions import text as t

    names = ["docs/source_web/adr-7.md", "docs/sources/adr-17.md", "src/renderers/tables.py", "decisions/0017-caching.md", "caches/17-x.md", "a/cach.py"]
    paths = spark.createDataFrame([(p,) for p in names], "path string")
    asked = [(1, "caching of the renderer, see ADR 17"), (2, "sources"), (3, "renders tables"), (4, None)]
    questions = spark.createDataFrame(asked, "q long, text string")
    hits = content.path_hits(paths, questions)
    # words of paths and stems of questions meet as rows: no lambda runs over both for each pair
    assert "exists(" not in hits._jdf.queryExecution().optimizedPlan().toString()
    stems = F.col("stems")
    words = t.tokens(F.translate("path", "/.-", "   "))
    pairs = paths.crossJoin(questions.select("q", t.query_terms(F.col("text"), 24).alias("stems")).where(stems.isNotNull()))
    want = {(r["q"], r["path"]): r["terms"] for r in pairs.select("q", "path", t.covered_terms(stems, words).alias("terms")).collect()}
    got = hits.collect()
    assert all(want[r["q"], r["path"]] == r["terms"] for r in got)
    assert {(r["q"], r["path"], r["numbered"]) for r in got} == {
        (1, "docs/sources/adr-17.md", 1), (1, "decisions/0017-caching.md", 1), (1, "caches/17-x.md", 1), (1, "a/cach.py", 0), (1, "src/renderers/tables.py", 0),
        (2, "docs/source_web/adr-7.md", 0), (2, "docs/sources/adr-17.md", 0), (3, "src/renderers/tables.py", 0),
    }


def test_long_titles_are_counted_once_and_not_for_every_word(spark):
    from sparkloom.operators import covers

    docs = spark.createDataFrame([(1, "kappa lambda " * 30_000, "sigma"), (2, "sigma", "lambda")], "doc long, title string, body string")
    queries = spark.createDataFrame([(1, "sigma"), (2, '"lambda sigma" -kappa or "kappa lambda" sigma')], "q long, text string")
    began = time.perf_counter()
    got = sorted((r["q"], r["doc"], r["n_covers"], r["first"], r["last"]) for r in covers.cover_search(docs, queries).collect())
    assert got == [(1, 1, 1, 60_000, 60_000), (1, 2, 1, 0, 0), (2, 1, 1, 59_998, 60_000)]
    assert time.perf_counter() - began < 30


def test_words_of_a_field_become_rows_once_and_are_stemmed_once(spark):
    chunks = spark.createDataFrame([("docs/sets.md", 0, "set Sets", "set setting sets " * 1000), ("b", 1, None, None), ("b", 1, "set", "words"), ("b", 1, "", "sets")], "path string, ordinal int, heading string, text string")
    terms = spark.createDataFrame([("sets",), ("sett",), ("word",)], "term string")
    postings = content.field_postings(chunks, terms)
    assert sorted(map(tuple, postings.collect())) == [("b", 1, "sets", False, False), ("b", 1, "word", False, False), ("docs/sets.md", 0, "sets", True, True), ("docs/sets.md", 0, "sett", False, False)]
    # different words are taken out of each field before any becomes a row, and none is stemmed a second time to see that its stem isn't null
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") >= 3 and plan.count("ility") == 1
    assert t.of_stems(chunks.select(F.col("text").alias("w")), "w", terms.limit(0)).count() == 0


def test_names_of_runs_that_come_again_are_taken_once(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice(["aB", "_", "1", ".", "..", " ", "-", "é", "x.py", ".md", "abc ", "k.lmn"]) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "1.a", "a" * 121 + ".b", "abc " * 500 + "d.efg"]
    endings = re.compile(rf"(?i)\.(?:{'|'.join(t.FILE_ENDINGS)})$")

    def plain(text):
        found = [endings.sub("", w) for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*", text)]
        return list(dict.fromkeys(p for w in found for p in [*([w] if "." in w else []), *w.split(".")] if len(p) <= 120 and (len(p) >= 3 or "." in p)))[:300]

    names = spark.createDataFrame([(x,) for x in texts], "t string").select("t", t.names(F.col("t")).alias("n"))
    assert all(r["n"] == (None if r["t"] is None else plain(r["t"])) for r in names.collect())
    # runs are made distinct before names are taken out of them, not only after
    assert names._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 2


def test_chunks_are_cut_once_for_a_search(spark, monkeypatch):
    from sparkloom.operators import chunks
    from sparkloom.plans import content_queries

    given = []
    monkeypatch.setattr(content_queries.content, "content_search", lambda cut, questions: given.append(cut) or cut)
    content_queries.chunk_search(spark, "/root/testdata/sf0.001")
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and given[0].count() == chunks.file_chunks(content_queries.files(content_queries.Tables(spark, "/root/testdata/sf0.001"))).count()
