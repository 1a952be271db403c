"""Every query against its SQL on DuckDB, or against brute force where SQL has none."""

import hashlib
import math
import os
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators import graph, resolution, retrieval, search, tables
from sparkloom.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(_plain(r[k]) for k in order) for r in rows])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, want.fetchall())
    assert got or name in ("over_budget", "relative_floor")


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("lang").alias("subject"))
    sets = [(r[0], r[1], set(r[2])) for r in docs.select("doc_id", "subject", t.shingles(t.tokens(F.col("text")))).collect()]
    want = set()
    for i, (a, sa, x) in enumerate(sets):
        for b, sb, y in sets[i + 1 :]:
            if sa == sb and x and y and round(len(x & y) / len(x | y), 6) >= 0.85:
                want.add((min(a, b), max(a, b)))
    members, pairs = search.copy_classes(docs)
    classes = defaultdict(list)
    for r in members.collect():
        classes[r["rep"]].append(r["doc"])
    linked = [(r["a"], r["b"]) for r in pairs.collect()]
    met = {(x, y) for a, b in linked + [(a, a) for a in classes] for x in classes[a] for y in classes[b]}
    assert {(x, y) if x < y else (y, x) for x, y in met if x != y} == want
    stars = {(rep, doc) for rep, docs in classes.items() for doc in docs if doc != rep}
    assert {(r["a"], r["b"]) for r in search.near_copies(docs).collect()} == {*linked} | stars


def test_text_measures_of_all_languages_against_brute_force(spark, tmp_path):
    def brute(text):
        if text is None:
            return 1, None
        normal = re.sub("[ \\t\\n\\x0b\\f\\r]+", " ", text.lower()).strip(" ")
        return max(1, -(-len(text) // 4)), hashlib.sha256(normal.encode()).hexdigest()

    more = [(-1, "  ÄÖÜ\t straße\n", "de"), (-2, "ÇA VA\u00a0BIEN ", "fr"), (-3, "漢字 🙂", None), (-4, "", "es"), (-5, None, None), (-6, None, "en")]
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    assert len({r["lang"] for r in rows}) > 4
    want = sorted((r["doc_id"], *brute(r["text"])) for r in rows)
    assert sorted(map(tuple, QUERIES["text_measures_all"](spark, str(tmp_path)).collect())) == want


def test_pack_against_brute_force(spark):
    items = [(q, d, float(10 - d), 300 * (d % 4 + 1)) for q in range(3) for d in range(q, 10)]
    df = spark.createDataFrame(items, "q int, doc long, score double, cost long")
    want = {}
    for q in range(3):
        used, docs = 0, []
        for _, d, _, c in sorted((i for i in items if i[0] == q), key=lambda i: (-i[2], i[1])):
            if used + c <= 2000 and len(docs) < 3:
                used, docs = used + c, [*docs, d]
        want[q] = (used, docs)
    assert {r["q"]: (r["used"], r["docs"]) for r in search.pack(df, "q", 2000, 3).collect()} == want


def test_strongest_links_against_brute_force(spark):
    links = [(a, b, (a * 7 + b * 13) % 11) for a in range(6) for b in range(a + 1, 6)]
    uses, want = defaultdict(int), []
    for a, b, w in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        if uses[a] < 2 and uses[b] < 2 and len(want) < 14:
            want.append((str(a), str(b), w))
            uses[a] += 1
            uses[b] += 1
    got = graph.strongest_links(spark.createDataFrame(links, "a int, b int, weight long")).collect()
    assert [tuple(r) for r in got] == want


def test_signature_reacts_to_changes_only(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("s"))
    sign = lambda x: tables.signature(x, ["id", "s"]).first()[0]
    assert sign(df) == sign(df.orderBy(F.desc("id"))) != sign(df.where("id <> 3"))


def test_calls_resolve_to_the_nearest_symbol(spark):
    calls = spark.createDataFrame([("f", "a.py", "x"), ("f", "a.py", "y"), ("f", "a.py", "z"), ("f", "a.py", "none")], "src string, file string, name string")
    symbols = spark.createDataFrame([("x", "a.py", "a::x"), ("x", "b.py", "b::x"), ("y", "b.py", "b::y"), ("z", "c.py", "c::z")], "name string, file string, symbol string")
    imports = spark.createDataFrame([("a.py", "b.py")], "file string, imported string")
    got = {r["dst"]: r["confidence"] for r in resolution.resolve_calls(calls, symbols, imports).collect()}
    assert got == {"a::x": 0.95, "b::y": 0.8, "c::z": 0.3, "callee:none": 0.2}


def test_text_helpers(spark):
    df = spark.createDataFrame([("see ADR-012 and rfc 7", "tests/test_a.py", "1.10.2", "<?xml?>")], "a string, p string, v string, x string")
    r = df.select(t.document_numbers(F.col("a")).alias("n"), t.path_kind(F.col("p")).alias("k"), t.version_key(F.col("v")).alias("v"), t.sniff_format(F.col("x")).alias("x"), t.suffix_keys(F.col("p")).alias("s")).first()
    assert (r["n"], r["k"], r["v"], r["x"], r["s"]) == (["12", "7"], "test", [1, 10, 2], "xml", ["tests.test_a", "test_a"])


def test_copies_are_marked_best_first(spark):
    long = " ".join(f"w{k}" for k in range(40))
    texts = {"a": (long, "x"), "b": (long.upper() + ".", "y"), "c": (long + " more", "x"), "d": (long + " more", "y"), "e": ("", None), "f": ("", None), "g": (None, None), "h": ("other words here now", None), "i": ("Other words, here now!", None)}
    fused = [(q, doc, float((k * 5 + q) % 9)) for q in (1, 2, 3) for k, doc in enumerate(texts) if (k + q) % 4]
    tokens = lambda s: re.findall("[A-Za-z0-9]+", s.lower())

    def runs(words):
        return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {" ".join(words)} if words else set()

    want = {}
    for q in (1, 2, 3):
        kept = []
        for _, doc, _ in sorted((r for r in fused if r[0] == q), key=lambda r: (-r[2], r[1])):
            text, subject = texts[doc]
            words = None if text is None else tokens(text)
            same = [d for d, w, _ in kept if w is not None and w == words]
            x = runs(words or [])
            alike = [d for d, w, s in kept if s == subject and x and runs(w or []) and len(x & runs(w)) / len(x | runs(w)) >= 0.85]
            want[q, doc] = (same + alike + [None])[0]
            if want[q, doc] is None:
                kept.append((doc, words, subject))
    rows = spark.createDataFrame(fused, "q int, doc string, score double")
    items = spark.createDataFrame([(d, *v) for d, v in texts.items()], "doc string, text string, subject string")
    assert {(r["q"], r["doc"]): r["redundant_of"] for r in retrieval.mark_copies(rows, items).collect()} == want
    assert any(want.values())


def test_retrieval_pipeline_ranks_what_repeats_nothing(spark):
    got = QUERIES["retrieval_pipeline"](spark, SF).collect()
    finals = {(r["q"], r["doc"]): r["final"] for r in QUERIES["retrieval_reranked"](spark, SF).collect()}
    by = defaultdict(list)
    for r in got:
        assert (r["rank"] is None) == (r["redundant_of"] is not None)
        assert finals[r["q"], r["doc"]] == r["final"]
        by[r["q"]].append(r)
    for rows in by.values():
        kept = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in kept] == list(range(1, len(kept) + 1)) and len(kept) <= 20
        assert [(-r["final"], r["doc"]) for r in kept] == sorted((-r["final"], r["doc"]) for r in kept)


def test_near_copies_deal_hashes_and_only_those_that_are_shared(spark, monkeypatch):
    kept = {}

    def staged(df, name):
        kept[name] = df.localCheckpoint()
        return kept[name]

    monkeypatch.setattr(search, "stage", staged)
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words), "x"), (2, " ".join(words + ["end"]), "x"), (3, " ".join(words), "y"), (4, " ".join(words), "x"), (5, " ".join(f"v{k}" for k in range(40)), "x"), (6, None, "x")], "doc_id long, text string, subject string")
    got = sorted(map(tuple, search.near_copies(docs).collect()))
    assert got == [(1, 2, round(38 / 39, 6)), (1, 4, 1.0)]
    assert not any("array<string>" in kind for df in kept.values() for _, kind in df.dtypes)
    assert {r["doc"] for r in kept["prefixes"].collect()} == {1, 2, 3}
    assert {r["doc"] for r in kept["candidate-sets"].collect()} <= {1, 2, 3}


def test_chains_are_not_broadcast(spark):
    """Chains are small as files but not in the driver's memory."""
    from sparkloom.operators import graph

    steps = spark.range(100).selectExpr("id", "CASE WHEN id % 10 < 9 THEN id + 1 END AS superseded_by")
    done = graph.supersession(steps)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert {(r["id"], r["last"], r["hops"], r["cycle"]) for r in done.collect()} == {(k, k - k % 10 + 9, 9 - k % 10, False) for k in range(100) if k % 10 < 9}


def test_what_hubs_import_is_dealt_as_arrays(spark):
    from sparkloom.operators import rules

    rows = [(1, 2), (1, 2), (1, 4), (2, 1), (2, 7), (2, None), (4, 7), (4, 8), (3, 3), (None, 2), (5, 6), (7, None)]
    imports = spark.createDataFrame(rows, "src int, dst int")
    found = rules.through_hubs(imports, spark.createDataFrame([(2,), (2,), (4,), (6,), (None,)], "node int"))
    want = set(rows) | {(a, d) for a, b in rows for c, d in rows if b == c and b in (2, 4, 6) and None not in (a, d) and a != d}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    # pairs are made behind the last shuffle, by importer, and not before it
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(dsts") < plan.index("RepartitionByExpression [src")


def test_near_copies_read_each_text_once(spark, monkeypatch):
    plans = {}
    real = search.stage

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(search, "stage", staged)
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "A b, c d", "x"), (3, "b a", None), (4, "B a", None), (5, "a b", None), (6, "b", None), (7, "", "x"), (None, "q r s", "x")], "doc_id long, text string, subject string")
    assert sorted(map(tuple, search.near_copies(docs).collect())) == [(1, 2, 1.0), (3, 4, 1.0)]
    assert plans["shingles"].count("regexp_extract_all") == 1
    found = search.near_copies(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("array_intersect") == 1
