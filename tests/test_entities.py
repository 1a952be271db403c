"""Names in questions, and what they are."""

import pytest

from sparkloom.operators import entities as e


def named(spark, text, **hints):
    df = spark.createDataFrame([(1, text, hints.get("symbols"), hints.get("paths"))], "q long, text string, symbols array<string>, paths array<string>")
    return [(r["entity"], r["kind"], r["explicit"], r["is_new"]) for r in e.extract(df).orderBy("place").collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("why does RetryPolicy fail in src/app/retry.py?", [("src/app/retry.py", "path", False, False), ("RetryPolicy", "identifier", False, False)]),
        ("see `run_once(x)` and `docs/a.md`.", [("docs/a.md", "path", True, False), ("run_once", "identifier", True, False)]),
        ("README, Dockerfile and .env.example, not ./env", [("README.md", "path", False, False), ("Dockerfile", "path", False, False), (".env.example", "path", False, False), ("env", "identifier", False, False), ("example", "identifier", False, False)]),
        ("add a nullable correlation_id column to event_log", [("correlation_id", "identifier", False, True), ("event_log", "identifier", False, False)]),
        ("a class called FooBar", [("FooBar", "identifier", False, True)]),
        ("shop.retention.Service runs", [("shop", "identifier", False, False), ("retention", "identifier", False, False), ("Service", "identifier", False, False)]),
        ("SQL and JSON, The API of YAML; MAX_SIZE", [("MAX_SIZE", "identifier", False, False)]),
        ("config.toml (app.py), x.exe", [("config.toml", "path", False, False), ("app.py", "path", False, False)]),
        ("", []), (None, []),
    ],
)
def test_extraction(spark, text, want):
    got = [x for x in named(spark, text) if text != "config.toml (app.py), x.exe" or x[1] == "path"]
    assert got == want


def test_hints_come_first_and_are_meant(spark):
    assert named(spark, "where is runOnce", symbols=["runOnce", "Other"], paths=["a/b.py"]) == [("a/b.py", "path", True, False), ("runOnce", "identifier", True, False), ("Other", "identifier", True, False)]


def test_long_words_end_in_time(spark):
    import time

    began = time.perf_counter()
    for text in ("aA" * 200_000, "a/" * 200_000, "a." * 200_000, "." * 40_000 + "a" + "." * 40_000 + "-", "_a" * 200_000, "`" * 200_001, "add " * 100_000, "named " * 60_000):
        named(spark, text)
    assert time.perf_counter() - began < 60


def test_matches(spark):
    questions = spark.createDataFrame([(1, "fix `retrypolicy` in b.py"), (2, "RetryPolicy and retrypolicy"), (3, "Policy.run or Clock.tick"), (4, "MAX_SIZE of max_size"), (5, "uq_run_seq in a.b_c"), (6, "busy_name"), (7, "`busy_name`")], "q long, text string")
    symbols = spark.createDataFrame(
        [("src/b.py", "RetryPolicy", "RetryPolicy", "class", True), ("src/c.py", "run", "Policy.run", "method", True), ("src/d.py", "tick", "Timer.tick", "method", False), ("src/c.py", "MAX_SIZE", "MAX_SIZE", "function", True), ("src/d.py", "MAX_SIZE", "MAX_SIZE", "variable", True), ("src/d.py", "max_size", "max_size", "function", True)],
        "path string, name string, qualified string, kind string, exported boolean",
    )
    files = spark.createDataFrame([("src/b.py",), ("lib/b.py",), ("src/ab.py",)], "path string")
    mentions = [("db/migrations/1.sql", "sql", "uq_run_seq", 1), ("docs/x.md", "markdown", "uq_run_seq", 5), ("z.yaml", "yaml", "uq_run_seq", 1), ("y.py", "python", "uq_run_seq", 9), ("docs/x.md", "markdown", "b_c", 1)]
    mentions += [(f"f{k}.py", "python", "busy_name", k) for k in range(13)]
    names = spark.createDataFrame(mentions, "path string, language string, name string, chunks int")
    found = {}
    for r in e.exact_retriever(questions, files, symbols, names).orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append(r["id"])
    assert found == {
        1: ["file:lib/b.py", "file:src/b.py", "symbol:src/b.py::RetryPolicy"],
        2: ["symbol:src/b.py::RetryPolicy"],
        3: ["symbol:src/c.py::Policy.run", "symbol:src/d.py::Timer.tick"],
        4: ["symbol:src/d.py::max_size", "symbol:src/d.py::MAX_SIZE"],
        5: ["file:db/migrations/1.sql", "file:docs/x.md", "file:z.yaml"],
        7: ["file:f12.py", "file:f11.py", "file:f10.py"],
    }


def test_exact_hits_read_files_and_texts_once(spark, monkeypatch):
    from sparkloom.plans import source_queries as s

    plans = {}
    real = e.stage

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(e, "stage", staged)
    monkeypatch.setattr(s, "stage", staged)
    found = s.exact_hits(spark, "/root/testdata/sf0.001")
    # files are scanned for symbols in one pass, and for names in one; questions are spread before they are read
    assert plans["symbols"].count("MapInArrow") == 1 and "MapInArrow" not in plans["meant"]
    assert plans["named"].count("regexp_extract_all") == 1 and "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plans["entities"] and plans["entities"].count("called|named") == 1
    # a question's parts are taken out below where its mentions become rows
    assert plans["entities"].index("Generate explode") < plans["entities"].index("called|named")
