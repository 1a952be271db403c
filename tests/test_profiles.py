"""Quantiles against sorting, timed lines, rest buckets, folders as tables."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import profiles, tables
from sparkloom.sources import tree


@pytest.mark.parametrize("buckets", [2, 100])
def test_elements_against_sorting(spark, monkeypatch, buckets):
    monkeypatch.setattr(profiles, "BUCKETS", buckets)
    rng = random.Random(buckets)
    rows = [("hot", float(rng.choice([1, 2, 3, rng.randrange(500)]))) for _ in range(900)] + [(n, float(rng.randrange(50))) for n in "abc" for _ in range(rng.randrange(1, 40))] + [("a", None), ("none", None)]
    got = {r["name"]: r for r in profiles.timing(spark.createDataFrame(rows, "name string, v double"), "name", "v").collect()}
    for name in {r[0] for r in rows}:
        own = sorted(v for n, v in rows if n == name and v is not None)
        want = own[min(len(own) - 1, int(0.95 * len(own)))] if own else None
        assert got[name]["p95"] == want and got[name]["n"] == sum(n == name for n, _ in rows)
    one = profiles.profile(spark.createDataFrame(rows, "name string, v double"), "name", "v").first()
    every = sorted(v for _, v in rows if v is not None)
    n = len(every)
    assert one["samples"] == n and one["p50"] == round((every[(n - 1) // 2] + every[n // 2]) / 2, 3) and one["p95"] == every[min(n - 1, int(0.95 * n))]


def test_timed_lines(spark):
    lines = ["query users: 12.5ms", "  load = 2 s", "a,3us", "x: y: 7", "no time", ": 5", "n: 1.5 sec", None, ""]
    got = {r["name"]: round(r["value"], 6) for r in profiles.timed_lines(spark.createDataFrame([(x,) for x in lines], "text string")).collect()}
    assert got == {"query users": 12.5, "load": 2000.0, "a": 0.003, "x: y": 7.0, "n": 1500.0}
    began = time.perf_counter()
    for text in ("a" * 40_000, ": " * 20_000, "a" + " " * 40_000 + "b", "error " * 8_000, " at " + "(" * 40_000, "1:" * 20_000, "[" * 40_000 + "a"):
        df = spark.createDataFrame([(1, 1, text)], "log int, line int, text string")
        profiles.timed_lines(df).collect()
        profiles.read_lines(df).collect()
    assert time.perf_counter() - began < 30


def test_log_lines(spark):
    lines = ["2024-01-02T03:04:05 Warning: disk 12 of 0xff", "ERROR [db] - id 123e4567-e89b-12d3-a456-426614174000", "Traceback (most recent call last)", "", None, "plain"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "log int, line int, text string")
    got = {r["line"]: r for r in profiles.read_lines(rows).collect()}
    assert (got[0]["level"], got[0]["stamp"], got[0]["message"]) == ("WARN", "2024-01-02T03:04:05", "disk # of #") and (got[1]["level"], got[1]["message"]) == ("ERROR", "db] - id #")
    assert got[2]["is_trace"] and got[3]["message"] == "" and 4 not in got and got[5]["level"] is None


@pytest.mark.parametrize("most", [1, 2, 3, 5, 9])
def test_other_bucket(spark, most):
    counts = {"a": 5, "b": 5, "c": 2, "d": 9, "e": 1}
    got = {r["name"]: r["n"] for r in tables.other_bucket(spark.createDataFrame(list(counts.items()), "name string, n long"), "name", "n", most).collect()}
    order = sorted(counts, key=lambda k: (-counts[k], k))
    want = dict(counts) if most >= 5 else {k: counts[k] for k in order[: most - 1]} | {"OTHER": sum(counts[k] for k in order[most - 1 :])}
    assert got == want


def test_tree(spark, tmp_path):
    files = {"a/b.py": b"x = 1\n", "a/win.md": b"one\r\ntwo\r\n", "bin.dat": b"a\0b", "odd.txt": b"\xff\xfe", "Dockerfile": b"FROM x\n", "big.sql": b"y" * 200, "a/b": b"z"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(data)
    rows = tree.read_tree(spark, str(tmp_path), most_bytes=100)
    got = {r["path"]: r for r in rows.collect()}
    blob = lambda data: hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
    assert set(got) == set(files) and all(r["blob_sha1"] == blob(files[p]) for p, r in got.items() if p != "big.sql")
    assert {p: r["status"] for p, r in got.items()} == {"a/b.py": "text", "a/win.md": "text", "bin.dat": "binary", "odd.txt": "binary", "Dockerfile": "text", "big.sql": "large", "a/b": "text"}
    assert {p: r["language"] for p, r in got.items()} == {"a/b.py": "python", "a/win.md": "markdown", "bin.dat": "unknown", "odd.txt": "text", "Dockerfile": "dockerfile", "big.sql": "sql", "a/b": "unknown"}
    assert got["a/win.md"]["text"] == "one\r\ntwo\r\n" and got["bin.dat"]["text"] is None and got["a/win.md"]["unix_sha1"] == blob(b"one\ntwo\n")
    state = spark.createDataFrame([("a/b.py", 6, blob(b"x = 2\n")), ("a/win.md", 8, blob(b"one\ntwo\n")), ("gone", 1, "h"), ("big.sql", 200, None), ("bin.dat", 3, blob(b"a\0b")), ("odd.txt", 2, blob(b"\xff\xfe")), ("Dockerfile", 7, blob(b"FROM x\n"))], "path string, size long, blob_sha1 string")
    assert {r["path"]: r["change"] for r in tree.compare(rows, state).collect()} == {"a/b.py": "changed", "gone": "deleted", "a/b": "added"}
    assert rows.where(F.col("language") == "python").count() == 1


def test_innermost_spans_against_all_pairs(spark):
    from sparkloom.operators import measures

    rng = random.Random(7)
    spans = [(rng.choice("ab"), a, a + rng.choice([0, 3, 50, 400, -1]), k) for k, a in enumerate(rng.randrange(300) for _ in range(60))]
    points = [(rng.choice("abc"), rng.randrange(-5, 500)) for _ in range(200)] + [("a", None)]
    got = measures.innermost(spark.createDataFrame(points, "k string, line int"), spark.createDataFrame(spans, "k string, a int, z int, name int"), "k", "line", "a", "z", "name").collect()

    def best(k, line):
        held = [s for s in spans if s[0] == k and line is not None and s[1] <= line <= s[2]]
        return max(held, key=lambda s: (s[1], -s[2], s[3]))[3] if held else None

    assert sorted((r["k"], r["line"] or -99, r["name"] or -1) for r in got) == sorted((k, line or -99, best(k, line) or -1) for k, line in points)
