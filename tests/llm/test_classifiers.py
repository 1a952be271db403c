import math
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import features, quality, toxicity

SF = "/root/testdata/sf0.01"
ROWS = [(1, "a", "x", 0.9), (2, "a", "x", 0.8), (3, "a", "y", 0.2), (4, "b", "x", 0.1), (5, "b", "x", 0.1), (6, "", "", 0.5)]


def auc(pairs):
    """Mann-Whitney, ties by half."""
    bad, good = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))


def strength(mean, spread):
    found = mean * (1 - mean) / spread - 1 if spread else quality.STRONGEST
    return min(quality.STRONGEST, max(quality.WEAKEST, found))


def logit(p):
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def test_site_sums(spark):
    scored = spark.createDataFrame([(h, f"{h}/{q}", p) for _, h, q, p in ROWS], "host string, path string, p double")
    got = {r["path"]: r for r in quality.site_sums(scored).collect()}
    assert {k: (r["n"], round(r["s"], 9), r["hn"]) for k, r in got.items()} == {"a/x": (2, 1.7, 3), "a/y": (1, 0.2, 3), "b/x": (2, 0.2, 2), "/": (1, 0.5, 1)}
    assert all(abs(r["m0"] - 2.6 / 6) < 1e-12 for r in got.values())


def test_quality_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    # repeated rows, null texts and sites, and columns that clash with the operator's own names
    odd = docs.limit(20).union(docs.limit(5)).withColumn("text", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("text"))).withColumn("source", F.lit(None).cast("string"))
    docs = docs.union(odd).withColumn("p", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("host", F.lit(2))
    got = quality.score_quality(docs, labels).select("rest.source", "rest.lang", "p", "host_mean", "path_mean", "score", "kept").collect()
    assert len(got) == docs.count()
    sites = [(r["source"] or "", f"{r['source'] or ''}/{r['lang'] or ''}", r["p"]) for r in got]
    totals = {}
    for k in (0, 1):
        for s in sites:
            n, t = totals.get((k, s[k]), (0, 0.0))
            totals[k, s[k]] = n + 1, t + s[2]
    m0 = sum(s[2] for s in sites) / len(sites)
    mean = lambda k, v: totals[k, v][1] / totals[k, v][0]
    k0 = strength(m0, sum((mean(0, s[0]) - m0) ** 2 for s in sites) / len(sites))
    k1 = strength(m0, sum((mean(1, s[1]) - mean(0, s[0])) ** 2 for s in sites) / len(sites))
    for r, (h, q, p) in zip(got, sites, strict=True):
        (hn, hs), (n, s) = totals[0, h], totals[1, q]
        a = (hs - p + k0 * m0) / (hn - 1 + k0)
        b = (s - p + k1 * a) / (n - 1 + k1)
        want = 1 / (1 + math.exp(-(logit(p) + max(-quality.MOST, min(quality.MOST, logit(b) - logit(m0))))))
        assert abs(r["host_mean"] - a) < 1e-6 and abs(r["path_mean"] - b) < 1e-6 and abs(r["score"] - want) < 1e-6
        assert r["kept"] == (r["score"] >= quality.THRESHOLD)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    done = quality.score_quality(docs, labels).join(labels.where(features.held_out()), "doc_id").select("score", "quality").collect()
    assert auc([(r["score"], r["quality"]) for r in done if r["quality"] is not None]) > 0.9


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    done = toxicity.score_toxicity(docs, labels).cache()
    assert done.count() == docs.count() and done.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert done.where("predicted <> int(score >= 0.5)").isEmpty()
    for r in done.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    known = done.where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").select("score", "toxic").collect()
    assert auc([(r["score"], r["toxic"]) for r in known]) > 0.9


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers_without_labels_or_rows(spark, score):
    schema = "doc_id long, text string, source string, lang string, features int, x int"
    docs = spark.createDataFrame([(1, None, None, None, 1, 1), (1, None, None, None, 1, 1), (None, "", "s", "en", 1, 1), (3, "word " * 50_000, "s", None, 1, 1)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in score(docs, none).collect()] == pytest.approx([0.5] * 4)
    labels = spark.createDataFrame([(3, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert score(docs, labels).count() == 4
    assert score(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("text", [b"a" * 1_000_000, b"Ab." * 300_000, b"a" + b"." * 1_000_000, b"a*" * 500_000, b"A" * 999_999 + b"b", b"word " * 200_000])
def test_long_words_take_no_time(text):
    import time

    began = time.perf_counter()
    found = toxicity.extractor({b"word": 2.0}, {b"word": 1.0})(text)
    assert time.perf_counter() - began < 6 and all(map(math.isfinite, found))


def test_masked_words_are_found_as_by_the_plain_pattern():
    import random
    import re

    plain = re.compile(rb"[A-Za-z][A-Za-z]*[0-9@$*!._-]+[A-Za-z0-9@$*!._-]*[A-Za-z0-9@$]")
    rng = random.Random(5)
    for _ in range(20_000):
        text = bytes(rng.choice(b"aB1@*._- x,") for _ in range(rng.randrange(25)))
        assert plain.findall(text) == toxicity._MASKED.findall(text)


def test_toxicity_query(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op9_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.collect()) and labels.count() > 50
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
