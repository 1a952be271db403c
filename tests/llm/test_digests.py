import hashlib
import math

import numpy as np
import pytest

from sparkloom.llm import digests as d

SCHEMA = "doc_id long, text string, part int, edge int, fingerprint string"


def mixed(x):
    mask = (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
    return x ^ x >> 31


def plain_codes(text):
    counts = [0] * d.BUCKETS
    for a, b, c in zip(text, text[1:], text[2:]):
        counts[mixed(a | b << 8 | c << 16) % d.BUCKETS] += 1
    ranked = sorted(counts)
    quartiles = [ranked[d.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    return [sum(n > q for q in quartiles) for n in counts] + [round(8 * math.log2(1 + len(text)))]


def plain_likeness(a, b):
    x, y = a[:-1], b[:-1]
    unrelated = sum(abs(i - j) * x.count(i) * y.count(j) for i in range(4) for j in range(4)) / len(x)
    body = min(sum(abs(i - j) for i, j in zip(x, y, strict=True)) / unrelated, 1) if unrelated else 0
    return 1 - 0.85 * body - 0.15 * min(abs(a[-1] - b[-1]) / 32, 1)


def expected(rows):
    """doc_id -> row, by plain Python."""
    rows = sorted(rows)
    out = {}
    for k, (i, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + other[:cut]
        own, after, following = (plain_codes(t.encode()) for t in (text, changed, other))
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), plain_likeness(own, after), plain_likeness(own, following))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, parts):
    words = "the quick brown fox jumps over a lazy dog while nobody looks at it".split()
    rows = [(i * 3, " ".join(words[(i * k) % len(words)] for k in range(i * 7 % 90))) for i in range(40)]
    rows += [(200, "ä ö ü 漢字 🙂 " * 9), (201, ""), (202, "x"), (203, "🙂🙂🙂🙂"), (204, "abc"), (205, "abc")]
    docs = spark.createDataFrame([(i, t, 1, 1, "f") for i, t in rows], SCHEMA).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["doc_id"]: r for r in d.edited_likeness(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = expected(rows)
    assert set(got) == set(want)
    for i, (n, sha, edited, following) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(edited) and r["near_next"] == pytest.approx(following)
    assert got[204]["fingerprint"] == got[205]["fingerprint"] and got[204]["near_next"] == 1.0
    plain = {r["doc_id"]: r["fingerprint"] for r in d.fingerprints(docs).collect()}
    assert plain == {i: r["fingerprint"] for i, r in got.items()}


def test_odd_tables(spark):
    rows = [(None, "no id", 1, 1, "f"), (None, None, 1, 1, "f"), (5, None, 1, 1, "f"), (6, "same", 1, 1, "f"), (6, "same", 1, 1, "f"), (7, "word " * 400_000, 1, 1, "f")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = d.edited_likeness(docs).collect()
    assert len(got) == 6 and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert {r["n_chars"] for r in got} == {0, 4, 5, 2_000_000}
    assert d.edited_likeness(docs.limit(0)).count() == 0
    one = d.edited_likeness(docs.where("doc_id = 7")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 2_000_000  # its own next


def test_digest_round_trip_and_bounds():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 3, 50, 5000):
        code = d.codes(rng.integers(0, 256, size, np.uint8).tobytes())
        assert (d.read(d.written(code)) == code).all() and d.likeness(code, code) == 1.0
    a, b = d.codes(b"some text of a document " * 30), d.codes(rng.integers(0, 256, 90_000, np.uint8).tobytes())
    assert 0 <= d.likeness(a, b) < 0.5 and d.likeness(a, b) == d.likeness(b, a)


def test_pieces_make_no_difference(monkeypatch):
    text = ("Größe und Länge, " * 300).encode()
    whole, n, at = d.codes(text), d.n_points(text), d.offset(text, 700)
    monkeypatch.setattr(d, "PIECE", 64)
    assert (d.codes(text) == whole).all() and d.n_points(text) == n and d.offset(text, 700) == at == len(text.decode()[:700].encode())


def test_edited_texts_are_nearer_than_next_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = d.edited_likeness(docs).where("n_chars > 40").collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.98
    assert np.median([r["near_edited"] for r in got]) > 0.7 and np.median([r["near_next"] for r in got]) < 0.4
