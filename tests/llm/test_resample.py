import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from sparkloom.llm import resample as r

SCHEMA = "doc_id long, text string, rank string, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    words = WORD.findall((text or "").translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5):
    own = [(i, *features(t)) for i, t in docs]
    s, t = collections.Counter(b for _, _, f in own for b in f), collections.Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + 10000) / ((s[k] + 1) * (T + 10000)))) for k in range(10000)]
    rows = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, n])
    eligible = sorted((x for x in rows if x[5] >= 20 and x[0] is not None), key=lambda x: (-x[3], x[0]))
    for k, x in enumerate(eligible[: percent * len(eligible) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in rows), key=repr)


def texts(rng, n):
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "ö", "1", "yz")]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 19, 20, 21, 60])))) for i in range(n)]


@pytest.mark.parametrize("least,block,percent", [(1024, 512, 5), (4, 3, 5), (7, 2, 60), (5, 4, 100)])
def test_against_brute_force(spark, monkeypatch, least, block, percent):
    monkeypatch.setattr(r, "LEAST_SEGMENT", least)
    monkeypatch.setattr(r, "SEGMENT_ROWS", least)
    monkeypatch.setattr(r, "BLOCK_ROWS", block)
    rng = random.Random(2)
    rows = texts(rng, 300) + [(1000, None), (1001, "Upper CASE, and; signs! " * 9), (None, "no id " * 30), (None, None)]
    rows += [(5000, "copy of one text " * 10)] * 40  # repeated rows
    target = [t for _, t in texts(rng, 15)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "r", "s") for i, t in rows], SCHEMA).repartition(5)
    got = r.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows, target, percent)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(i, "word " * 30, "r", "s") for i in range(40)], SCHEMA)
    none = docs.select("text").limit(0)
    assert r.importance_resample(docs.limit(0), docs).count() == 0
    got = r.importance_resample(docs, none).collect()
    assert sorted(x["rank"] for x in got if x["rank"]) == [1, 2]
    few = r.importance_resample(docs.limit(3), none).collect()
    assert len(few) == 3 and all(x["rank"] is None for x in few)


def test_pieces_make_no_difference(monkeypatch):
    text = ("one Two three, four five " * 60).encode()
    want = sorted(b for _, x in r.hashed_runs(text) for b in x)
    for size in (1, 7, 64):
        monkeypatch.setattr(r, "PIECE", size)
        found = list(r.hashed_runs(text))
        assert sorted(b for _, x in found for b in x) == want and sum(n for n, _ in found) == 300
    assert want == sorted(features(text.decode())[1])


def test_tournament_merges():
    rng = random.Random(4)
    for k in (1, 2, 3, 8, 13):
        runs = [sorted((rng.randrange(9), i) for _ in range(rng.randrange(12))) for i in range(k)]
        assert list(r.Tournament([iter(x) for x in runs])) == sorted(x for run in runs for x in run)
