"""Each stage of the pipeline against brute force, on its own input."""

import re

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What went into each stage and what came out, written and read again between them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        done = spark.read.parquet(path)
        out[name] = docs, done
        docs = done
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(steps):
    columns = steps["quality"][0].columns
    assert all(done.columns == columns for name, (_, done) in steps.items() if name != "sentencepiece")


def test_quality_keeps_whole_rows(steps):
    before, after = map(texts, steps["quality"])
    assert 0 < len(after) < len(before) and all(before[k] == v for k, v in after.items())


def test_line_dedup(steps):
    before, after = map(texts, steps["line_dedup"])
    held = {}
    for i, text in before.items():
        for key in {low(x.strip(SPACE)) for x in (text or "").split("\n")}:
            if len(key) >= 40:
                held.setdefault(key, []).append(i)
    gone = lambda i, x: len(ids := held.get(low(x.strip(SPACE)), [])) >= 5 and max(ids) != i
    assert after == {i: "\n".join(x for x in (t or "").split("\n") if not gone(i, x)) for i, t in before.items()}


def test_near_copies(steps):
    before, after = map(texts, steps["ngram_jaccard"])
    n, sets = corpus_pipeline.NEAR_WORDS, {}
    for i, text in before.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets[i] = {tuple(words[k : k + n]) for k in range(max(len(words) - n + 1, min(len(words), 1)))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert after == {i: before[i] for i in ids if find(i) == i}


def test_decontamination(steps, spark):
    before, after = map(texts, steps["decontamination"])
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = words(r["text"])
        windows |= {tuple(own[k : k + 10]) for k in range(max(len(own) - 9, min(len(own), 1)))}
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(t[k : k + n]) in windows for n in sizes for k in range(len(t) - n + 1))
    assert set(after) <= set(before)
    for i, text in before.items():
        if not hit(words(text)):
            assert after[i] == text
        elif i in after:
            assert after[i] != text


def test_encoding_is_lossless(steps):
    before, done = steps["sentencepiece"]
    rows = done.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in rows)
