import random

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import graph, jaccard_join as j

SPACE = " \t\n\x0b\x0c\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, size, percent):
    sets = []
    for i, text in rows:
        w = words_of(low(text))
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "É", "a b"] + [f"w{k}" for k in range(200)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = words_of(rng.choice(out)[1] or "x")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w += [rng.choice(vocabulary)]
            text = rng.choice(SPACE).join(x.upper() if rng.random() < 0.1 else x for x in w)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 20, 60, 150])))
        out.append((i, text))
    return out


@pytest.mark.parametrize("percent", [90, 80])
def test_against_brute_force(spark, percent, monkeypatch):
    rows = corpus(percent, 250) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(5)
    monkeypatch.setattr(j, "PROPOSALS", (1, 2))
    monkeypatch.setattr(j, "FREQUENT", 5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_components(docs, 3, percent).collect())
    assert got == brute(rows, 3, percent)


def test_one_of_each_and_odd_rows(spark):
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(5, base, "a"), (3, base + " tail", "b"), (9, base.upper(), "c"), (None, base, "d"), (7, "own words here", "e"), (7, "own words here", "e"), (8, "x " * 100_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    got = sorted((r["doc_id"] or 0, r["cls"]) for r in j.one_of_each(docs).collect())
    assert got == [(0, "d"), (3, "b"), (7, "e"), (7, "e"), (8, "f")]
    assert j.jaccard_components(docs.limit(0)).count() == 0


def test_bound_never_excludes_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.06], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 90 * (len(a) + len(b) - inter):
            assert j._within(j.slices(a)[None], j.slices(b)[None], np.array([len(a)]), np.array([len(b)]), 90)[0]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["comp"] for r in graph.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_one_row_of_each_doc_id_stays(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (1, "", "a"), (2, text, "a"), (3, "quite another text than the others have here", "a"), (4, None, "a"), (4, None, "a"), (None, text, "a"), (None, text, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, None)
    assert got.columns == docs.columns
    want = [(1, text, "a"), rows[5], (4, None, "a"), *rows[8:]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), None).count() == 0


def family(n, changed):
    """Copies of one long text with some words each of their own: near misses, all in the regions of the shared words."""
    rng = random.Random(n)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(2, 120), changed):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows,pairs", [(16, 40), (4096, 1 << 18)])
def test_regions_in_blocks(spark, monkeypatch, rows, pairs):
    monkeypatch.setattr(j, "REGION_ROWS", rows)
    monkeypatch.setattr(j, "HELD_PAIRS", pairs)
    texts = corpus(9, 120) + [(1000 + i, t) for i, t in family(60, 2)] + [(2000 + i, t) for i, t in family(40, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_components(docs).collect())
    assert got == brute(texts, 3, 90)


def test_proposals_stay_few():
    rng = np.random.default_rng(1)
    for most in (2, 16):
        held = j._Proposals(most, 1000)
        every = []
        for _ in range(60):
            a, b = rng.integers(0, 100, 500), rng.integers(100, 200, 500)
            near = rng.integers(0, 1000, 500)
            every.append((a, b, near))
            assert not list(held.add(a, b, near)) and held.held <= max(1000, 4 * 200 * most)
        (out,) = held.given()
        a, b, near = (np.concatenate(x) for x in zip(*every, strict=True))
        keep = j._nearest(a, b, near, most)
        assert set(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)) == set(zip(a[keep].tolist(), b[keep].tolist(), strict=True)) and all(out.column(2).to_pylist())
    held = j._Proposals(1 << 62, 1000)
    out = [x for _ in range(9) for x in held.add(np.arange(400), np.arange(400) + 400, np.zeros(400, int))] + list(held.given())
    assert len(out) == 3 and not any(x for r in out for x in r.column(2).to_pylist())
