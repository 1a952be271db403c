import hashlib
import math
import random

import numpy as np
import pytest

from sparkloom.llm import clustering as c
from sparkloom.llm.cover_trees import Centroids, cover_tree, nearest, squares

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int"


def brute(rows, k, rounds, dims, scale=64, seed=1):
    """Plain Lloyd over Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()), r[1]))
    cents = [v for _, v in start[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(cents))

    for _ in range(rounds):
        own = [[v for _, v in kept if place(v)[1] == j] for j in range(len(cents))]
        cents = [[sum(col) // len(o) for col in zip(*o, strict=True)] if o else m for o, m in zip(own, cents, strict=True)]
    return sorted((str(i), place(v)[1], place(v)[0]) for i, v in kept), cents


def vectors(rng, n, dims):
    centers = [[rng.gauss(0, 2) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(centers)]) for i in range(n)]


@pytest.mark.parametrize("block,leaf", [(1024, 8), (16, 2)])
def test_against_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(c, "BLOCK_ROWS", block)
    monkeypatch.setattr(c, "LEAF", leaf)
    rng = random.Random(5)
    rows = vectors(rng, 150, 4)
    same = [0.5, -0.25, 0.0, 1.0]
    rows += [(1000 + i, same) for i in range(90)]  # over a third are one vector
    rows += [(7, rows[7][1]), (None, [1.0, 1.0, 1.0, 1.0]), (2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None, 0.0, 0.0]), (2004, [1.0, math.nan, 0.0, 0.0]), (2005, [math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(3)
    want, cents = brute(rows, 6, 3, 4)
    done, got = c.lloyd(df, clusters=6, dims=4)
    assert got == cents
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in done.collect()) == want


def test_few_equal_and_no_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0, 0) for i in range(5)], SCHEMA)
    done, cents = c.lloyd(df, clusters=3, dims=2)
    assert cents == [[64, 128]] * 3 and {(r["cluster"], r["distance"]) for r in done.collect()} == {(0, 0)}
    one, cents = c.lloyd(df.limit(1), clusters=3, dims=2)
    assert len(cents) == 1 and one.count() == 1
    none, cents = c.lloyd(df.limit(0), clusters=3, dims=2)
    assert cents == [] and c.clusters_with_inertia(none, cents).count() == 0


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38], 0, 0), (2, [0.0, 0.0], 0, 0)], SCHEMA)
    done, cents = c.lloyd(df, clusters=1, rounds=0, dims=2)
    assert max(r["distance"] for r in done.collect()) == 2 * c.MOST**2 and cents in ([[c.MOST, -c.MOST]], [[0, 0]])


def test_trees_keep_their_promises():
    rng = np.random.default_rng(3)
    points = np.vstack([rng.integers(-400, 400, (200, 5)), np.tile([[1, 2, 3, 4, 5]], (60, 1))])
    tree, order = cover_tree(points, 4)
    assert sorted(order) == list(range(260)) and (tree.points == points[order]).all()
    for s, e, center, child, n, radius in zip(*tree[1:], strict=True):
        gaps = np.sqrt(((tree.points[s:e] - tree.points[center]) ** 2).sum(1))
        assert s <= center < e and gaps.max() <= radius + 1e-9
        if n:
            assert tree.start[child] == s and tree.end[child + n - 1] == e
            heads = tree.points[tree.center[child : child + n]]
            apart = np.sqrt(squares(heads, heads)) + np.eye(n) * 1e9
            assert apart.min() > radius / 2
    cents = rng.integers(-400, 400, (9, 5))
    cents[4] = cents[2]
    found = nearest(tree, Centroids(cents.tolist()))
    assert (found == squares(tree.points, cents).argmin(1)).all()
