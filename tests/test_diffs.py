"""Line diffs against dynamic programming."""

import random
import time

import pytest

from sparkloom.operators import diffs as d


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("kept", [d.KEPT_BITS, 40, 1])
def test_matches_are_longest(monkeypatch, kept):
    monkeypatch.setattr(d, "KEPT_BITS", kept)
    rng = random.Random(kept)
    for _ in range(300):
        letters = "abcdefgh"[: rng.randrange(1, 9)]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = d.matches(a, b)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def applied(old, found):
    """The new lines, from the old ones and the hunks alone."""
    out, at = [], 0
    for h in found:
        first = min((x["o"] for x in h["lines"] if x["o"]), default=None)
        start = h["old_start"] - 1
        assert first in (None, start + 1)
        out += old[at:start]
        at = start
        assert len(out) + 1 == h["new_start"]
        for x in h["lines"]:
            if x["t"] in " -":
                assert old[at] == x["s"] and x["o"] == at + 1
                at += 1
            if x["t"] in " +":
                out.append(x["s"])
                assert x["n"] == len(out)
    return out + old[at:]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_hunks_rebuild_the_new_version(context):
    rng = random.Random(context)
    for _ in range(300):
        old = [rng.choice("abcd") + str(rng.randrange(9)) for _ in range(rng.randrange(60))]
        new = [x for x in old if rng.random() > 0.1]
        for _ in range(rng.randrange(4)):
            new.insert(rng.randrange(len(new) + 1), "new")
        changed = d.changes(d.matches(old, new), len(old), len(new))
        found = d.hunks(old, new, changed, context)
        assert applied(old, found) == new
        for h in found:
            kinds = "".join(x["t"] for x in h["lines"])
            assert kinds.strip(" ") and len(kinds) - len(kinds.lstrip(" ")) <= context >= len(kinds) - len(kinds.rstrip(" ")) and " " * (2 * context + 1) not in kinds.strip(" ")


def test_moved_line_and_files(spark):
    before = [("moved", "a\nb\nc\nd\n"), ("same", "x"), ("gone", "1\n2"), ("null", None), ("empty", ""), ("end", "a\n"), ("both null", None)]
    after = [("moved", "b\nc\nd\na\n"), ("same", "x"), ("made", "n\n"), ("null", "now"), ("empty", None), ("end", "a"), ("both null", None)]
    got = {r["path"]: r for r in d.file_diffs(*(spark.createDataFrame(x, "path string, text string") for x in (before, after))).collect()}
    assert {p: (r["additions"], r["deletions"]) for p, r in got.items()} == {"moved": (1, 1), "gone": (0, 2), "made": (1, 0), "null": (1, 0), "empty": (0, 0), "end": (0, 0)}
    assert [(x["t"], x["o"], x["n"], x["s"]) for x in got["moved"]["hunks"][0]["lines"]] == [("-", 1, None, "a"), (" ", 2, 1, "b"), (" ", 3, 2, "c"), (" ", 4, 3, "d"), ("+", None, 4, "a")]


def test_large_files_take_no_time():
    rng = random.Random(3)
    old = [str(rng.randrange(300)) for _ in range(12_000)]
    new = [str(rng.randrange(300)) for _ in range(12_000)]
    began = time.perf_counter()
    pairs = d.matches(old, new)
    assert len(pairs) > 1000 and time.perf_counter() - began < 20
    assert d.matches(["a"] * 100_000, ["a"] * 99_999 + ["b"]) == [(k, k) for k in range(99_999)]
