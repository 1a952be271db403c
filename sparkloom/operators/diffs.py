"""Line diffs of two versions of many files: longest common subsequences, hunks with context, complete counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import in_batches

CONTEXT = 3
#: Rows of bits are kept up to so many; larger problems are split in two first.
KEPT_BITS = 1 << 26

Pairs = list[tuple[int, int]]


def lines_of(text: str | None) -> list[str]:
    """A final line end ends the last line and begins none; null has no lines."""
    lines = [] if text is None else text.split("\n")
    return lines[:-1] if lines and not lines[-1] else lines


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """A row of bits for each element of b, one bit for each of a: bit i is 0 where a common subsequence grows by one with a[i].

    All of a is taken at once by additions over whole rows.
    """
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
        yield row


def _growth(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of b with each beginning of a."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):
        pass
    # the last character is the first bit
    bits = bin(row)[2:].zfill(len(a))[::-1] if a else ""
    return [0, *accumulate(c == "0" for c in bits)]


def _common(a: list[int], b: list[int], at_a: int, at_b: int) -> Pairs:
    """Pairs of places of a longest common subsequence, moved by the offsets; memory stays linear however long both are."""
    work, found = [(a, b, at_a, at_b)], []
    while work:
        a, b, i, j = work.pop()
        if not a or not b:
            continue
        if len(b) == 1:
            found += [(i + a.index(b[0]), j)] if b[0] in a else []
        elif len(a) * len(b) <= KEPT_BITS:
            found += [(i + x, j + y) for x, y in _traced(a, b)]
        else:
            half = len(b) // 2
            before, after = _growth(a, b[:half]), _growth(a[::-1], b[half:][::-1])[::-1]
            cut = max(range(len(a) + 1), key=lambda k: before[k] + after[k])
            work += [(a[:cut], b[:half], i, j), (a[cut:], b[half:], i + cut, j + half)]
    return sorted(found)


def _traced(a: list[int], b: list[int]) -> Pairs:
    rows = list(_rows(a, b))
    found = []
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found


def matches(old: list[str], new: list[str]) -> Pairs:
    """Places of equal lines, rising on both sides, as many as there can be.

    Equal ends are matched first; of the rest, lines that the other side lacks are in no common subsequence and go.
    """
    head = next((k for k, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
    tail = next((k for k, (x, y) in enumerate(zip(reversed(old[head:]), reversed(new[head:]))) if x != y), min(len(old), len(new)) - head)
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    numbers = {x: k for k, x in enumerate(set(a) & set(b))}
    of_a, of_b = [k for k, x in enumerate(a) if x in numbers], [k for k, x in enumerate(b) if x in numbers]
    inner = _common([numbers[a[k]] for k in of_a], [numbers[b[k]] for k in of_b], 0, 0)
    ends = [(len(old) - k, len(new) - k) for k in range(tail, 0, -1)]
    return [(k, k) for k in range(head)] + [(head + of_a[x], head + of_b[y]) for x, y in inner] + ends


def changes(pairs: Pairs, n_old: int, n_new: int) -> list[tuple[int, int, int, int]]:
    """Stretches old[a:b] that new[c:d] stands for, in order; what lies between them is equal."""
    out, i, j = [], 0, 0
    for x, y in [*pairs, (n_old, n_new)]:
        if x > i or y > j:
            out.append((i, x, j, y))
        i, j = x + 1, y + 1
    return out


def hunks(old: list[str], new: list[str], changed: list[tuple[int, int, int, int]], context: int = CONTEXT) -> list[dict]:
    """Changes with ``context`` equal lines around them; those whose contexts meet or touch are one hunk."""
    groups: list[list] = []
    for c in changed:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []
    for group in groups:
        i, j = group[0][0], group[0][2]
        lead = min(context, i, j)
        i, j = i - lead, j - lead
        start, lines = (i, j), []
        for a, b, c, d in [*group, (min(group[-1][1] + context, len(old)),) * 2 + (0, 0)]:
            lines += [(" ", k + 1, j + k - i + 1, old[k]) for k in range(i, a)]
            lines += [("-", k + 1, None, old[k]) for k in range(a, b)]
            lines += [("+", None, k + 1, new[k]) for k in range(c, d)]
            i, j = b, d
        out.append({"old_start": start[0] + 1, "new_start": start[1] + 1, "lines": [dict(zip(("t", "o", "n", "s"), x, strict=True)) for x in lines]})
    return out


_LINE = pa.struct([("t", pa.string()), ("o", pa.int32()), ("n", pa.int32()), ("s", pa.string())])
_HUNKS = pa.list_(pa.struct([("old_start", pa.int32()), ("new_start", pa.int32()), ("lines", pa.list_(_LINE))]))
_SCHEMA = pa.schema([("path", pa.string()), ("additions", pa.int64()), ("deletions", pa.int64()), ("hunks", _HUNKS)])
DIFF = "path string, additions bigint, deletions bigint, hunks array<struct<old_start:int,new_start:int,lines:array<struct<t:string,o:int,n:int,s:string>>>>"


def file_diffs(old: DataFrame, new: DataFrame, context: int = CONTEXT) -> DataFrame:
    """path, additions, deletions, hunks of each file (path, text) that differs between two tables.

    A file that one side lacks, or whose text is null there, is all added or all deleted.  The fewest lines that can be are added and
    deleted, so a moved line is one of each.  Line numbers begin at 1; ``o`` is null for added lines, ``n`` for deleted ones.  Paths
    are keys of both tables.  Digests are compared first, and only texts that differ are brought together.
    """
    digest = lambda df, name: df.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias(name), F.col("text").isNull().alias(f"{name}_null"))
    both = digest(old, "a").join(digest(new, "b"), "path", "full")
    differ = both.where(~F.col("a").eqNullSafe(F.col("b")) | ~F.coalesce("a_null", F.lit(True)).eqNullSafe(F.coalesce("b_null", F.lit(True)))).select("path")
    sides = (df.join(differ, "path", "left_semi").select("path", F.col("text").alias(c)) for df, c in ((old, "old"), (new, "new")))
    texts = next(sides).join(next(sides), "path", "full").select(F.col("path").cast("string"), "old", "new")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, a, b = (c[k].as_py() for c in batch.columns)
                a, b = lines_of(a), lines_of(b)
                changed = changes(matches(a, b), len(a), len(b))
                yield path, sum(c[3] - c[2] for c in changed), sum(c[1] - c[0] for c in changed), hunks(a, b, changed, context)

    return texts.mapInArrow(lambda batches: in_batches(rows(batches), _SCHEMA, 64), DIFF)
