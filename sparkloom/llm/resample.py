"""Target-distribution importance resampling (operator 13).

1. One pass over all documents and one over all target texts count hashed runs
   of 1 to 3 words by bucket; tasks add up what they read, and the ``BUCKETS``
   sums give an array of gains.
2. A second pass scores each document from that array and a draw of its id.  Each
   partition sorts what it scored into a run, eligible rows first by falling
   score, and packs it into blocks; equal rows are stored once with their number.
3. Keys sampled evenly from the runs part the order into segments.  A segment's
   place follows from exact counts, so only segments that begin before the draw
   is full are shuffled; each is merged by a tournament tree over its runs'
   pieces, gives out ranks, and stops at the exact count.  All other rows are
   unpacked where they lie.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, map_arrow, shuffle_partitions, small_batches
from .decontaminate import _WORDS

BUCKETS, LONGEST_RUN = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
PIECE = 1 << 20  # bytes taken apart at once
BLOCK_ROWS = 512
SEGMENT_ROWS, LEAST_SEGMENT = 1 << 17, 1024
PROBES = 64  # keys sampled from a run


def hashed_runs(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and the buckets of all runs of 1 to 3 words, for each piece of a text; runs go on over pieces."""
    data = (text or b"").translate(_WORDS)
    before: list[bytes] = []
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words = before + data[at:end].split()
        spaced = [b" " + w for w in words]
        # a checksum goes on from that of the run's first words
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        k = len(before)
        runs = [one[k:], two[max(k - 1, 0) :], three[max(k - 2, 0) :]]
        yield len(words) - k, np.fromiter(chain(*runs), np.uint32, sum(map(len, runs))).astype(np.int64) % BUCKETS
        before = words[-LONGEST_RUN + 1 :]
        at = end


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many runs of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in column(batch, "text"):
                for _, buckets in hashed_runs(text):
                    counts += np.bincount(buckets, minlength=BUCKETS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["bucket", "n"])

    small_batches(docs.sparkSession)
    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket int, n bigint")
    total = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        total[r["bucket"]] = r["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed ratio of target to source share) of each bucket."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b + 1) * s) / (float(a + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """A Gumbel draw in thousandths, a function of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of each row; a row without doc_id has no score."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
            n_words = n_features = weight = 0
            for words, buckets in hashed_runs(text):
                n_words += words
                n_features += len(buckets)
                weight += int(gains[buckets].sum())
            rows.append((doc_id, n_features, n_words, weight, None if doc_id is None else weight + noise(doc_id, seed)))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "n_features", "n_words", "weight", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), step, SCORED)


_ROW = ("score", "doc_id", "n_features", "weight", "times")
_ARRAYS = ", ".join(f"{c} array<bigint>" for c in _ROW)
RUNS = f"run int, block int, eligible boolean, n bigint, head_score bigint, head_id bigint, {_ARRAYS}"
PIECES = f"segment int, run int, block int, {_ARRAYS}"
RANKED = "doc_id long, n_features long, weight long, score long, rank long"


def _lists(rows: list[dict[str, list]]) -> list[pa.Array]:
    return [pa.array([r[c] for r in rows], pa.list_(pa.int64())) for c in _ROW]


def _packed(most: int):
    """A partition's sorted rows as blocks of at most ``most`` different rows; equal neighbours are one with their number."""

    def block_of(rows: list[list], run: int, block: int, kind: bool) -> pa.RecordBatch:
        held = dict(zip(_ROW, map(list, zip(*rows, strict=True)), strict=True))
        head = [pa.array([run], pa.int32()), pa.array([block], pa.int32()), pa.array([kind]), pa.array([sum(held["times"])], pa.int64()), *(pa.array([held[c][0]], pa.int64()) for c in ("score", "doc_id"))]
        return pa.RecordBatch.from_arrays([*head, *_lists([held])], ["run", "block", "eligible", "n", "head_score", "head_id", *_ROW])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, block, kind = TaskContext.get().partitionId(), 0, None
        rows: list[list] = []
        for batch in batches:
            for eligible, *row in zip(*(column(batch, c) for c in ("eligible", *_ROW[:4])), strict=True):
                if rows and kind == eligible and rows[-1][:4] == row:
                    rows[-1][4] += 1
                    continue
                if rows and (kind != eligible or len(rows) == most):
                    yield block_of(rows, run, block, kind)
                    rows, block = [], block + 1
                kind = eligible
                rows.append([*row, 1])
        if rows:
            yield block_of(rows, run, block, kind)

    return packed


def sorted_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """Each partition's rows in order (eligible first, falling score, rising doc_id), packed and written."""
    eligible = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    ordered = rows.withColumn("eligible", eligible).sortWithinPartitions(F.desc("eligible"), F.desc_nulls_last("score"), "doc_id", "weight", "n_features")
    return cut(ordered.select("eligible", *_ROW[:4]).mapInArrow(_packed(BLOCK_ROWS), RUNS), "runs")


def splitters(runs: DataFrame, rows: int) -> list[tuple[int, int]]:
    """Keys (-score, doc_id) that part the eligible rows into segments of about ``rows``, from at most 2 * PROBES blocks of each run."""
    heads = runs.where("eligible").select("run", "block", "n", "head_score", "head_id")
    length = heads.groupBy("run").agg(F.count("*").alias("blocks"), F.sum("n").alias("total"))
    step = F.greatest(F.lit(1), F.floor(F.col("blocks") / PROBES))
    probes = heads.join(length, "run").where(F.col("block") % step == 0).select((-F.col("head_score")).alias("key"), "head_id", (F.col("total") / F.ceil(F.col("blocks") / step)).alias("stands_for"))
    found, held = [], 0.0
    for key, doc_id, stands_for in sorted((r["key"], r["head_id"], r["stands_for"]) for r in probes.collect()):
        if held >= rows:
            found.append((key, doc_id))
            held = 0.0
        held += stands_for
    return sorted(set(found))


class Cuts(NamedTuple):
    """Splitters as arrays; a key belongs to the segment of the number of splitters that aren't larger."""

    keys: np.ndarray
    ids: np.ndarray

    def places(self, score: list[int], doc_id: list[int]) -> np.ndarray:
        """The segment of each row of a block, whose rows are in order."""
        key, own = -np.array(score, np.int64), np.array(doc_id, np.int64)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        return np.array([a + np.searchsorted(self.ids[a:b], i, "right") if b > a else a for a, b, i in zip(low, high, own, strict=True)], np.int64)


def _pieces(batch: pa.RecordBatch, cuts: Cuts) -> Iterator[tuple[int, int, int, dict[str, list]]]:
    """segment, run, block and rows of each piece of the batch's blocks."""
    for k in range(batch.num_rows):
        block = {c: batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("run", "block", *_ROW)}
        of = cuts.places(block["score"], block["doc_id"])
        bounds = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield int(of[a]), block["run"], block["block"], {c: block[c][a:b] for c in _ROW}


class Tournament:
    """A tree of matches between the heads of sorted runs: each node holds the winner of its two sides."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(len(runs) - 1, 0).bit_length()
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.tree = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = self._match(node)

    def _match(self, node: int) -> int:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x <= y) else b

    def __iter__(self) -> Iterator[tuple]:
        while True:
            best = self.tree[1] if self.size > 1 else 0
            row = self.heads[best]
            if row is None:
                return
            yield row
            self.heads[best] = next(self.runs[best], None)
            node = (self.size + best) >> 1
            while node:
                self.tree[node] = self._match(node)
                node >>= 1


def _of_run(pieces: list[dict[str, list]]) -> Iterator[tuple]:
    for piece in pieces:
        for score, *rest in zip(*(piece[c] for c in _ROW), strict=True):
            yield -score, *rest


def _spelled(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], pa.int64()) for k in range(5)], ["doc_id", "n_features", "weight", "score", "rank"])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _merged(base: dict[int, int], draw: int):
    """Merge each segment's runs; ranks follow from where the segment begins and end with the draw."""

    def segment(number: int, runs: dict[int, list]) -> Iterator[tuple]:
        rank = base[number]
        pieces = list(runs.values())
        for minus, doc_id, n_features, weight, times in Tournament([_of_run(p) for p in pieces]):
            for _ in range(times):
                rank += 1
                yield doc_id, n_features, weight, -minus, rank if rank <= draw else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number, runs = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("segment", "run", *_ROW)}
                if row["segment"] != number:
                    if runs:
                        yield from segment(number, runs)
                    number, runs = row["segment"], {}
                runs.setdefault(row["run"], []).append({c: row[c] for c in _ROW})
        if runs:
            yield from segment(number, runs)

    return lambda batches: _spelled(rows(batches))


def ranked_draw(runs: DataFrame, percent: int) -> DataFrame:
    """All rows of the runs with the rank of those drawn: floor(percent * N / 100) of the N eligible ones, by falling score, ties to the smaller doc_id."""
    spark = runs.sparkSession
    n = runs.where("eligible").agg(F.sum("n")).first()[0] or 0
    draw = percent * n // 100
    wanted = max(LEAST_SEGMENT, min(SEGMENT_ROWS, draw // shuffle_partitions(spark)))
    parted = splitters(runs, wanted) if draw else []
    cuts = Cuts(np.array([k for k, _ in parted], np.int64), np.array([i for _, i in parted], np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(cuts.keys) + 1, np.int64)
        for batch in batches:
            for segment, _, _, rows in _pieces(batch, cuts):
                counts[segment] += sum(rows["times"])
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["segment", "n"])

    base, at = {}, 0
    eligible = runs.where("eligible").select("run", "block", *_ROW)
    if draw:
        # a row for each segment
        for r in eligible.mapInArrow(counted, "segment int, n bigint").groupBy("segment").agg(F.sum("n").alias("n")).orderBy("segment").collect():
            if at < draw:
                base[r["segment"]] = at
            at += r["n"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for p in _pieces(batch, cuts) if p[0] in base]
            yield pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in found], pa.int32()) for k in range(3)), *_lists([p[3] for p in found])], ["segment", "run", "block", *_ROW])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                flags = column(batch, "eligible")
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1).select(["run", "block", *_ROW])
                    kept = (rows for segment, _, _, rows in _pieces(one, cuts) if segment not in base) if flags[k] else ({c: column(one, c)[0] for c in _ROW},)
                    for block in kept:
                        for score, doc_id, n_features, weight, times in zip(*(block[c] for c in _ROW), strict=True):
                            for _ in range(times):
                                yield doc_id, n_features, weight, score, None

        return _spelled(rows())

    undrawn = runs.select("run", "block", "eligible", *_ROW).mapInArrow(rest, RANKED)
    if not base:
        return undrawn
    dealt = eligible.mapInArrow(pieces, PIECES).repartition("segment").sortWithinPartitions("segment", "run", "block")
    return dealt.mapInArrow(_merged(base, draw), RANKED).unionByName(undrawn)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (null where not drawn).

    Null and empty texts have no features and weight 0.  A row without doc_id
    has no score and isn't eligible.  Repeated rows are each eligible and have
    consecutive ranks.  An empty target counts as no runs at all; an empty
    table gives an empty result.  Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    return ranked_draw(sorted_runs(scored(docs, gains, seed), min_words), percent)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return importance_resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
