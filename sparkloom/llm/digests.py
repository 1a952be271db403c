"""Document fingerprints by quartile bucket digests (operator 12).

All byte triplets of a text are hashed into ``BUCKETS`` counters; the digest has,
for each bucket, how many of the three quartiles of all counts it exceeds (two
bits), and the text's length on a logarithmic scale.  Two digests are compared
by the sum of their buckets' differences, held against what two unrelated
digests with as many buckets of each kind would differ by, and by their lengths.

Neighbours in the order of doc_id are found by one range shuffle and one
streaming pass that holds the text before; the texts at partitions' edges, two
each, are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, map_arrow, mix64, small_batches

BUCKETS = 1024
PIECE = 1 << 20  # bytes hashed at once
LENGTH_STEPS, OCTAVES, LENGTH_SHARE = 8, 4, 0.15

_STEP = np.abs(np.arange(4)[:, None] - np.arange(4)[None, :])


def codes(text: bytes) -> np.ndarray:
    """One small integer for each bucket, 0 to 3, and last the length's."""
    counts = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(len(data) - 2, 0), PIECE):
        part = data[at : at + PIECE + 2].astype(np.uint64)
        triplets = part[:-2] | part[1:-1] << np.uint64(8) | part[2:] << np.uint64(16)
        counts += np.bincount((mix64(triplets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    quartiles = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    return np.append((counts[:, None] > quartiles).sum(1), round(LENGTH_STEPS * np.log2(1 + len(data))))


def written(code: np.ndarray) -> bytes:
    """The digest: a byte for the length, then two bits a bucket."""
    four = code[:BUCKETS].reshape(-1, 4)
    return bytes([int(code[BUCKETS])]) + (four @ (1, 4, 16, 64)).astype(np.uint8).tobytes()


def read(digest: bytes) -> np.ndarray:
    packed = np.frombuffer(digest, np.uint8).astype(np.int64)
    return np.append((packed[1:, None] >> np.array([0, 2, 4, 6]) & 3).ravel(), packed[0])


def spelled(digest: str) -> Column:
    """The digest's bytes as lower-case hexadecimal digits."""
    return F.lower(F.hex(digest)).alias(digest)


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """0 for equal digests, 1 at most: what unrelated texts of very different lengths come to."""
    x, y = a[:BUCKETS], b[:BUCKETS]
    unrelated = np.bincount(x, minlength=4) @ _STEP @ np.bincount(y, minlength=4) / BUCKETS
    body = min(float(np.abs(x - y).sum() / unrelated), 1.0) if unrelated else 0.0
    length = min(abs(int(a[BUCKETS]) - int(b[BUCKETS])) / (LENGTH_STEPS * OCTAVES), 1.0)
    return (1 - LENGTH_SHARE) * body + LENGTH_SHARE * length


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint.  Null texts count as empty; equal texts have equal fingerprints; other columns are ignored."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [written(codes(text or b"")) for text in column(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["doc_id", "fingerprint"])

    done = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), step, "doc_id long, fingerprint binary")
    return done.select("doc_id", spelled("fingerprint"))


def n_points(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(text) if text.isascii() else int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def offset(text: bytes, points: int) -> int:
    """The byte at which code point number ``points`` begins, or the end."""
    if text.isascii():
        return min(points, len(text))
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), PIECE):
        begins = np.flatnonzero(data[at : at + PIECE] & 0xC0 != 0x80)
        if points < len(begins):
            return at + int(begins[points])
        points -= len(begins)
    return len(text)


def edited(text: bytes, other: bytes) -> bytes:
    """The last quarter of the code points, rounded down, replaced by the first as many of ``other``."""
    n = n_points(text)
    return text[: offset(text, n - n // 4)] + other[: offset(other, n // 4)]


PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGE = f"{PAIR}, part int, edge int, text binary"
FIRST, LAST = 1, 2


def _compared(doc_id: int | None, text: bytes, code: np.ndarray, other: bytes, other_code: np.ndarray) -> tuple:
    changed = edited(text, other)
    after = codes(changed)
    return doc_id, n_points(text), hashlib.sha256(changed).hexdigest(), written(code), written(after), likeness(code, after), likeness(code, other_code)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all texts but the partition's last, and its first and last text for the join of the edges."""
    part, held = TaskContext.get().partitionId(), None
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def edge(which: int) -> tuple:
        return held[0], None, None, None, None, None, None, part, which, held[1]

    for batch in batches:
        rows = []
        for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
            now = doc_id, text, codes(text)
            if held:
                rows.append((*_compared(*held, *now[1:]), part, 0, None))
            else:
                held = now
                rows.append(edge(FIRST))
            held = now
        if rows:
            yield batch_of(rows)
    if held:
        yield batch_of([edge(LAST)])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to the edited and to the next document.

    The edited text has the last floor(n_chars / 4) code points replaced by the
    first as many of the next document; next is by ascending doc_id, after the
    last comes the first, and a single document is its own next.  Rows without
    doc_id come first; equal doc_ids go by the hash of their texts.  Null texts
    count as empty and come back as 0 code points.  Repeated rows count each.
    An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    found = cut(ordered.select("doc_id", "text").mapInArrow(_neighbours, _EDGE), "neighbours")
    # one number for each partition that has rows
    parts = found.where(F.col("edge") == FIRST).select("part")
    ranked = parts.select("part", F.row_number().over(Window.orderBy("part")).alias("k"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
    edges = found.where("edge > 0").join(F.broadcast(ranked), "part")
    last = edges.where(F.col("edge") == LAST).select("doc_id", "text", (F.col("k") % F.col("n") + 1).alias("k"))
    first = edges.where(F.col("edge") == FIRST).select("k", F.col("text").alias("other"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [_compared(i, a, codes(a), b, codes(b)) for i, a, b in zip(*(column(batch, c) for c in ("doc_id", "text", "other")), strict=True)]
        types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in PAIR.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names)

    stitched = map_arrow(last.join(first, "k").select("doc_id", "text", "other"), step, PAIR)
    done = found.where(F.col("edge") == 0).drop("part", "edge", "text").unionByName(stitched)
    # digests are written as bytes, half as large as their digits
    return done.select("doc_id", "n_chars", "edited_sha256", spelled("fingerprint"), spelled("edited_fingerprint"), "near_edited", "near_next")


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
