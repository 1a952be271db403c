"""Line de-duplication with a sharded minimal perfect hash (operator 5).

1. One Arrow pass turns each text into the 128-bit hashes of its line keys;
   a keyed aggregation with map-side combine counts documents and finds the
   largest doc_id for each distinct hash.
2. All distinct hashes are dealt into shards.  Each shard becomes a minimal perfect hash (levels of collision-free bits, rank by
   popcount) that indexes flat arrays: 64-bit fingerprint, count, keeper.
3. The documents' hashes are dealt to the shards and probe the arrays in numpy
   blocks.  A shard whose lines are frequent is replicated and its probes
   salted by doc_id in proportion to its counts, so no task gets a hot line.
4. The few hits go back to their documents, which drop the lines.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ASCII_SPACE, column, cut, discard, map_arrow, mix64, restored, shuffle_partitions, with_rest

MIN_DOCS, MIN_CHARS = 5, 40
#: Rows a probe group aims at; shards are sized from it.
GROUP_ROWS = 1 << 18
LEVELS, GAMMA = 20, 2.0
NO_ID = -(1 << 63)  # stands for a null doc_id: below all others
SHARD = "shard int, load long, level_bits array<int>, bits binary, fingerprints binary, counts binary, keepers binary, spare binary"


def line_key(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).lower()


def _hash(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None for keys that are too short to count."""
    key = line_key(line)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, h1, h2: each row's distinct hashes of line keys."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for i, text in zip(column(batch, "id"), column(batch, "text"), strict=True):
            own = {h for line in (text or b"").split(b"\n") if (h := _hash(line, min_chars))}
            ids += [i] * len(own)
            found += own
        pairs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "h1", "h2"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, step, "id long, h1 long, h2 long")


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits, the rank of each key and the keys left over (ranked last)."""
    sizes, bits, place = [], [], np.full(len(keys), -1, np.int64)
    open_, offset = np.arange(len(keys)), 0
    for level in range(LEVELS):
        if not len(open_):
            break
        size = max(8, math.ceil(len(open_) * GAMMA / 8) * 8)
        slot = _slots(keys[open_], level, size)
        alone = np.bincount(slot, minlength=size) == 1
        hit = alone[slot]
        place[open_[hit]] = offset + slot[hit]
        sizes.append(size)
        bits.append(alone)
        open_, offset = open_[~hit], offset + size
    all_bits = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(all_bits) - 1
    order = np.where(place >= 0, rank[place] if len(rank) else 0, 0)
    order[open_] = int(all_bits.sum()) + np.arange(len(open_))
    return sizes, all_bits, order, open_


def probe_index(keys: np.ndarray, sizes: list[int], bits: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The rank of each key; some rank or -1 for keys that are not in the index."""
    rank, out, open_, offset = np.cumsum(bits) - 1, np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(open_):
            return out
        at = offset + _slots(keys[open_], level, size)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, offset = open_[~hit], offset + size
    if len(spare) and len(open_):
        order = np.argsort(spare, kind="stable")
        at = np.minimum(np.searchsorted(spare[order], keys[open_]), len(spare) - 1)
        hit = spare[order][at] == keys[open_]
        out[open_[hit]] = int(bits.sum()) + order[at[hit]]
    return out


def _index_key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h1.view(np.uint64)) ^ (h2.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    h1, h2 = table["h1"].to_numpy(), table["h2"].to_numpy()
    keys = _index_key(h1, h2)
    sizes, bits, order, left = build_index(keys)
    count, keeper = table["n_docs"].to_numpy(), table["keeper"].to_numpy()

    def laid(values: np.ndarray) -> bytes:
        out = np.empty_like(values)
        out[order] = values
        return out.tobytes()

    columns = [[key[0].as_py()], [int(count.sum())], [sizes], [np.packbits(bits).tobytes()], [laid(h2)], [laid(count.astype("<i8"))], [laid(keeper)], [keys[left].tobytes()]]
    return pa.table(dict(zip(("shard", "load", "level_bits", "bits", "fingerprints", "counts", "keepers", "spare"), columns, strict=True)), schema=_SHARD_ARROW)


_SHARD_ARROW = pa.schema([("shard", pa.int32()), ("load", pa.int64()), ("level_bits", pa.list_(pa.int32())), *((n, pa.binary()) for n in ("bits", "fingerprints", "counts", "keepers", "spare"))])
_HITS = pa.schema([("id", pa.int64()), ("hash", pa.binary())])


def _probe_shard(min_docs: int):
    def probe(probes: pa.Table, shards: pa.Table) -> pa.Table:
        if not probes.num_rows or not shards.num_rows:
            return _HITS.empty_table()
        shard = shards.slice(0, 1).to_pylist()[0]
        ids, h1, h2 = (probes[c].to_numpy() for c in ("id", "h1", "h2"))
        bits = np.unpackbits(np.frombuffer(shard["bits"], np.uint8), count=sum(shard["level_bits"])).astype(bool)
        at = probe_index(_index_key(h1, h2), shard["level_bits"], bits, np.frombuffer(shard["spare"], np.uint64))
        prints, counts, keepers = (np.frombuffer(shard[c], "<i8") for c in ("fingerprints", "counts", "keepers"))
        hit = (at >= 0) & (prints[at] == h2) & (counts[at] >= min_docs) & (keepers[at] != ids)
        raw = np.ascontiguousarray(np.stack([h1[hit], h2[hit]], 1)).tobytes()
        return pa.table({"id": ids[hit], "hash": pa.array([raw[k : k + 16] for k in range(0, len(raw), 16)], pa.binary())}, schema=_HITS)

    return probe


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per input row: doc_id, text (lines that stay), n_lines, n_dropped, rest (a struct of the other columns).

    A line's key is the line without ASCII white space at both ends and with
    A-Z lower-cased.  Keys of at least ``min_chars`` code points in at least
    ``min_docs`` documents lose all their lines except in the largest doc_id
    that holds it.  Null text counts as one empty line.  Rows that share a
    doc_id are one document and are cut alike; rows without one count for no
    document and lose what others keep.  Repeated lines in one text count once
    and go or stay together.
    """
    spark = docs.sparkSession
    hashes = cut(line_hashes(docs, min_chars), "line-hashes")
    n_hashes = hashes.count()
    shards_n = 4 * max(shuffle_partitions(spark), math.ceil(n_hashes / GROUP_ROWS))
    in_shard = F.pmod(F.xxhash64("h1"), F.lit(shards_n)).cast("int").alias("shard")
    once = hashes.dropDuplicates(["h1", "h2", "id"])
    counted = once.groupBy("h1", "h2").agg(F.count_if(F.col("id") != NO_ID).alias("n_docs"), F.max("id").alias("keeper"))
    shards = cut(counted.select(in_shard, "h1", "h2", "n_docs", "keeper").groupBy("shard").applyInArrow(_build_shard, SHARD), "line-shards")

    fair = max(64, math.ceil(n_hashes / shards_n))  # a shard's even share of the probes
    salts = F.greatest(F.ceil(F.col("load") / F.lit(fair)).cast("int"), F.lit(1))
    loads = shards.select("shard", salts.alias("salts"))
    probes = hashes.select("*", in_shard).join(loads, "shard").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    copies = shards.select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hits = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_probe_shard(min_docs), "id long, hash binary")
    cuts = cut(hits.groupBy("id").agg(F.collect_set("hash").alias("cuts")), "line-cuts")
    discard(hashes, shards)

    rows = with_rest(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    # cuts grow with the documents: the join that holds at any size, at each size
    joined = rows.join(cuts.hint("merge"), "id", "left").drop("id")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, n_lines, n_dropped = [], [], []
        for text, gone in zip(column(batch, "text"), column(batch, "cuts"), strict=True):
            lines = (text or b"").split(b"\n")
            if gone:
                gone = set(gone)
                stay = [line for line in lines if _hash(line, min_chars) not in gone]
            else:
                stay = lines
            kept.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        arrays = [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), batch.column(batch.schema.get_field_index("rest"))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_lines", "n_dropped", "rest"])

    out = StructType.fromDDL("doc_id long, text string, n_lines long, n_dropped long").add(joined.schema["rest"])
    return map_arrow(joined, step, out)


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with their columns, repeated lines dropped; n_chars, where there is one, follows the text."""
    return restored(drop_lines(docs, min_docs, min_chars), docs)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)
), f AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM l LEFT JOIN f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
