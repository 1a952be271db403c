"""Token ids as coded files, and back (operator 4).

Documents are range-partitioned by doc_id and sorted; each partition encodes
its texts and writes rows of whole consecutive documents: their ids, lengths
and offsets in the partition, and the blocks that the range coder made of their
joined ids, each with its size and crc32.  The rows are a Spark table in the
shared folder, so a lost executor loses nothing, and each row decodes by
itself.  Reading back checks every block.

Tokenising goes by chunks between blanks, which no rule of the tokenizer
crosses; a worker remembers the ids of chunks, CACHE_BYTES of them.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, small_batches
from .range_coder import BLOCK, LANES, decode_blocks, encode_blocks

END_ID = 2
CACHE_BYTES = 24 << 20  # of strings, ids and a dictionary entry for each
SLICE = 1000  # rows whose chunks are Python objects at once
ENTRY = 200  # bytes that an entry takes besides its letters and ids
LONG = 64
#: A row of a file holds whole documents of about so many ids.
ROW_IDS = 64 * BLOCK
FILE = "part int, doc_ids array<long>, offsets array<long>, lengths array<int>, sizes array<int>, crcs array<long>, blocks array<binary>"

_CHUNK = re.compile(r"[^ \n\t\r]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Chunks:
    """Ids of chunks of text as uint16, remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        if self.own.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.known: dict[str, bytes] = {}
        self.size = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [_CHUNK.findall(t) for t in texts]
        known = self.known
        new = list({c for p in parts for c in p if c not in known})
        if self.size + sum(map(len, new)) + ENTRY * len(new) > CACHE_BYTES:
            known.clear()
            self.size = 0
            new = list({c for p in parts for c in p})
        coded = self.own.encode_batch_fast(new, add_special_tokens=False)
        short = {c: np.array(e.ids, "<u2").tobytes() for c, e in zip(new, coded, strict=True)}
        known.update(short)
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for c, ids in short.items():
            if len(c) > LONG:
                del known[c]
            else:
                self.size += len(c) + len(ids) + ENTRY
        return out


@lru_cache(maxsize=1)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def _rows(ready: list[tuple], part: int) -> pa.RecordBatch:
    """Rows of (doc_ids, offsets, lengths, joined ids): all their blocks are coded at once."""
    blocks, counts = [], []
    for _, _, _, ids in ready:
        own = [ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK)]
        blocks += own
        counts.append(len(own))
    coded = encode_blocks(blocks)
    at = np.concatenate([[0], np.cumsum(counts)])
    spans = list(zip(at[:-1], at[1:], strict=True))
    sizes, crcs = [len(b) for b in blocks], [zlib.crc32(b.astype("<u2").tobytes()) for b in blocks]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(ready), pa.int32()), pa.array([r[0] for r in ready], pa.list_(pa.int64())), pa.array([r[1] for r in ready], pa.list_(pa.int64())), pa.array([r[2] for r in ready], pa.list_(pa.int32())),
            pa.array([sizes[a:b] for a, b in spans], pa.list_(pa.int32())), pa.array([crcs[a:b] for a, b in spans], pa.list_(pa.int64())), pa.array([coded[a:b] for a, b in spans], pa.list_(pa.binary())),
        ],
        [f.split()[0] for f in FILE.split(", ")],
    )


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The files' rows in ascending doc_id order by (part, offset): see FILE.

    Null text counts as empty and gives the end id alone.  Rows with equal
    doc_id follow each other, by text; null ids come first.  An empty table
    gives no rows; other columns are ignored.  A text of any length is one
    stretch of ids: its task holds them, two bytes each, and their blocks.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start = chunks(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        ready, queued = [], 0
        ids, offsets, lengths, raw, size = [], [], [], [], 0

        def close() -> None:
            nonlocal ids, offsets, lengths, raw, size, queued
            ready.append((ids, offsets, lengths, np.frombuffer(b"".join(raw), "<u2")))
            queued += size
            ids, offsets, lengths, raw, size = [], [], [], [], 0

        slices = (batch.slice(k, SLICE) for batch in batches for k in range(0, batch.num_rows, SLICE))
        for batch in slices:
            for doc_id, coded in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                offsets.append(start)
                lengths.append(len(coded) // 2 + 1)
                raw += (coded, end)
                start, size = start + lengths[-1], size + lengths[-1]
                if size >= ROW_IDS:
                    close()
                if queued >= LANES * BLOCK:
                    yield _rows(ready, part)
                    ready, queued = [], 0
        if ids:
            close()
        if ready:
            yield _rows(ready, part)

    small_batches(docs.sparkSession)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, FILE), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian uint16) and ids_crc32 (of the ids as little-endian
    uint32) of each document; a bad block fails, no rows give no documents."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, crcs, blocks = (batch.column(k).to_pylist() for k in (4, 5, 6))
        decoded = decode_blocks([b for row in blocks for b in row], [s for row in sizes for s in row])
        want = [c for row in crcs for c in row]
        raw = [b.astype("<u2").tobytes() for b in decoded]
        if any(zlib.crc32(b) != c for b, c in zip(raw, want, strict=True)):
            raise ValueError("a block's checksum is wrong")
        doc_ids, offsets, lengths, ids, k = [], [], [], [], 0
        for row in range(batch.num_rows):
            n = len(sizes[row])
            data, at = b"".join(raw[k : k + n]), 0
            k += n
            own = batch.column(3)[row].as_py()
            doc_ids += batch.column(1)[row].as_py()
            offsets += batch.column(2)[row].as_py()
            lengths += own
            for m in own:
                ids.append(data[2 * at : 2 * (at + m)])
                at += m
        crcs_ = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids]
        parts = np.repeat(batch.column(0).to_numpy(), [len(x) for x in batch.column(3)])
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(crcs_, pa.int64())], ["part", "doc_id", "offset", "n_tokens", "ids", "ids_crc32"])

    totals = files.select("part", F.element_at("offsets", -1).alias("o"), F.element_at("lengths", -1).alias("l")).groupBy("part").agg(F.max(F.col("o") + F.col("l")).alias("total"))
    # one row a partition
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    docs = map_arrow(files, step, "part int, doc_id long, offset long, n_tokens long, ids binary, ids_crc32 long", LANES * BLOCK // ROW_IDS)
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids", "ids_crc32")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "start", "n_tokens", "ids_crc32")
