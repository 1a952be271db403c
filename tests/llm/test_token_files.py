import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import range_coder, token_files as tf


@pytest.mark.parametrize("seed", range(4))
def test_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    blocks = [(rng.zipf(1.2, rng.integers(0, 900)) % 65536).astype(np.uint16) for _ in range(40)]
    blocks += [rng.integers(0, 65536, 400).astype(np.uint16), np.full(700, 65535, np.uint16), np.tile([7, 8, 9], 300).astype(np.uint16), np.empty(0, np.uint16)]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[-2]) < 200  # what repeats costs little
    # blocks are independent: one alone decodes to the same
    assert (range_coder.decode_blocks([coded[3]], [len(blocks[3])])[0] == blocks[3]).all()


def test_files_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(tf, "ROW_IDS", 50)
    rng = random.Random(8)
    pool = ["the Word's", "É", "áb", "12", "\x1c", "<|endoftext|>", "x'll", "don't", "tail.", "漢字", " ", "...", "ΑΣ", "\n\n", "  "]
    rows = [(i * 3 % 101, " ".join(rng.choice(pool) for _ in range(rng.randrange(30))) if i % 9 else None, "x") for i in range(101)] + [(500, "word " * 20_000, "x"), (7, "again", "x"), (7, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(6)
    files = tf.write_token_files(docs)
    got = {}
    for r in tf.read_token_files(files).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u2").tolist()))
    lib, start = Tokenizer.from_file(tf.default_tokenizer()), 0
    for i, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        assert (start, len(ids), ids) in got[i], text
        start += len(ids)
    assert sum(map(len, got.values())) == len(rows)
    assert tf.read_token_files(tf.write_token_files(docs.limit(0))).count() == 0


def test_damage_is_found(spark):
    files = tf.write_token_files(spark.createDataFrame([(1, "some words of note")], "doc_id long, text string"))
    bad = files.selectExpr("part", "doc_ids", "offsets", "lengths", "sizes", "transform(crcs, c -> c + 1) AS crcs", "blocks")
    with pytest.raises(Exception, match="checksum"):
        tf.read_token_files(bad).collect()


def test_query_against_the_library(spark, tmp_path):
    """The contract's columns of the query itself, read back from the files."""
    import struct
    import zlib

    rng = random.Random(4)
    rows = [(i * 7 % 60, " ".join(rng.choice(["The", "word's", "Éa", "12", "<|endoftext|>", "\n"]) for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, ""), (62, "long " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in tf.op4_token_files(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    lib, start, want = Tokenizer.from_file(tf.default_tokenizer()), 0, []
    for i, text in sorted(rows):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
