import random

import numpy as np
import sentencepiece

from sparkloom.llm import pieces as p

TEXTS = ["Plain words, and more words.", "  two  spaces \n\nand lines\n", "é ü ñ 漢字 🙂", "▁ mark▁", "\x00 zero ▁\x00", " ", "\n", "", "a" * 5000, "x" * 100 + " tail", "tab\tand\rreturn"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=p.default_model())


def ids(own, text, doc, seed, rate):
    return own.encode([text], [doc], seed, rate)[0].tolist()


def mixed(x):
    return int(p.mix64(np.array([x & p._MASK], np.uint64))[0])


def plain(own, text, doc, seed, rate):
    """The dropout agenda one chunk and one candidate at a time."""
    key, out = p.xxhash.xxh3_64_intdigest(f"{seed}:{doc}" if doc is not None else f"{seed}::{text}"), []
    for k, chunk in enumerate(p._CHUNK.findall(" " + text) if text else [], 1):
        base = mixed(key + k * p._STEP)
        parts = [["\ud800" if c == "▁" else "▁" if c == " " else c, at] for at, c in enumerate(chunk)]
        skipped = set()
        while True:
            found = [(own.order[a[0] + b[0]], a[1], n) for n, (a, b) in enumerate(zip(parts, parts[1:])) if a[0] + b[0] in own.order and (a[1], a[0], b[0]) not in skipped]
            if not found:
                break
            _, at, n = min(found)
            left, right = parts[n][0], parts[n + 1][0]
            if (base ^ own.rank[left + right] * p._BY_RANK & p._MASK ^ at * p._BY_PLACE & p._MASK) * p._MIX >> 32 & 0xFFFFFFFF < int(rate * (1 << 32)):
                skipped.add((at, left, right))
            else:
                parts[n : n + 2] = [[left + right, at]]
        for piece, _ in parts:
            out += [own.rank[piece]] if piece in own.rank else [own.byte[b] for b in ("▁" if piece == "\ud800" else piece).encode()]
    return out


def test_without_dropout_as_the_library():
    own, lib = p.pieces(p.default_model()), library()
    rng = random.Random(4)
    texts = [t for t in TEXTS if "▁" not in t] + ["".join(rng.choice("the an iné ou,.\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert ids(own, t, 0, 1, 0.0) == lib.encode(t), t


def test_dropout_varies_and_is_lossless(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, None, "x"), (0, TEXTS[0], "y")], "doc_id long, text string, ids string")
    seen = {}
    for seed in (1, 2):
        for rate in (0.1, 0.5, 1.0):
            got = p.decode(p.encode(docs, seed=seed, dropout=rate)).collect()
            assert len(got) == len(TEXTS) * 3 + 2 and all(r["decoded"] == r["text"] and r["n_tokens"] == len(r["ids"]) for r in got)
            seen[seed, rate] = sorted((r["doc_id"], tuple(r["ids"])) for r in got if r["doc_id"] is not None)
    assert seen[1, 0.5] != seen[2, 0.5] and sum(len(x) for _, x in seen[1, 0.1]) < sum(len(x) for _, x in seen[1, 0.5]) < sum(len(x) for _, x in seen[1, 1.0])
    again = p.encode(docs, seed=1, dropout=0.5).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in again if r["doc_id"] is not None) == seen[1, 0.5]
    assert p.decode(p.encode(docs.limit(0))).count() == 0


def test_library_reads_the_ids():
    own, lib = p.pieces(p.default_model()), library()
    for t in TEXTS:
        if "▁" not in t:
            assert lib.decode(ids(own, t, 2, 9, 0.3)) == t


def test_dropout_as_a_plain_agenda(monkeypatch):
    own, rng = p.pieces(p.default_model()), random.Random(9)
    texts = [t[:700] for t in TEXTS] + ["".join(rng.choice("the an iné ou,.\n▁漢") for _ in range(rng.randrange(200))) for _ in range(60)] + ["merging words " * 30, "b" * 63 + " " + "ing" * 22, " " * 90 + "x" + " " * 70]
    docs = [None if k % 7 == 0 else k for k in range(len(texts))]
    for window in (p.WINDOW, 64):  # long texts go in parts, with the same result
        monkeypatch.setattr(p, "WINDOW", window)
        for rate in (0.0, 0.1, 0.6, 1.0):
            got, sizes = own.encode(texts, docs, 5, rate)
            want = [plain(own, t, d, 5, rate) for t, d in zip(texts, docs, strict=True)] if window > 64 else want_by_rate[rate]
            assert sizes.tolist() == [len(w) for w in want]
            assert got.tolist() == [i for w in want for i in w]
            if window > 64:
                want_by_rate = locals().get("want_by_rate", {}) | {rate: want}


def test_each_occurrence_has_its_own_draw():
    own = p.pieces(p.default_model())
    text = " ".join(["merging"] * 400)
    first, again, other, none = (ids(own, text, d, 7, 0.1) for d in (1, 1, 2, None))
    assert first == again and len({*map(tuple, (first, other, none, ids(own, text, 1, 8, 0.1)))}) == 4
    said = "|".join(own.surface[i].decode() for i in first)
    assert len({w.strip("|") for w in said.split(" ")[1:]}) > 4
    # two merges make " th": each is skipped at the rate
    kept = ids(own, "th", 0, 0, 0.0)
    share = sum(ids(own, "th", k, 7, 0.1) == kept for k in range(4000)) / 4000
    assert 0.81 - 0.03 < share < 0.9 + 0.03


def test_query_against_the_library(spark, tmp_path):
    """op2's query on a small table: its ids are those of a plain agenda, and decode to the text."""
    import zlib

    rows = [(k, t[:700], "en", "s", len(t)) for k, t in enumerate([*TEXTS, "more plain words to merge"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    own = p.pieces(p.default_model())
    got = {r["doc_id"]: r for r in p.op2_sentencepiece(spark, str(tmp_path)).collect()}
    for k, t, *_ in rows:
        want = plain(own, t, k, p.SEED, p.DROPOUT)
        assert got[k]["lossless"] and got[k]["n_tokens"] == len(want) and got[k]["ids_crc32"] == zlib.crc32(",".join(map(str, want)).encode())
