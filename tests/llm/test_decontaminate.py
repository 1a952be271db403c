import random
import re


from sparkloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(texts, items, window):
    wins = []
    for name, text in items:
        words = WORD.findall(low(text))
        if len(words) >= window:
            wins += [(name, tuple(words[i : i + window])) for i in range(len(words) - window + 1)]
        elif words:
            wins.append((name, tuple(words)))
    out = {}
    for doc_id, text in texts:
        words, hit, names = WORD.findall(low(text)), set(), set()
        for name, win in wins:
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    names.add(name)
        out[doc_id] = (len(words), len(hit), sorted(map(str, names)))
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def found(rows):
    return {r["doc_id"]: (r["n_words"], sum(e - s for s, e in r["spans"]), list(r["items"])) for r in rows}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["ab", "Cd", "é", "x1", "zz"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 5, 9])))) for i in range(12)] + [(3, "ab Cd"), (99, None)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)] + [(100, None), (101, "")]
    docs, bench = frame(spark, texts, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    want = brute(texts, items, 4)
    assert found(d.find_spans(docs, bench, 4).collect()) == want
    monkeypatch.setattr(d, "SHARD_BYTES", 40)  # several automata
    assert found(d.find_spans(docs, bench, 4).collect()) == want


def test_removal_keeps_columns_and_clean_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before, {item.upper()}! After all these other words there is nothing left to see here.", "a", 7), (2, "clean text", "b", 8), (3, item, "c", 9), (None, None, None, None)]
    docs = frame(spark, rows, "doc_id long, text string, items string, n_words long")
    bench = frame(spark, [(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in d.decontaminate(docs, bench).collect()}
    assert set(out) == {1, 2, None} and out[2]["text"] == "clean text" and out[2]["items"] == "b"
    assert out[1]["text"] == "Before, ! After all these other words there is nothing left to see here."
    assert d.decontaminate(docs.limit(0), bench).count() == 0 and d.decontaminate(docs, bench.limit(0)).count() == 4


def test_long_text(spark):
    text = "word " * 200_000
    docs = frame(spark, [(1, text)], "doc_id long, text string")
    bench = frame(spark, [(1, "word " * 12)], "item_id long, text string")
    row = d.find_spans(docs, bench).first()
    assert row["n_words"] == 200_000 and row["spans"] == [[0, 200_000]]


def test_query_against_brute_force(spark, tmp_path):
    """The contract's columns of the query itself, on odd tables."""
    import hashlib

    rng = random.Random(11)
    words = [f"w{k}" for k in range(30)] + ["É", "x1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(3, items[3][1]), (50, items[9][1].upper()), (51, None), (None, items[20][1])]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60))) + " " + rng.choice(items)[1].replace(" ", ", ") if i % 3 else "plain text") for i in range(60)]
    texts += [(100, None), (101, ""), (5, texts[5][1])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in d.op7_decontamination(spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    want = []
    for i, text in texts:
        n, hit, names = brute([(i, text)], items, 10)[i]
        names = sorted(x for x in names if x != "None")
        want.append((i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
    assert got == sorted(want)


def test_many_equal_short_items():
    import time

    began = time.perf_counter()
    items = [(f"a{k}", [b"two", b"words"]) for k in range(20_000)] + [(f"b{k}", [b"n%d" % k, b"two", b"words", b"m%d" % k]) for k in range(20_000)]
    automaton = d.Automaton(items)
    spans, names, longest = automaton.scan([b"two", b"words", b"x"] * 20_000)
    assert len(names) == 20_000 and len(spans) == 20_000 and longest == 2
    assert time.perf_counter() - began < 20
