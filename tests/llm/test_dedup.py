import random

from sparkloom.llm import exact_dedup, line_dedup


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Same", "same", "sAme", "é", "É", "", None, "x" * 100_000, f"own {i}"]), i) for i in range(300)] + [(7, "twice", 1), (7, "twice", 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(7)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(low(text), []).append(i)
    want = sorted(((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)])) for i, t, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_group_over_many_partitions(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 10 = 0, concat('own ', id), 'copy') AS text")
    got = exact_dedup.exact_dedup(docs)
    assert got.where("kept").count() == 501 and got.where("group_size = 4500").count() == 4500


def brute_lines(rows, min_docs, min_chars):
    space, seen = " \t\n\x0b\x0c\r", {}
    for i, text in rows:
        for line in set(low(x.strip(space)) for x in (text or "").split("\n")):
            if len(line) >= min_chars:
                seen.setdefault(line, []).append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(held := seen.get(low(x.strip(space)), [])) >= min_docs and max(held) != i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    pool = ["a common line", " A COMMON line\t", "éééééé", "rare", "", "tail \x0b"] + [f"line number {k}" for k in range(20)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, rest string, n_chars int")
    done = line_dedup.drop_lines(docs, 5, 6)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in done.collect()) == brute_lines(rows, 5, 6)
    out = line_dedup.line_dedup(docs, 5, 6)
    assert out.columns == docs.columns and out.where("n_chars <> length(text) or rest <> 'x'").count() == 0
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_without_ids_and_with_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a line of note")] * 3 + [(4, "a line of note")] * 2 + [(2, "A line of note ")], "doc_id long, text string")
    # two documents hold the line: rows without an id are none, rows of one id are one
    run = lambda least: sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.drop_lines(docs, least, 6).collect())
    assert run(3) == [(0, "a line of note")] * 3 + [(2, "A line of note ")] + [(4, "a line of note")] * 2
    assert run(2) == [(0, "")] * 3 + [(2, "")] + [(4, "a line of note")] * 2


def test_minimal_perfect_hash():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    keys[:3] = keys[3]  # equal keys can't be told apart by any level
    sizes, bits, order, left = line_dedup.build_index(keys)
    assert sorted(order) == list(range(5000))
    at = line_dedup.probe_index(keys[4:], sizes, bits, keys[left])
    assert (at == order[4:]).all()


def test_texts_meet_cuts_by_the_same_join_at_any_size(spark):
    docs = spark.createDataFrame([(k, f"{'a line that many documents hold ' * 2}\n{k}") for k in range(8)], "doc_id long, text string")
    done = line_dedup.drop_lines(docs)
    plan = done._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r["doc_id"], r["n_dropped"]) for r in done.collect()) == [(k, int(k < 7)) for k in range(8)]
