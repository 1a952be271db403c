"""Streams that stop and go on, late and repeated rows, and the incremental index against a rebuild."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.streaming import index, logs

CHANGE = "path string, seq long, text string, deleted boolean"


def some_changes(rng, n):
    words = ["alpha", "beta", "gammaDelta", "snake_case", "x1", ""]
    return [(f"f{rng.randrange(12)}", k, rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(8)))]), rng.random() < 0.2) for k in range(n)]


def rebuilt(spark, changes):
    """Postings and frequencies of the last state, from scratch."""
    last = {}
    for path, seq, text, deleted in changes:
        if path not in last or (seq, deleted, text or "") > last[path]:
            last[path] = (seq, deleted, text or "")
    now = [(p, x[2]) for p, x in last.items() if not x[1]]
    rows = spark.createDataFrame(now, "path string, text string").select("path", t.tokens(F.col("text")).alias("w")).collect() if now else []
    post = {(r["path"], w): n for r in rows for w, n in Counter(r["w"]).items()}
    return post, Counter(w for _, w in post)


def state(spark, root):
    return {(r["path"], r["term"]): r["tf"] for r in index.postings(spark, root).collect()}, {r["term"]: r["df"] for r in index.frequencies(spark, root).collect()}


@pytest.mark.parametrize("cuts", [[], [15], [5, 6, 7, 22]])
def test_index_equals_a_rebuild(spark, tmp_path, cuts):
    rng = random.Random(4)
    changes = some_changes(rng, 30)
    root = f"{tmp_path}/index"
    for batch, (a, b) in enumerate(zip([0, *cuts], [*cuts, 30])):
        part = spark.createDataFrame(changes[a:b], CHANGE)
        index.apply_changes(spark, root, part, batch)
        assert state(spark, root) == rebuilt(spark, changes[:b])
        index.apply_changes(spark, root, part, batch)  # once more, as after a failure
        assert state(spark, root) == rebuilt(spark, changes[:b])
    index.compact(spark, root, f"{tmp_path}/small")
    assert state(spark, f"{tmp_path}/small") == state(spark, root)
    assert spark.read.parquet(f"{tmp_path}/small/files").count() == index.newest_files(spark, root).where("present").count()


def test_unfinished_batch_is_not_read(spark, tmp_path):
    root = f"{tmp_path}/index"
    index.apply_changes(spark, root, spark.createDataFrame([("a", 1, "one two", False)], CHANGE), 0)
    before = state(spark, root)
    # a batch that stopped before its commit
    spark.createDataFrame([("a", False)], index.TABLES["files"]).write.parquet(f"{root}/files/batch=1")
    spark.createDataFrame([("two", -1)], index.TABLES["frequencies"]).write.parquet(f"{root}/frequencies/batch=1")
    assert state(spark, root) == before
    index.apply_changes(spark, root, spark.createDataFrame([("a", 2, None, True)], CHANGE), 1)
    assert state(spark, root) == ({}, {})


def test_index_follows_a_stream(spark, tmp_path):
    changes = some_changes(random.Random(6), 24)
    source, root = f"{tmp_path}/changes", f"{tmp_path}/index"

    def arrive(a, b):
        spark.createDataFrame(changes[a:b], CHANGE).coalesce(1).write.mode("append").parquet(source)

    arrive(0, 8)
    stream = lambda: spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(source)
    index.follow(stream(), root)
    assert state(spark, root) == rebuilt(spark, changes[:8])
    index.follow(stream(), root)  # nothing new
    arrive(8, 17)
    arrive(17, 24)
    index.follow(stream(), root)
    assert state(spark, root) == rebuilt(spark, changes)
    assert index.batches(spark, root).count() == 3
    found = index.search_index(spark, root, spark.createDataFrame([(1, "where is gamma delta")], "q long, text string")).collect()
    assert all(r["score"] > 0 and (r["path"], "gamma") in state(spark, root)[0] for r in found)


EVENT = "event_id long, ts timestamp, event_type string, value double"


def events(spark, rows):
    return spark.createDataFrame([(i, at, "view", 1.0) for i, at in rows], "event_id long, at string, event_type string, value double").select("event_id", F.to_timestamp("at").alias("ts"), "event_type", "value")


def test_tail_goes_on_where_it_stopped(spark, tmp_path):
    source, folder = f"{tmp_path}/log", f"{tmp_path}/tail"
    events(spark, [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00")]).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(EVENT).parquet(source)
    assert logs.drain(stream(), "tail", folder).count() == 2
    assert logs.drain(stream(), "tail", folder).count() == 2
    events(spark, [(3, "2024-01-01 02:00:00")]).coalesce(1).write.mode("append").parquet(source)
    assert sorted(r["event_id"] for r in logs.drain(stream(), "tail", folder).collect()) == [1, 2, 3]


def test_late_rows_and_repeats_over_batches(spark, tmp_path):
    source, folder, seen = f"{tmp_path}/log", f"{tmp_path}/windows", f"{tmp_path}/seen"
    stream = lambda: spark.readStream.schema(EVENT).parquet(source)
    windows = lambda: logs.drain(logs.windowed_counts(stream(), "ts", "event_type", "1 hour", "2 hours"), "w", folder)
    unique = lambda: logs.drain(logs.without_repeats(stream(), "ts", "event_id", "10 days").select("event_id"), "u", seen)

    def arrive(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)

    arrive([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 02:30:00")])
    assert windows().count() == 0 and unique().count() == 2
    # an hour late, inside the two hours: it still counts
    arrive([(3, "2024-01-01 00:50:00"), (1, "2024-01-01 00:10:00"), (4, "2024-01-01 06:00:00")])
    got = {str(r["start"])[11:16]: r["n"] for r in windows().collect()}
    assert got == {"00:00": 3, "02:00": 1} and unique().count() == 4
    # the window at 0 is closed: a row that late is lost
    arrive([(5, "2024-01-01 00:20:00"), (6, "2024-01-01 12:00:00")])
    got = {str(r["start"])[11:16]: r["n"] for r in windows().collect()}
    assert got == {"00:00": 3, "02:00": 1, "06:00": 1} and sorted(r["event_id"] for r in unique().collect()) == [1, 2, 3, 4, 5, 6]


def test_states_are_kept_between_batches(spark, tmp_path):
    source, folder = f"{tmp_path}/log", f"{tmp_path}/states"
    schema = "run long, event_id long, ts timestamp, status string"

    def arrive(rows):
        spark.createDataFrame([(1, i, s) for i, s in rows], "run long, event_id long, status string").withColumn("ts", F.timestamp_seconds("event_id")).select("run", "event_id", "ts", "status").coalesce(1).write.mode("append").parquet(source)

    run = lambda: {(r["event_id"], r["before"]) for r in logs.drain(logs.illegal_moves(spark.readStream.schema(schema).parquet(source), "run", ["ts", "event_id"]), "s", folder).collect()}
    arrive([(1, "started"), (2, "completed")])
    assert run() == set()
    arrive([(4, "started"), (3, "open")])
    assert run() == {(3, "completed")} | ({(4, "open")} if "started" not in logs.MOVES.get("open", []) else set())


def test_words_are_counted_within_their_text_and_not_in_a_table_of_many(spark):
    from sparkloom.streaming import index

    texts = spark.createDataFrame([("a", "b a b fooBar"), ("c", ""), ("d", None), ("e", "x"), ("f", "y y Y")], "path string, text string")
    counts = index.counted(texts)
    assert sorted(map(tuple, counts.collect())) == [("a", "a", 1), ("a", "b", 2), ("a", "bar", 1), ("a", "foo", 1), ("a", "foobar", 1), ("e", "x", 1), ("f", "y", 3)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
