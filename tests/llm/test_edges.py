"""Odd tables through every pipeline stage, and the opN queries against their SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from sparkloom.llm import entries, exact_dedup, features, jaccard_join, line_dedup, pieces, pii, token_files, toxicity

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, `odd name.x` int, rest string, cuts string, `__gone` int, gone string, spans int"
LONG = "a plain sentence about nothing in particular that goes on for a while\n" * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    common = "this line of text is shared by many documents of the table"
    rows = [(k, f"{common}\nand document {k} says what no other does: {'word%d ' % k * 9}", "en", "s", 9, k, "r", "c", 1, "g", 2) for k in range(8)]
    rows += [rows[3], rows[3], (None, common, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rows += [(20, None, "en", "s", None, 1, "r", "c", 1, "g", 2), (21, "", "en", "s", 0, 1, "r", "c", 1, "g", 2), (22, LONG, "de", None, len(LONG), 1, "r", "c", 1, "g", 2), (23, " \n\t", "de", "s", 3, 1, "r", "c", 1, "g", 2)]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_tables(spark, odd, name, stage):
    done = stage(spark, odd, SF)
    rows = done.collect()
    assert stage(spark, odd.limit(0), SF).count() == 0
    ids = [r["doc_id"] for r in rows]
    if name == "sentencepiece":
        assert len(rows) == odd.count() and all(r["lossless"] for r in rows)
        return
    assert done.columns == odd.columns
    if name != "quality":
        assert set(range(8)) <= set(ids) and {20, 21, 22, 23} <= set(ids) and ids.count(None) == 2
    for r in rows:
        if r["doc_id"] in range(8):
            assert r["odd name.x"] == r["doc_id"] and (r["rest"], r["cuts"], r["__gone"], r["gone"], r["spans"]) == ("r", "c", 1, "g", 2)
    if name == "line_dedup":
        kept = {r["doc_id"]: r["text"] for r in rows}
        assert all(("shared by many" in kept[k]) == (k == 7) for k in range(8)) and ids.count(3) == 3 and len(kept[22]) == len(LONG)
    if name == "ngram_jaccard":
        assert ids.count(3) == 1
    if name == "decontamination":
        assert ids.count(3) == 3 and next(r["text"] for r in rows if r["doc_id"] == 22) == LONG


def test_operators_on_odd_tables(spark, odd):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    n = odd.count()
    assert toxicity.score_toxicity(odd, labels).where("score between 0 and 1").count() == n
    assert exact_dedup.exact_dedup(odd).count() == n and line_dedup.drop_lines(odd).count() == n and pii.find_pii(odd).count() == n
    assert token_files.read_token_files(token_files.write_token_files(odd)).count() == n
    assert jaccard_join.jaccard_components(odd).count() == n and pieces.round_trip(odd).where("decoded = text").count() == n


def test_training_text_is_the_last_in_order(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "c"), (1, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: (r["text"], r["label"]) for r in features.training_rows(docs, labels, "toxic").collect()}
    assert got.get(1, ("c", 1.0)) == ("c", 1.0) and got.get(2, (None, 0.0)) == (None, 0.0) and got


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    want = con.execute(entries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    done = entries.queries()[name](spark, SF)
    assert sorted(done.columns) == sorted(columns)
    assert sorted(map(repr, done.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(repr, want.df().itertuples(index=False, name=None)))
