"""Dense features of texts, and gradient-boosted trees over them, for the classifiers.

All features of a text come from one pass over its bytes in the task that reads
it.  The trees are Spark MLlib's; they are fitted on a bounded sample of
labelled rows and applied to all rows inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, extended, map_arrow, with_rest

#: A fit reads this many labelled rows at most: those with the smallest hash of their doc_id.
MAX_TRAIN = 20_000
SLICE = 1000  # rows of an Arrow batch that are Python objects at once

_UPPER = range(0x41, 0x5B)
_LETTERS = {*_UPPER, *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Letters, lower-cased, and an apostrophe between them make words; all else separates.
WORD_BYTES = bytes(c + 32 if c in _UPPER else c if c in _LETTERS else 32 for c in range(256))
_GROUPS = {"upper": _UPPER, "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "high": range(0x80, 0x100), "space": b" \t\n\r\x0b\x0c", "stop": b".,;:", "bang": b"!?", "sign": b"#$%&*@^~+=<>\\/_", "bar": b"|", "bracket": b"()[]{}\"'`"}
_TABLE = np.zeros((256, len(_GROUPS)))
for _k, _g in enumerate(_GROUPS.values()):
    _TABLE[list(_g), _k] = 1

STYLE = [*_GROUPS, "log_words", "word_length", "distinct", "lines", "line_length", "repeated_lines", "caps_words", "sign_words"]
_SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")
_SIGNED = re.compile(rb"[A-Za-z\x80-\xff][#$%&*!|^~]{2,}")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def style(text: bytes, words: list[bytes]) -> list[float]:
    """The STYLE features: shares of kinds of bytes, lengths, repetition, shouting.  An empty text has zeros."""
    n, m = len(text), len(words)
    if not n:
        return [0.0] * len(STYLE)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / n
    lines = text.split(b"\n")
    return [
        *shares.tolist(), float(np.log1p(m)), sum(map(len, words)) / max(m, 1), len(set(words)) / max(m, 1), len(lines) / n, float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines),
        len(_SHOUTED.findall(text)) / max(m, 1), len(_SIGNED.findall(text)) / max(m, 1),
    ]


def with_features(docs: DataFrame, extract: Callable[[bytes], list[float]]) -> DataFrame:
    """doc_id, text (binary), rest (a struct of the other columns), features.  Null texts count as empty."""
    rows = with_rest(docs)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([extract(t or b"") for t in column(batch, "text")], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "features"])

    return map_arrow(rows, step, extended(rows, "features array<double>"), SLICE)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0: such rows' labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label of the bounded sample, one row of a doc_id: of several texts the last in order counts, of several labels the larger one."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN))  # 16 bytes a row
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def fit_trees(rows: DataFrame, trees: int, depth: int) -> Callable[[DataFrame, str], DataFrame]:
    """Fit boosted trees on rows of (features, label); returns what adds their probability of label 1 to a frame.

    Without rows of both labels the probability is the only label seen, or 0.5.
    """
    seen = rows.agg(F.min("label"), F.max("label")).first()
    if seen[0] is None or seen[0] == seen[1]:
        return lambda df, name: df.withColumn(name, F.lit(0.5 if seen[0] is None else float(seen[0])))
    data = rows.select(array_to_vector("features").alias("x"), "label").coalesce(4)
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64, minInstancesPerNode=5).fit(data)
    raw = ("rawPrediction", "probability", "prediction", "x")

    def apply(df: DataFrame, name: str) -> DataFrame:
        return model.transform(df.withColumn("x", array_to_vector("features"))).withColumn(name, vector_to_array("probability")[1]).drop(*raw)

    return apply


def sample_features(rows: DataFrame, extract: Callable[[bytes], list[float]], name: str) -> DataFrame:
    """doc_id, label, features of training rows, written once as fitting reads them many times."""
    return cut(with_features(rows, extract).select("doc_id", F.col("rest.label").alias("label"), "features"), name)
