"""Toxicity by boosted trees over dense features, with isotonic calibration (operator 9).

1. The lexicon is learned: words, and stems of four or five letters, whose share
   of toxic training texts exceeds that of the others most clearly, counted by a
   keyed aggregation over the bounded training sample; at most ``LEXICON`` words
   and as many stems.
2. Features: lexicon densities, how near second-person words stand to them,
   obfuscated lexicon words, capitals, punctuation and the other style shares.
3. Gradient-boosted trees fit on three quarters of the sample; an isotonic
   regression on the last quarter turns their output into a probability.
4. Scoring is one pass over the documents without any shuffle.

Labels come only from rows that are not held out; labels, lang, source and
doc_id are no inputs of a score.
"""

from __future__ import annotations

import re

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .features import fit_trees, held_out, sample_features, style, training_rows, with_features, words_of

LEXICON = 100
MIN_SUPPORT = 4
STEMS = (4, 5)  # letters
NEAR = 6  # words
TREES, DEPTH = 20, 4

# fixed values: second-person words of the four languages
SECOND_PERSON = {w.encode() for w in "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()}
# fixed values: signs that stand for letters in masked words
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
#: Tried once for each run of letters, from its first, so that the time grows with the text.
_MASKED = re.compile(rb"(?<![A-Za-z])[A-Za-z]++[0-9@$*!._-][A-Za-z0-9@$*!._-]*[A-Za-z0-9@$]")


def _stems(words, size: int):
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > size), lambda w: F.concat(F.substring(w, 1, size), F.lit("*"))))


def learn_lexicon(rows: DataFrame) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """word -> log odds of the words that mark label 1, and the same of stems; at most LEXICON of each."""
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return {}, {}
    bad, good = total.get(1.0, 0), total.get(0.0, 0)
    clean = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "))
    each = F.array_distinct(F.split(clean, " "))
    words = rows.select("label", F.explode(F.concat(each, *(_stems(each, k) for k in STEMS))).alias("word")).where(F.length("word") > 1)
    counts = words.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(F.col("a") >= MIN_SUPPORT)
    share_a, share_b = (F.col("a") + 0.5) / (bad + 1), (F.col("b") + 0.5) / (good + 1)
    odds = F.log(share_a / (1 - share_a + 1e-9)) - F.log(share_b / (1 - share_b + 1e-9))
    sure = (share_a - share_b) / F.sqrt(share_a * (1 - share_a + 1e-9) / bad + share_b * (1 - share_b + 1e-9) / good)
    rated = cut(counts.select("word", odds.alias("odds"), sure.alias("sure")).where("sure > 3 and odds > 1"), "lexicon")
    stem = F.col("word").endswith("*")
    words, stems = ({r["word"].rstrip("*").encode(): r["odds"] for r in rated.where(kind).orderBy(F.desc("sure"), "word").limit(LEXICON).collect()} for kind in (~stem, stem))
    return words, stems


def extractor(lexicon: dict[bytes, float], stems: dict[bytes, float]):
    """text -> features: lexicon densities and proximity first, then style."""
    sizes = sorted({len(s) for s in stems})

    def extract(text: bytes) -> list[float]:
        words = words_of(text)
        stemmed = [stems[w[:k]] for k in sizes for w in words if w[:k] in stems]
        n = max(len(words), 1)
        hits = [i for i, w in enumerate(words) if w in lexicon]
        weight = sum(lexicon[words[i]] for i in hits)
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near, k = 0, 0
        for i in hits:
            while k < len(second) and second[k] < i - NEAR:
                k += 1
            near += k < len(second) and second[k] <= i + NEAR
        masked = [m for m in _MASKED.findall(text) if m.isascii()]
        hidden = sum(1 for m in masked if (p := m.lower()) not in lexicon and (p.translate(LEET, b"*._-") in lexicon or p.translate(None, b"*._-") in lexicon))
        return [
            len(hits) / n, weight / n, float(len(hits)), weight, float(len({words[i] for i in hits})), max((lexicon[words[i]] for i in hits), default=0.0),
            len(stemmed) / n, sum(stemmed) / n, float(len(stemmed)), max(stemmed, default=0.0), near / n, float(near), len(second) / n, hidden / n, float(hidden), len(masked) / n, *style(text, words),
        ]

    return extract


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    """Learn from the labelled rows that aren't held out; returns what adds ``score`` to a frame with features, and the extractor."""
    rows = training_rows(docs, labels, label)
    extract = extractor(*learn_lexicon(rows))
    data = sample_features(rows, extract, "toxicity-sample")
    last = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(4)) == 0
    trees = fit_trees(data.where(~last), TREES, DEPTH)
    check = trees(data.where(last), "p").select("p", "label")
    if check.agg(F.countDistinct("label")).first()[0] < 2:
        return extract, lambda df: trees(df, "score")
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(check)

    def score(df: DataFrame) -> DataFrame:
        done = isotonic.transform(trees(df, "p"))
        return done.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated"))).drop("p", "calibrated")

    return extract, score


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Null and empty texts get the score of a text without words.  Repeated rows
    get equal scores.  A null doc_id is never held out.  Without labels of both
    kinds the score is the only label seen, or 0.5.  An empty table gives an
    empty result; other columns are ignored.
    """
    extract, score = fit(docs, labels, label)
    done = score(with_features(docs.select("doc_id", "text"), extract))
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
