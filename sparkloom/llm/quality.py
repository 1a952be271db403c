"""Quality by hierarchical empirical Bayes over hosts and paths (operator 10).

1. Boosted trees over style features, fitted on a bounded sample of labelled
   rows, give each document its evidence p: the chance of quality 1 under the
   global prior.
2. One grouped aggregation sums the evidence by path; hosts and the global
   prior are sums of those sums.  How strongly sites differ is estimated from
   the sums by the method of moments and sets how far sparse sites shrink:
   path means toward their host's, host means toward the global mean.
3. A document's posterior odds are its own odds times the site's prior odds
   over the global ones, the site's sums taken without the document itself.

The sums are one row a path; they join back by key, broadcast by Spark only if
they are small enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, restored
from .features import fit_trees, sample_features, style, training_rows, with_features, words_of

THRESHOLD = 0.5
TREES, DEPTH = 15, 3
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0
#: A site moves a document's log odds by this much at most: junk sites can't sink clean texts.
MOST = 2.0


def extract(text: bytes) -> list[float]:
    return style(text, words_of(text))


def _logit(p):
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(mean, spread):
    """Prior strength k of a beta prior with this mean and variance between sites: mean (1 - mean) / variance - 1."""
    return F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.coalesce(F.try_divide(mean * (1 - mean), spread) - 1, F.lit(STRONGEST))))


def site_sums(scored: DataFrame) -> DataFrame:
    """host, path, n, s and the priors: global mean m0 and strength k0, host sums hn and hs, strength within hosts k1."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "site-sums")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg((F.sum("hs") / F.sum("hn")).alias("m0"), F.sum("hn").alias("all_n"))
    # variance between sites, weighted by their size
    between = hosts.crossJoin(F.broadcast(whole)).agg(F.first("m0").alias("m0"), (F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - F.col("m0"), 2)) / F.first("all_n")).alias("v"))
    k0 = between.select("m0", _strength(F.col("m0"), F.col("v")).alias("k0"))
    within = paths.join(hosts, "host").agg((F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)) / F.sum("n")).alias("w"))
    prior = k0.crossJoin(F.broadcast(within)).select("m0", "k0", _strength(F.col("m0"), F.col("w")).alias("k1"))
    # one row: the global prior
    return paths.join(hosts, "host").crossJoin(F.broadcast(prior))


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """One row per input row: doc_id, text, rest (a struct of the other columns), p (the document's own evidence), host_mean,
    path_mean, score, kept (score >= THRESHOLD).

    The host is the column ``host``, the path is host and column ``path``; null
    or missing ones count as the empty name.  Null and empty texts get the
    evidence of a text without words.  Repeated rows count each.  Without
    labels of both kinds p is the only label seen, or 0.5, which keeps all.
    An empty table gives an empty result.
    """
    trees = fit_trees(sample_features(training_rows(docs, labels, label), extract, "quality-sample"), TREES, DEPTH)
    part = lambda c: F.coalesce(F.col(f"rest.{quoted(c)}").cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    # read twice, for the sums and for the scores, so that features and trees run once
    scored = cut(trees(with_features(docs, extract), "p").select("doc_id", "text", "rest", "p", part(host).alias("host"), F.concat_ws("/", part(host), part(path)).alias("path")), "quality-scored")
    sums = site_sums(scored.select("host", "path", "p"))
    joined = scored.join(sums.drop("host"), "path", "left")
    host_mean = (F.col("hs") - F.col("p") + F.col("k0") * F.col("m0")) / (F.col("hn") - 1 + F.col("k0"))
    path_mean = (F.col("s") - F.col("p") + F.col("k1") * F.col("host_mean")) / (F.col("n") - 1 + F.col("k1"))
    shift = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), _logit(F.col("path_mean")) - _logit(F.col("m0"))))
    done = joined.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean).withColumn("score", 1 / (1 + F.exp(-(_logit(F.col("p")) + shift))))
    return done.select("doc_id", F.col("text").cast("string").alias("text"), "rest", "p", "host_mean", "path_mean", "score", (F.col("score") >= THRESHOLD).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier keeps, with their columns; repeated rows go or stay together, an empty table gives an empty one."""
    return restored(score_quality(docs, labels, **options).where("kept"), docs, follow=False)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    done = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return done.select("doc_id", "p", "host_mean", "path_mean", "score", "kept")
