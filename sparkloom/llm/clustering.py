"""Centroid clustering by dual-tree Lloyd rounds (operator 11).

1. Vectors become integers.  Each task packs those it reads into blocks of
   ``BLOCK_ROWS`` and builds a cover tree over each block; the trees are written
   once to the shared folder, and every round reads them from there.
2. A round builds a cover tree over the centroids, whose number is a parameter,
   sends it to all tasks, and walks the pairs of nodes of both trees: bounds on
   distances discard centroid nodes, whole vector nodes go to the one centroid
   that is left, leaves are compared exactly.  A task adds up its vectors by
   centroid; only these sums are shuffled and reach the driver.
3. Ties go to the smaller number, sums and means are exact integers, so the
   result doesn't depend on how vectors are dealt to tasks and blocks.

Equal vectors, however many, are one leaf of radius 0 in each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, joined, small_batches
from .cover_trees import Centroids, Tree, cover_tree, nearest, pair_squares

DIMS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 16, 3, 1, 64
BLOCK_ROWS, LEAF = 1024, 8
#: Components beyond this would overflow the distances' longs; they count as this.
MOST = 1 << 27

BLOCKS = "ids array<bigint>, points binary, nodes binary, radii binary"
SUMS = "cluster int, place int, total bigint"
ASSIGNED = "vec_id bigint, cluster int, distance bigint"


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, an array of floor(scale * x) for each component x as a double.

    Vectors of another length and those with a null or non-finite component are
    left out; components beyond +-2^27 count as +-2^27, as distances are longs.
    """
    x = F.col("embedding")
    whole = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False)))
    kept = vectors.where((F.size(x) == dims) & whole)
    ints = F.transform(x, lambda e: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(e.cast("double") * scale))).cast("int"))
    return kept.select(F.col("vec_id").cast("long"), ints.alias("v"))


def seeds(ints: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:vec_id``; equal ids go by their components, those without an id come last."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in ints.orderBy(hashed.asc_nulls_last(), "v").select("v").limit(clusters).collect()]


def _packed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, BLOCK_ROWS):
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                tree, order = cover_tree(part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dims), LEAF)
                nodes = np.stack([tree.start, tree.end, tree.center, tree.child, tree.children]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (tree.points.astype(np.int32), nodes, tree.radius))],
                    ["ids", "points", "nodes", "radii"],
                )

    return run


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for k in range(batch.num_rows):
        points, nodes, radii = (batch.column(c)[k].as_py() for c in (1, 2, 3))
        table = np.frombuffer(nodes, np.int32).reshape(5, -1).astype(np.int64)
        yield batch.column(0)[k].values, Tree(np.frombuffer(points, np.int32).reshape(-1, dims).astype(np.int64), *table, np.frombuffer(radii))


def _summed(dims: int, centroids: Centroids):
    """Sums of each centroid's vectors, one set of rows a task; place -1 has their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids.number), dims + 1), np.int64)
        for batch in batches:
            for _, tree in _blocks(batch, dims):
                of = nearest(tree, centroids)
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                np.add.at(sums[:, :dims], of[first], np.add.reduceat(tree.points, first))
                sums[:, dims] += np.bincount(of, minlength=len(sums))
        seen = np.flatnonzero(sums[:, dims])
        places = np.r_[np.arange(dims), -1].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(seen, dims + 1).astype(np.int32)), pa.array(np.tile(places, len(seen))), pa.array(sums[seen].ravel())], ["cluster", "place", "total"]
        )

    return run


def _assigned(dims: int, centroids: Centroids, numbered: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _blocks(batch, dims):
                of = nearest(tree, centroids)
                gap = pair_squares(tree.points, np.arange(len(of)), numbered, of)
                yield pa.RecordBatch.from_arrays([ids, pa.array(of.astype(np.int32)), pa.array(gap)], ["vec_id", "cluster", "distance"])

    return run


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and squared distance of every kept vector (see ``integer_vectors``), and the centroids.

    With fewer vectors than ``clusters`` each is a seed; without any the result
    is empty and there are no centroids.  Equal seeds are allowed: all their
    vectors go to the smaller number, the other stays empty and as it is.
    Repeated rows count each; a null vec_id is kept.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    ints = integer_vectors(vectors, dims, scale)
    centroids = seeds(ints, clusters, seed)
    if not centroids:
        return spark.createDataFrame([], ASSIGNED), []
    small_batches(spark)
    blocks = cut(ints.mapInArrow(_packed(dims), BLOCKS), "trees")
    for _ in range(rounds):
        sums = blocks.mapInArrow(_summed(dims, Centroids(centroids)), SUMS)
        # one row for each centroid and component: bounded by the parameters
        total = {(r["cluster"], r["place"]): int(r["total"]) for r in sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        centroids = [[total[c, i] // total[c, -1] for i in range(dims)] if (c, -1) in total else old for c, old in enumerate(centroids)]
    done = cut(blocks.mapInArrow(_assigned(dims, Centroids(centroids), np.array(centroids, np.int64)), ASSIGNED), "assigned")
    discard(blocks)
    return done, centroids


def clusters_with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignment with each cluster's and the whole sum of distances and the digest of the cluster's centroid."""
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    digests = assigned.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # a row for each centroid, whose number is a parameter
    by_cluster = sums.crossJoin(F.broadcast(whole)).join(F.broadcast(digests), "cluster")
    return assigned.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clusters_with_inertia(*lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


_DISTANCE = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _assign(n: int) -> str:
    return f"a{n} AS (SELECT k.r, min({_DISTANCE}::HUGEINT * 16 + c.c) AS m FROM kept k, c{n} c GROUP BY k.r)"


def _move(n: int) -> str:
    return f"""s{n} AS (SELECT a.m % 16 AS c, i, sum(k.v[i]) AS s, count(*) AS n FROM a{n - 1} a JOIN kept k USING (r), range(1, 65) AS x(i) GROUP BY ALL),
c{n} AS (SELECT c.c, coalesce(u.v, c.v) AS v FROM c{n - 1} c LEFT JOIN (
  SELECT c, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM s{n} GROUP BY c) u ON u.c = c.c)"""


ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
{_assign(0)}, {_move(1)}, {_assign(1)}, {_move(2)}, {_assign(2)}, {_move(3)}, {_assign(3)},
done AS (SELECT k.vec_id, (a.m % 16)::INTEGER AS cluster, (a.m // 16)::BIGINT AS distance FROM a3 a JOIN kept k USING (r))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(list_aggregate(c.v, 'string_agg', ',')) AS centroid_sha256
FROM done JOIN c3 c ON c.c = cluster
"""
