"""Operator 12: exact k-means over integer vectors, with clusters as balls (ball k-means)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove_folder, ship_package, stage_folder

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors that numpy works on at once.
ROWS = 4096


def largest_component(dims: int) -> int:
    """Components up to this size give squared distances whose fourfold fits 64 bits."""
    return math.isqrt((2**63 - 1) // (16 * dims))


@dataclass(frozen=True)
class Balls:
    """Centroids, and for each its neighbours: those that may be the nearest of one of its ball's members, from near to far."""

    centres: np.ndarray
    order: list[np.ndarray]
    gaps: list[np.ndarray]

    @staticmethod
    def around(centres: list[list[int]], radii: list[int] | None) -> Balls:
        """radii: no member of a ball is farther from its centroid, which lets go of centroids beyond twice as far; None: not known."""
        c = np.array(centres, dtype=np.int64)
        order, gaps = [], []
        for i in range(len(c)):
            far = ((c - c[i]) ** 2).sum(1)
            near = [j for j in np.lexsort((np.arange(len(c)), far)) if j != i and (radii is None or int(far[j]) <= 4 * radii[i] ** 2)]
            order.append(np.array(near, dtype=np.int64))
            gaps.append(far[order[-1]])
        return Balls(c, order, gaps)

    def nearest(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid (ties: the smaller number), and the distances worked out.

        own: each vector's ball. A vector at d from its centroid can be nearer to another, or as near, only if the two centroids
        are at most 2d apart. So the vectors within half the gap to the first neighbour are a core that stays; those between half
        the gaps to neighbours m and m + 1 are an annulus, which meets the first m neighbours alone.
        """
        best, least = own.copy(), ((x - self.centres[own]) ** 2).sum(1)
        compared = len(x)
        for a in np.unique(own):
            members = np.flatnonzero(own == a)
            annulus = np.searchsorted(self.gaps[a], 4 * least[members], side="right")
            for m, j in enumerate(self.order[a][: annulus.max()]):
                those = members[annulus > m]
                other = ((x[those] - self.centres[j]) ** 2).sum(1)
                closer = (other < least[those]) | ((other == least[those]) & (j < best[those]))
                best[those[closer]], least[those[closer]] = j, other[closer]
                compared += len(those)
        return best, least, compared


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id and x, the components as floor(scale * component), of the vectors with `dims` components, none null or non-finite.

    Components too large for exact distances in 64 bits are an error.
    """
    v = F.col(vector_col).cast("array<double>")
    bound = largest_component(dims)

    def whole(c: Column) -> Column:
        scaled = F.lit(float(scale)) * c
        return F.when(F.abs(scaled) < bound, F.floor(scaled)).otherwise(F.raise_error(F.lit(f"components of at most {bound // scale} can be clustered")).cast("long"))

    fit = (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fit).select(F.col(id_col).alias("id"), F.transform(v, whole).alias("x"))


def first_centres(known: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id; of rows of one id the smallest vectors, rows without an id last."""
    drawn = known.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "x")
    return [list(r["x"]) for r in drawn.orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()]


def _assigned(state: DataFrame, balls: Balls, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column("x")
                x = np.asarray(lists.flatten()).reshape(len(part), -1)
                best, least, _ = balls.nearest(x, np.asarray(part.column("cluster")).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(best.astype(np.int32)), pa.array(least)], names=["id", "x", "cluster", "distance"])

    return state.mapInArrow(run, schema)


def ball_kmeans(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with `dims` finite components.

    Vectors become integers, floor(scale * component), so every distance and centroid is exact and no order of summing matters.
    Each of the rounds assigns every vector to its nearest centroid and moves centroids to the floors of their members' means;
    then vectors are assigned once more. Centroids without members stay. Null vectors, those of another length and those with
    null or non-finite components have no row; rows of one id are vectors of their own; equal vectors get equal answers, ties go
    to the smaller number. Fewer vectors than clusters make fewer clusters, and none make no rows. Other columns are not read.

    To the driver come, in each round, counts, sums and radii of the clusters. Assignments are written to the checkpoint
    folder round by round, and the round before is removed then; the last one stays for the reader of the result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    known = integer_vectors(vectors, dims, scale, id_col, vector_col)
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("x", T.ArrayType(T.LongType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    centres = first_centres(known, clusters, seed)
    if not centres:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")]))
    radii, folder = None, stage_folder(spark)
    state = known.withColumn("cluster", F.lit(0))
    for k in range(rounds + 1):
        _assigned(state, Balls.around(centres, radii), schema).write.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
        state = spark.read.parquet(f"{folder}/{k}")
        if k == rounds:
            break
        parts = state.select("cluster", "distance", F.posexplode("x").alias("at", "component")).groupBy("cluster", "at")
        moved = {(r["cluster"], r["at"]): r for r in parts.agg(F.sum("component").alias("s"), F.count("*").alias("n"), F.max("distance").alias("far")).collect()}
        radii = [0] * len(centres)
        for i in {i for i, _ in moved}:
            old, far = centres[i], moved[i, 0]["far"]
            centres[i] = [moved[i, at]["s"] // moved[i, at]["n"] for at in range(dims)]
            # Members are no farther from the moved centroid than from the old one and the way between the two.
            radii[i] = math.isqrt(far) + math.isqrt(sum((a - b) ** 2 for a, b in zip(old, centres[i]))) + 2
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    about = spark.createDataFrame([(i, s, sum(inertia.values()), digests[i]) for i, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(about), "cluster")
    return found.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for the same rows, by comparing every vector with every centroid in every round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT v.row, v.x, c.k, list_sum(list_transform(v.x, lambda e, i: (e - c.c[i]) * (e - c.c[i])))::BIGINT AS d FROM kept v, c{k} c),
a{k} AS MATERIALIZED (SELECT row, any_value(x) AS x, arg_min(k, d * {clusters} + k) AS k, min(d) AS d FROM d{k} GROUP BY row)""")
        if k < rounds:
            steps.append(f"""
p{k} AS (SELECT k, generate_subscripts(x, 1) AS i, unnest(x) AS e FROM a{k}),
s{k} AS (SELECT k, i, sum(e)::BIGINT AS s, count(*) AS n FROM p{k} GROUP BY k, i),
m{k} AS (SELECT k, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS c FROM s{k} GROUP BY k),
c{k + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m ON o.k = m.k)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), x) - 1 AS k, x AS c FROM kept ORDER BY k LIMIT {clusters}),{','.join(steps)}
SELECT v.vec_id, a.k::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept v USING (row) JOIN c{rounds} c ON c.k = a.k
"""
