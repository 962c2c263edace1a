"""k-means by sort-means (Phillips, 2002), in exact integer arithmetic.

Every round knows the distances of the centroids from each other, and for each centroid the order of the others by that distance. A
vector starts at the centroid that it was assigned to and goes through the others in that one's order; it stops at the first that is
strictly beyond twice its distance from where it started, since by the triangle inequality none from there on can be nearer or tie.

A round is one pass over the vectors without a shuffle of them: each task writes its vectors with their new assignment and, in the same
file, one row of sums a cluster. Only these sums (k rows a task) are read again for the next centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behavex.llm.common import Scratch, cut, discard, table

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components that squared distances in 64 dimensions are sure to hold in a long.
LARGEST = 1 << 27

_STATE = "vec_id long, point array<long>, cluster int, distance long, sums array<long>, n long"


def order_of(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each the others by distance (ties: smaller number)."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    rest = np.array([[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(apart)], dtype=np.int64)
    return apart, rest.reshape(len(centroids), -1)


def assign(points: np.ndarray, before: np.ndarray, centroids: np.ndarray, apart: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each point, exactly those of a full search, and how many distances were computed."""
    cluster, distance, made = before.copy(), np.zeros(len(points), dtype=np.int64), 0
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        start = ((points[rows] - centroids[a]) ** 2).sum(1)
        best, near = start.copy(), np.full(len(rows), a)
        open_ = np.arange(len(rows))
        made += len(rows)
        for j in rest[a]:
            open_ = open_[apart[a, j] <= 4 * start[open_]]  # strictly beyond twice the distance: closed for good, as rest is sorted
            if not len(open_):
                break
            d = ((points[rows[open_]] - centroids[j]) ** 2).sum(1)
            made += len(open_)
            better = (d < best[open_]) | ((d == best[open_]) & (j < near[open_]))
            best[open_[better]], near[open_[better]] = d[better], j
        cluster[rows], distance[rows] = near, best
    return cluster, distance, made


def _points(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _round(centroids: np.ndarray):
    apart, rest = order_of(centroids)
    k, dimensions = centroids.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        names = ["vec_id", "point", "cluster", "distance", "sums", "n"]
        for rb in it:
            if not rb.num_rows:
                continue
            x = _points(rb.column("point"), dimensions)
            cluster, distance, _ = assign(x, rb.column("cluster").to_numpy(), centroids, apart, rest)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(0)
            n += np.bincount(cluster, minlength=k)
            none = pa.nulls(rb.num_rows, pa.list_(pa.int64())), pa.nulls(rb.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column("vec_id"), rb.column("point"), pa.array(cluster.astype(np.int32)), pa.array(distance), *none], names=names)
        have = np.flatnonzero(n)
        if len(have):
            empty = [pa.nulls(len(have), t) for t in (pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(have.astype(np.int32)), pa.nulls(len(have), pa.int64()), pa.array(list(total[have]), type=pa.list_(pa.int64())), pa.array(n[have])], names=names)

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    sums = state.where("sums is not null").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    got = sums.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # k times the dimensions
    out = centroids.copy()
    for r in got:
        out[r.cluster, r.i] = r.x // r.n
    return out


def kept_points(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, point): the vectors with exactly so many components, none null, NaN or infinite, each as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) == dimensions) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    large = F.exists("whole", lambda v: F.abs(v) > LARGEST)
    whole = vectors.where(F.col("embedding").isNotNull()).where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("whole"))
    return whole.select("vec_id", F.when(large, F.raise_error(F.lit("sort_means: a component is too large for exact distances"))).otherwise(F.col("whole")).cast("array<long>").alias("point"))


def sort_means(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each
    vector that takes part.

    Vectors that are null, of another length, or hold null or non-finite components take no part; other columns are ignored. Rows with
    equal ids, null ids and equal vectors each count. The first centroids are the rows with the smallest SHA-256 of `seed:vec_id`
    (ties by components; null ids last); of fewer rows than clusters each is one. Ties go to the smaller number; a centroid without
    vectors stays. Whole components beyond 2^27 are an error. An empty table gives no rows."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    with Scratch(vectors.sparkSession) as scratch:
        points = kept_points(vectors, dimensions, scale)
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        first = points.orderBy(F.asc_nulls_last(key), "point").limit(clusters).collect()
        if not first:
            return vectors.sparkSession.createDataFrame([], schema)
        centroids = np.array([r.point for r in first], dtype=np.int64)
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("distance", "long"), ("sums", "array<long>"), ("n", "long"))]
        state = points.select("*", F.lit(0).alias("cluster"), *nothing)
        for i in range(rounds + 1):
            after = cut(state.where("sums is null").mapInArrow(_round(centroids), _STATE), "assigned")
            if i:
                discard(state)
            state = after
            if i < rounds:
                centroids = _moved(state, centroids)
        rows = state.where("sums is null").select("vec_id", "cluster", "distance")
        each = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a cluster
        digest = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in each}
        known = vectors.sparkSession.createDataFrame([(c, n, sum(each.values()), digest[c]) for c, n in each.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        out = rows.join(F.broadcast(known), "cluster")
        return scratch.result(out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "sort-means")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Full search instead of the ordered one, a round after the other."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, p) AS r, vec_id, p FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
        WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, p) - 1 AS c, p AS q FROM kept QUALIFY c < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        square = "list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, p, c, CAST(d AS BIGINT) AS d FROM (SELECT *, {square} AS d FROM kept CROSS JOIN c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < ROUNDS:
            mean = "(s - ((s % n) + n) % n) // n"
            sums = f"SELECT c, list(CAST({mean} AS BIGINT) ORDER BY i) AS m FROM (SELECT c, i, sum(p[i]) AS s, count(*) AS n FROM a{i}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY c, i) GROUP BY c"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m, q) AS q FROM c{i} LEFT JOIN ({sums}) USING (c))")
    last = ROUNDS
    return f"""WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(q, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} USING (c)"""


OP12_SQL = _sql()
