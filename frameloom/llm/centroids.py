"""Centroid clustering in whole numbers: Lloyd's rounds, with Hamerly's bounds persisted from round to round."""

from __future__ import annotations

import decimal
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored_at

#: Whole numbers up to this size have exact squares, and sums of 2 ** 8 of them, in doubles.
_EXACT = 1 << 22
#: What bounds are widened by, so that rounding never makes one too tight.
_SLACK = 1e-9
_LONG = (1 << 63) - 1


def kept_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """id, vec: the vectors with `dims` components, none null or not finite, as floor(scale * x); beyond a long, its bound."""
    vec = F.col(vec_col).cast("array<double>")
    whole = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    kept = rows.where((F.size(vec) == dims) & whole)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vec"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the least SHA-256 of salt and id; all, if fewer. Like ids are told apart by their vectors."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return [list(r["vec"]) for r in vectors.orderBy(order.asc_nulls_last(), "vec").limit(k).collect()]


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each centroid: longs where all values are small, else Python's integers."""
    size = max(max(-int(a.min(initial=0)), int(a.max(initial=0))) for a in (x, centroids))
    if size <= _EXACT and x.shape[1] <= 256:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    a, b = x.astype(object), centroids.astype(object)
    return np.stack([((a - c) ** 2).sum(axis=1) for c in b], axis=1)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Bounds:
    """What a round needs to know of its centroids: how far each moved, and half the way to its nearest neighbour."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None):
        self.now = np.array(now, dtype=np.int64).reshape(len(now), -1)
        k = len(now)
        self.moved = np.zeros(k)
        if before is not None:
            old = np.array(before, dtype=np.int64).reshape(k, -1)
            self.moved = np.array([math.sqrt(int(squared(self.now[i : i + 1], old[i : i + 1])[0, 0])) for i in range(k)]) * (1 + _SLACK)
        #: for vectors of each centroid, the furthest that another one moved
        self.others = np.array([np.delete(self.moved, i).max(initial=0.0) for i in range(k)])
        apart = _roots(squared(self.now, self.now))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1, initial=np.inf) / 2 * (1 - _SLACK)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters and bounds of this round, and how many vectors took a full scan.

        A vector whose upper bound lies under its lower one, or under half the way from its centroid to the next, stays.
        Else its distance is computed; if that doesn't settle it, so are all distances, and ties go to the smaller number.
        """
        old = np.maximum(cluster, 0)
        upper = (upper + self.moved[old]) * (1 + _SLACK)
        lower = np.maximum(lower - self.others[old], 0.0) * (1 - _SLACK)
        least = np.maximum(lower, self.half[old])
        cluster = cluster.copy()
        open_ = np.flatnonzero((cluster < 0) | ~(upper < least))
        known = open_[cluster[open_] >= 0]
        for c in np.unique(cluster[known]):
            at = known[cluster[known] == c]
            upper[at] = _roots(squared(x[at], self.now[c : c + 1])[:, 0]) * (1 + _SLACK)
        open_ = open_[(cluster[open_] < 0) | ~(upper[open_] < least[open_])]
        if len(open_):
            d = squared(x[open_], self.now)
            nearest = d.argmin(axis=1)
            rows = np.arange(len(open_))
            upper[open_] = _roots(d[rows, nearest]) * (1 + _SLACK)
            roots = _roots(d)
            roots[rows, nearest] = np.inf
            lower[open_] = roots.min(axis=1) * (1 - _SLACK)
            cluster[open_] = nearest
        return cluster, upper, lower, len(open_)



def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _round(state: DataFrame, bounds: Bounds) -> DataFrame:
    dims = bounds.now.shape[1]

    def assign(batches):
        for batch in batches:
            col = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            before = col("cluster")
            cluster, upper, lower, _ = bounds.assign(_matrix(batch.column("vec"), dims), before, col("upper"), col("lower"))
            arrays = [batch.column("id"), batch.column("vec"), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "vec", "cluster", "before", "upper", "lower"])

    return state.select("id", "vec", "cluster", "upper", "lower").mapInArrow(assign, "id long, vec array<long>, cluster int, before int, upper double, lower double")


def _changes(state: DataFrame, k: int, dims: int) -> list[tuple[int, int, int]]:
    """(cluster, component, change of its sum) from the vectors that moved; component -1 is the number of vectors.

    A task adds up its rows, so k * (dims + 1) rows leave it, and as many reach the driver.
    """

    def add_up(batches):
        total = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            x = _matrix(batch.column("vec"), dims)
            if len(x) and max(-int(x.min()), int(x.max())) > 1 << 40:
                x = x.astype(object)
            for name, sign in (("cluster", 1), ("before", -1)):
                of = batch.column(name).to_numpy(zero_copy_only=False)
                for c in np.unique(of[of >= 0]):
                    at = of == c
                    total[c, :dims] += sign * x[at].sum(axis=0)
                    total[c, dims] += sign * int(at.sum())
        rows = [(c, d if d < dims else -1, int(total[c, d])) for c in range(k) for d in range(dims + 1) if total[c, d]]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array([decimal.Decimal(v) for v in columns[2]], pa.decimal128(38, 0))], names=["cluster", "part", "change"])

    moved = state.where("cluster != before").select("vec", "cluster", "before")
    sums = moved.mapInArrow(add_up, "cluster int, part int, change decimal(38,0)").groupBy("cluster", "part").agg(F.sum("change").alias("change"))
    return [(r["cluster"], r["part"], int(r["change"])) for r in sums.collect()]


def cluster(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """Each kept vector's cluster, squared distance, the inertia of its cluster and of all, and its centroid's SHA-256.

    Kept are vectors with `dims` components, none null or not finite; a row of any other vector gives no row, repeated
    rows and null ids count as rows. With fewer than k kept vectors there are as many centroids; with none, no rows.
    Other columns of any name are ignored. Sums, centroids and distances are exact whole numbers; what wouldn't fit a
    long (components beyond about 2 ** 28) is held at the largest long in the result, but compared exactly.

    Every round reads the vectors with the bounds of the round before and writes them anew to the shared folder, so no
    round depends on an executor that may be lost, and the step before is deleted. Only vectors that changed their
    cluster enter the sums, which reach the driver as k * (dims + 1) numbers, whatever the table's size.
    """
    spark = rows.sparkSession
    vectors = kept_vectors(rows, id_col, vec_col, dims, scale)
    start = vectors.select("id", "vec", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    state, path = stored_at(start, "vectors")
    now = first_centroids(state, k, salt)
    k, before = len(now), None
    sums, counts = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=object)
    for r in range(rounds + 1) if k else ():
        state, written = stored_at(_round(state, Bounds(now, before)), "bounds")
        discard(spark, path)
        path = written
        if r == rounds:
            break
        for c, part, change in _changes(state, k, dims):
            if part < 0:
                counts[c] += change
            else:
                sums[c, part] += change
        before, now = now, [[int(s) // int(counts[c]) for s in sums[c]] if counts[c] else now[c] for c in range(k)]

    final = np.array(now, dtype=np.int64).reshape(k, dims)

    def measure(batches):
        for batch in batches:
            x, of = _matrix(batch.column("vec"), dims), batch.column("cluster").to_numpy(zero_copy_only=False)
            d = np.zeros(len(x), dtype=np.int64)
            for c in np.unique(of):
                at = of == c
                d[at] = np.minimum(squared(x[at], final[c : c + 1])[:, 0], _LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(d, pa.int64())], names=["id", "cluster", "distance"])

    measured = (state if k else state.limit(0)).select("id", "vec", "cluster").mapInArrow(measure, "id long, cluster int, distance long")
    if k:
        measured, _ = stored_at(measured, "distances")
        discard(spark, path)
    inertia = {r["cluster"]: int(r["s"]) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of_cluster = F.array(*[F.lit(min(inertia.get(c, 0), _LONG)).cast("long") for c in range(k)] or [F.lit(None).cast("long")])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in now] or [F.lit(None).cast("string")])
    return measured.select(
        F.col("id").alias(id_col), "cluster", "distance", F.get(of_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), _LONG)).cast("long").alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )


def cluster_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    """DuckDB SQL for cluster(): each round is a CTE over all vectors and centroids."""
    floored = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    parts = [
        "RECURSIVE none AS (SELECT 1)",
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}' || vec_id), v) - 1 AS INTEGER) AS c, v FROM kept QUALIFY row_number() OVER (ORDER BY sha256('{salt}' || vec_id), v) <= {k})",
    ]
    for r in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, vec_id, kept.v, unnest([min({{'d': CAST({d} AS BIGINT), 'c': c.c}})], recursive := true) FROM kept, c{r} c GROUP BY rid, vec_id, kept.v)")
        if r < rounds:
            parts.append(
                f"s{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY c, i), "
                f"m{r} AS (SELECT c, list({floored} ORDER BY i) AS v FROM s{r} GROUP BY c), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)"
            )
    last = f"a{rounds}"
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, {last}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} k ON k.c = {last}.c"
    )
