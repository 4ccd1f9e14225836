"""Centroid clustering of integer vectors by partial-distance search.

Vectors become integers, so distances, sums and centroids are exact and the same on every run and partitioning. A task
searches a batch of rows at once: the squared differences of all centroids are added up over the dimensions that vary
most, the closest centroid so far is finished for each row, and the others are followed a few dimensions at a time, only
as long as their part is not above the best whole distance. What is left at the end is whole, and the smallest wins.

A round gives one row a task and centroid with counts, sums and sums of squares; the driver sees one row a centroid. The order of
the dimensions follows the variances of the round before and changes the speed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ready, written

#: dimensions of the first part and of each later one
PART = 8
#: rows searched at once
ROWS = 4_096
#: components beyond this have no distances in 64 bits
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, of the vectors with ``dims`` components, none null, NaN or infinite.

    Ids are kept as they are, null and repeated ones included; other columns are ignored. A component beyond 2^27 after scaling has no
    exact 64-bit distance and is an error that names it.
    """
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    whole = F.coalesce((F.size("x") == dims) & F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))), F.lit(False))
    error = F.raise_error(F.lit(f"a component beyond {LARGEST} after scaling"))
    fits = lambda e: F.when(F.abs(e * scale) <= LARGEST, F.floor(e * scale)).otherwise(error.cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(whole).select("vec_id", F.transform("x", fits).alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row, the smaller number among equals."""
    x, c = x[:, order], centroids[:, order]
    part = np.zeros((len(x), len(c)), np.int64)
    for d in range(min(PART, x.shape[1])):
        part += (x[:, d, None] - c[None, :, d]) ** 2
    first = part.argmin(1)
    rows = np.arange(len(x))
    rest = x[:, PART:] - c[first, PART:]
    best = part[rows, first] + (rest * rest).sum(1)
    whole = np.full(part.shape, np.iinfo(np.int64).max)
    whole[rows, first] = best
    part[rows, first] = np.iinfo(np.int64).max
    row, number = np.nonzero(part <= best[:, None])
    so_far = part[row, number]
    for d in range(PART, x.shape[1], PART):
        gap = x[row, d : d + PART] - c[number, d : d + PART]
        so_far = so_far + (gap * gap).sum(1)
        going = so_far <= best[row]  # abandoned once strictly above the best
        row, number, so_far = row[going], number[going], so_far[going]
    whole[row, number] = so_far
    found = whole.argmin(1)
    return found, whole[rows, found]


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part.column(0), np.asarray(part.column(1).flatten()).reshape(part.num_rows, dims)


def _sums(centroids: np.ndarray, order: np.ndarray):
    """One row for each centroid that a task's rows are nearest to: count, sums and sums of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        count, sums, squares = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims))
        for _, x in _matrices(batches, dims):
            found, _ = nearest(x, centroids, order)
            for j in np.unique(found):
                own = x[found == j]
                count[j] += len(own)
                sums[j] += own.sum(0)
                squares[j] += (own.astype(np.float64) ** 2).sum(0)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(list(sums[at]), pa.list_(pa.int64())), pa.array(list(squares[at]), pa.list_(pa.float64()))], ["cluster", "n", "sums", "squares"])

    return run


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, centroids.shape[1]):
            found, distance = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _by_variance(n: int, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Dimensions, the one that varies most first."""
    return np.argsort(-(squares / n - (sums / n) ** 2), kind="stable")


def start_order(seed: int = 1) -> Column:
    """What the starting vectors are picked by: the hash of the seed and the id; null for null ids."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that ``integer_vectors`` keeps, the final centroids).

    Centroids start as the k vectors of smallest ``start_order`` (of equal ids, the smaller vector), are replaced ``rounds`` times by the
    exact floor of their vectors' means, and empty ones stay. Equal distances go to the smaller number. Vectors with null ids are clustered like all others but
    are no starting ones; repeated rows each count and come back. With fewer vectors than k there are fewer centroids, with none of an id the
    result is empty, as for an empty table.
    """
    spark = ready(vectors.sparkSession)
    kept = integer_vectors(vectors, dims, scale, id_col, vector_col)
    start = kept.where("vec_id is not null").orderBy(start_order(seed), "v").limit(k).collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(len(start), dims)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    order = _by_variance(len(centroids), centroids.sum(0).astype(float), (centroids.astype(float) ** 2).sum(0))
    for _ in range(rounds):
        found = kept.mapInArrow(_sums(centroids, order), "cluster int, n long, sums array<long>, squares array<double>")
        wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)] + [F.sum(F.col("squares")[i]).alias(f"q{i}") for i in range(dims)]
        rows = found.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect()
        centroids = centroids.copy()
        for r in rows:
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
        total = lambda letter: np.array([sum(float(r[f"{letter}{i}"]) for r in rows) for i in range(dims)])
        order = _by_variance(sum(r.n for r in rows), total("s"), total("q"))
    return kept.mapInArrow(_assigned(centroids, order), schema), centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector; see ``centroid_clusters`` for its options, nulls, repeated
    rows and empty tables."""
    spark = ready(vectors.sparkSession)
    assigned, centroids = centroid_clusters(vectors, **options)
    assigned = written(assigned)
    of = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    total = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    all_ = total.agg(F.sum("cluster_inertia").alias("inertia"))
    digests = spark.createDataFrame(of, "cluster int, centroid_sha256 string")
    per_cluster = total.join(digests, "cluster").crossJoin(all_)  # one row a centroid by one row
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
