"""Centroid clustering of integer vectors with a LAESA table: distances to fixed pivots, kept once, bound all others from below."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.llm.staging import staged

SCALE, DIMS, CENTROIDS, ROUNDS, PIVOTS = 256, 64, 40, 5, 8
# Components of at most this size keep every squared distance of DIMS components in a long.
LARGEST = 1 << 27
ROWS = 4096


def integers(column: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Which lists of doubles are vectors to keep, and those as rows of floor(SCALE * x)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), dims), False)
    keep = np.array(right, bool)
    flat = column.filter(right).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        x = np.floor(x * SCALE)
    # A null component reads as NaN.
    fits = (np.abs(x) <= LARGEST).all(1) if len(x) else np.zeros(0, bool)
    keep[np.flatnonzero(keep)] = fits
    return keep, x[fits].astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``a`` to that of ``b``."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(centroids: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Of the first centroids, those that lie farthest from the ones chosen before them."""
    chosen, far = [0], squared(centroids, centroids[:1])
    while len(chosen) < min(count, len(centroids)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(centroids, centroids[chosen[-1]][None]))
    return centroids[chosen]


def roots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each vector to each pivot."""
    return np.sqrt(np.stack([squared(vectors, p[None]) for p in pivots], axis=1).astype(np.float64))


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector its nearest centroid (the first of equals), the exact squared distance, and how many distances were computed in all.

    By the triangle inequality a centroid is at least as far as their distances to any pivot differ. Only centroids whose bound does not
    pass the distance of the most promising one are measured.
    """
    to_pivots = roots(centroids, pivots)
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(table[:, p, None] - to_pivots[None, :, p]), out=bound)
    likely = bound.argmin(1)
    known = squared(vectors, centroids[likely])
    # Room for the rounding of square roots.
    limit = np.sqrt(known.astype(np.float64)) * (1 + 1e-9) + 1e-6
    best, least, measured = likely.copy(), known.copy(), len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= limit) & (likely != c))
        d = squared(vectors[rows], centroids[c][None])
        measured += len(rows)
        better = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
        best[rows[better]], least[rows[better]] = c, d[better]
    return best, least, measured


def pivot_table(vectors: DataFrame, pivots: np.ndarray, dims: int = DIMS) -> DataFrame:
    """vec_id, the vector's integers (little-endian, 32 bits each) and its distances to the pivots, of all vectors to keep."""

    def read(batches):
        for batch in batches:
            keep, x = integers(batch.column("embedding"), dims)
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                near = roots(part, pivots)
                yield pa.record_batch({"vec_id": batch.column("vec_id").filter(pa.array(keep)).slice(at, ROWS),
                                       "vector": pa.array([r.tobytes() for r in part.astype("<i4")], pa.binary()), "table": pa.array([r.tobytes() for r in near.astype("<f8")], pa.binary())})

    return vectors.mapInArrow(read, "vec_id long, vector binary, table binary")


def rows_of(batch: pa.RecordBatch, at: int, pivots: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    part = batch.slice(at, ROWS)
    x = np.frombuffer(b"".join(part.column("vector").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
    return x, np.frombuffer(b"".join(part.column("table").to_pylist()), "<f8").reshape(-1, pivots)


def moved_centroids(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: the floor of the mean of each centroid's vectors; one without vectors stays. A row a centroid and task is shuffled."""
    k, dims = centroids.shape

    def read(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x, near = rows_of(batch, at, len(pivots), dims)
                best = nearest(x, near, centroids, pivots)[0]
                order = np.argsort(best, kind="stable")
                found, first = np.unique(best[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(best, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some]), "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    parts = table.mapInArrow(read, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    new = centroids.copy()
    for r in total.collect():  # a row a centroid
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return new


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """Per kept row of ``vectors`` (vec_id, embedding; other columns are ignored): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are embeddings of ``dims`` components, none null, NaN or infinite, and none above 2**19 in size, whose squared distances a
    long could not hold. The first centroids are the ``k`` vectors with the least SHA-256 of ``2:<vec_id>`` (all, if fewer; a null id
    comes last, a repeated one in the order of its components). Repeated rows each count. A tie goes to the smaller number; an empty
    centroid stays. A table without kept vectors gives no rows. All sums are exact.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fits = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & (x * SCALE >= -LARGEST) & (x * SCALE < LARGEST + 1))
    kept = rows.where(F.coalesce(fits, F.lit(False)))
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(key.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = integers(pa.array([r["embedding"] for r in start], pa.list_(pa.float64())), dims)[1]
    pivots = choose_pivots(centroids)
    table = staged(pivot_table(rows, pivots, dims), "pivot-table")
    for _ in range(rounds):
        centroids = moved_centroids(table, centroids, pivots)

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                best, least, _ = nearest(*rows_of(batch, at, len(pivots), dims), centroids, pivots)
                yield pa.record_batch({"vec_id": batch.column("vec_id").slice(at, ROWS), "cluster": pa.array(best, pa.int32()), "distance": pa.array(least)})

    found = staged(table.mapInArrow(read, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = spark.createDataFrame([(c, d, sum(inertia.values()), digest[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(whole), "cluster").select([x.split()[0] for x in schema.split(", ")])
