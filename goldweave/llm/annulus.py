"""Centroid clustering with annulus search.

By the triangle inequality a centroid whose norm differs from a vector's norm
by more than an upper bound of the vector's least distance cannot be nearest.
Centroids are kept sorted by norm; the exact distance to a few pilots bounds
each vector, two binary searches cut the annulus of norms out of the sorted
list, and only those centroids are compared, exactly and in integers, so that
ties at the boundary are seen.  A round is one pass over the vectors whose
tasks send one sum and count per centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.durable import bound_batches, durable

SCALE, DIMENSION, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Components of this size and more could leave 64 bits in a squared distance.
LARGEST = 1 << 27
#: Pairs of vector and candidate that are compared at a time.
PAIRS = 1 << 14


class Annulus:
    """Nearest centroids of blocks of integer vectors; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = np.asarray(centroids, dtype=np.int64)
        k = len(self.centroids)
        norms = _norms(self.centroids)
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.pilots = np.unique(np.linspace(0, k - 1, min(k, isqrt(k) + 1)).astype(np.int64))
        self.compared = 0

    def _squared(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        gap = rows - self.centroids[self.order[places]]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector and the squared distance to it."""
        n, k = len(vectors), len(self.centroids)
        norms = _norms(vectors)
        near = np.clip(np.searchsorted(self.norms, norms), 0, k - 1)
        bound = self._squared(vectors, near)
        for p in self.pilots:
            bound = np.minimum(bound, self._squared(vectors, np.full(n, p)))
        # Norms and roots are rounded, so the annulus is widened by more than their error: further candidates do no harm.
        reach = np.sqrt(bound.astype(np.float64)) * (1 + 1e-9) + norms * 1e-9 + 1e-6
        low = np.searchsorted(self.norms, norms - reach, side="left")
        high = np.searchsorted(self.norms, norms + reach, side="right")
        width = high - low
        self.compared += int(width.sum())
        best = np.full(n, np.iinfo(np.int64).max)
        cluster = np.full(n, k)
        ends = np.cumsum(width)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            row = np.repeat(np.arange(at, to), width[at:to])
            starts = ends[at:to] - width[at:to] - (ends[at - 1] if at else 0)
            place = np.arange(len(row)) - np.repeat(starts - low[at:to], width[at:to])
            found = self._squared(vectors[row], place)
            least = np.minimum.reduceat(found, starts)
            number = np.where(found == np.repeat(least, width[at:to]), self.order[place], k)
            best[at:to], cluster[at:to] = least, np.minimum.reduceat(number, starts)
            at = to
        return cluster, best


def _norms(vectors: np.ndarray) -> np.ndarray:
    exact = vectors.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", exact, exact))


def _whole(column: pa.Array, dimension: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dimension)


def _kept(vectors: DataFrame, id_col: str, vector_col: str, dimension: int, scale: int) -> DataFrame:
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST / scale))
    return vectors.where((F.size(v) == dimension) & whole).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _first(kept: DataFrame, clusters: int, dimension: int, scale: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes; a driver's list of ``clusters`` rows."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    rows = kept.select(key.alias("key"), ints.alias("v")).orderBy("key", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(-1, dimension)


def _sums(kept: DataFrame, centroids: np.ndarray, dimension: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each centroid's vectors; one row per centroid reaches the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Annulus(centroids), len(centroids)
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimension), dtype=np.int64)
        schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

        def sent() -> pa.RecordBatch:
            own = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], schema=schema)

        rows = 0
        for batch in batches:
            block = _whole(batch.column(0), dimension, scale)
            own, _ = search.nearest(block)
            order = np.argsort(own, kind="stable")
            numbers, starts = np.unique(own[order], return_index=True)
            total[numbers] += np.add.reduceat(block[order], starts, axis=0)
            count += np.bincount(own, minlength=k)
            rows += len(block)
            if rows > (1 << 62) // LARGEST:
                yield sent()
                count[:], total[:], rows = 0, 0, 0
        yield sent()

    parts = kept.select("v").mapInArrow(partial, "cluster int, n long, s array<long>")
    # Sums are decimal, so that no number of rows leaves their range.
    folded = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(dimension)]).alias("s"))
    return {r.cluster: (r.n, [int(x) for x in r.s]) for r in folded.collect()}


def _assigned(kept: DataFrame, centroids: np.ndarray, dimension: int, scale: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            own, far = search.nearest(_whole(batch.column(1), dimension, scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(assign, "vec_id long, cluster int, distance long")


def _digest(centroid: Column) -> Column:
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)


def cluster_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, clusters: int = CLUSTERS, rounds: int = ROUNDS,
    scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>), centroid_sha256.

    Vectors with exactly ``dimension`` components, none null, non-finite or of
    a size of 2**27 after scaling (whose squared distances could leave 64
    bits), become integers ``floor(scale * x)``; others give no row.  The first
    centroids are the vectors with the smallest sha256 of seed and id, fewer
    where there are fewer vectors; rows of one hash (a null id is hashed as no
    digits) are ordered by their components.  A round moves every centroid
    with vectors to the floor of their mean; the others stay.  Distances are
    squared and exact; ties go to the smaller number.  Repeated rows count as
    often as they stand there; further columns are not read; no vectors give
    no rows.

    The vectors are read once for the first centroids, once a round and once
    for the result.  Nothing grows with them but the result itself: centroids
    (``clusters`` x ``dimension`` numbers) travel with the tasks, one partial
    sum per centroid and task is shuffled, and a lost task is run again from
    the source.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 4096)
    kept = _kept(vectors, id_col, vector_col, dimension, scale)
    centroids = _first(kept, clusters, dimension, scale, seed)
    shape = "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        none = spark.createDataFrame([], "vec_id long, distance long, " + shape)
        return none.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", _digest(F.col("centroid")).alias("centroid_sha256"))
    for _ in range(rounds):
        moved = _sums(kept, centroids, dimension, scale)
        centroids = np.array([[s // moved[c][0] for s in moved[c][1]] if c in moved else own.tolist() for c, own in enumerate(centroids)], dtype=np.int64)
    assigned = durable(_assigned(kept, centroids, dimension, scale), "assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    facts = spark.createDataFrame([(c, s, total, centroids[c].tolist()) for c, s in sorted(inertia.items())], shape).withColumn("centroid_sha256", _digest(F.col("centroid")))
    out = assigned.join(F.broadcast(facts), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
