"""Centroid clustering over zone maps along a space-filling curve.

Vectors are ordered by a Hilbert curve through their projections on a few axes and
cut into blocks; each block keeps the box of its least and greatest components. Over
a box the difference of the distances to two centroids is linear in each component,
so its least value is exact: a centroid that is nowhere in the box nearer than the
one nearest to the box's middle is no candidate of the block. The vectors of a block
are compared with its candidates alone, exactly, in whole numbers; a block with one
candidate is assigned by its box. Centroids move by sums that each task adds up
first, so a round brings a row for each centroid and component to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, materialize, settled

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors in a block.
BLOCK = 128
#: Axes of the curve, bits for each, and the vectors of the sample that the axes and their bins are fitted on.
AXES, BITS, SAMPLE = 8, 4, 4096
#: Whole numbers below this have squared distances of 64 components within 64 bits; larger ones are worked on as Python integers.
_PLAIN = 1 << 27
_LONG = (1 << 63) - 1
_HASHES = 1 << 60


def kept_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """ROW, vec_id and scaled (scale * embedding, doubles) of the vectors with exactly `size` components, none null or non-finite, also when scaled."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * float(scale))
    rows = vectors.select(F.monotonically_increasing_id().alias(ROW), F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("scaled"))
    finite = F.forall("scaled", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return rows.filter((F.size("scaled") == size) & finite)


def id_hash(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def least_hashed(kept: DataFrame, n_rows: int, most: int, seed: int) -> list[list[float]]:
    """The scaled vectors of the `most` least hashes of the ids, in order; equal hashes by the vector, null ids last.

    Only rows under a bound on the hash, some four times as many as wanted, are
    ordered; the bound is raised until there are enough.
    """
    hashed = kept.withColumn("_h", id_hash(seed))
    bound = min(_HASHES, -(-_HASHES * (4 * most + 16) // max(n_rows, 1)))
    while True:
        under = F.conv(F.substring("_h", 1, 15), 16, 10).cast("long") < bound
        near = hashed.filter(under if bound < _HASHES else F.lit(True))
        found = near.orderBy(F.col("_h").asc_nulls_last(), "scaled").limit(most).select("scaled").collect()
        if len(found) == min(most, n_rows) or bound == _HASHES:
            return [r[0] for r in found]
        bound = min(_HASHES, 16 * bound)


def whole(scaled: np.ndarray) -> np.ndarray:
    """floor() of doubles as 64-bit integers, or as Python integers where these are large."""
    down = np.floor(scaled)
    if not down.size or np.abs(down).max() < _PLAIN:
        return down.astype(np.int64)
    return np.array([int(x) for x in down.reshape(-1)] + [None], object)[:-1].reshape(down.shape)


class Curve:
    """The Hilbert index of a vector's bins on the principal axes of a sample; the bins are the sample's quantiles."""

    def __init__(self, sample: np.ndarray, axes: int = AXES, bits: int = BITS):
        middle = sample.mean(axis=0)
        spread = max(float(np.abs(sample - middle).max()), 1e-300)
        _, _, directions = np.linalg.svd((sample - middle) / spread, full_matrices=False)
        self.middle, self.spread, self.axes, self.bits = middle, spread, directions[:axes].T, bits
        self.edges = np.quantile(self._along(sample), np.arange(1, 1 << bits) / (1 << bits), axis=0)

    def _along(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.middle) / self.spread @ self.axes

    def index(self, vectors: np.ndarray) -> np.ndarray:
        along = self._along(vectors)
        x = [np.searchsorted(self.edges[:, i], along[:, i]).astype(np.int64) for i in range(along.shape[1])]
        n, top = len(x), 1 << (self.bits - 1)
        low = top
        while low > 1:  # from the axes' bits to the curve's: undo the turns of each level
            mask = low - 1
            for i in range(n):
                on = (x[i] & low) != 0
                swap = np.where(on, 0, (x[0] ^ x[i]) & mask)
                x[0] = np.where(on, x[0] ^ mask, x[0] ^ swap)
                x[i] = x[i] ^ swap if i else x[i]
            low >>= 1
        for i in range(1, n):
            x[i] ^= x[i - 1]
        turn, low = np.zeros_like(x[0]), top
        while low > 1:
            turn = np.where((x[-1] & low) != 0, turn ^ (low - 1), turn)
            low >>= 1
        out = np.zeros_like(x[0])
        for level in range(self.bits - 1, -1, -1):
            for i in range(n):
                out = out << 1 | ((x[i] ^ turn) >> level & 1)
        return out


def blocks_along(kept: DataFrame, curve: Curve, size: int, block: int) -> DataFrame:
    """The vectors in blocks along the curve: ids, box (least, then greatest components) and scaled, the vectors one after the other.

    Ranges of the curve are cut by a hash of the row too, so equal vectors, however many, spread over the tasks.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = flat(b.column(2)).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(curve.index(vectors))], [ROW, "vec_id", "scaled", "curve"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = np.zeros(0, object), np.zeros((0, size))

        def out(n: int) -> pa.RecordBatch:
            parts = [slice(i, i + block) for i in range(0, n, block)]
            boxes = [np.floor(np.concatenate((vectors[p].min(axis=0), vectors[p].max(axis=0)))) for p in parts]
            cols = [pa.array([ids[p].tolist() for p in parts], pa.list_(pa.int64())), pa.array(boxes, pa.list_(pa.float64())), pa.array([vectors[p].reshape(-1) for p in parts], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(cols, ["ids", "box", "scaled"])

        for b in batches:
            new = np.array(b.column(0).to_pylist() + [0], object)[:-1]
            ids, vectors = np.concatenate((ids, new)), np.concatenate((vectors, flat(b.column(1)).reshape(-1, size)))
            if n := len(ids) // block * block:
                yield out(n)
                ids, vectors = ids[n:], vectors[n:]
        if len(ids):
            yield out(len(ids))

    rows = kept.select(ROW, "vec_id", "scaled").mapInArrow(placed, f"{ROW} long, vec_id long, scaled array<double>, curve long")
    order = ["curve", F.xxhash64(ROW)]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "scaled")
    return materialize(ranged.mapInArrow(cut, "ids array<long>, box array<double>, scaled array<double>"))


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def candidates(box: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids, by number, that may be the nearest of a point of the box (least, greatest components)."""
    least, most = box
    norms = (centroids * centroids).sum(axis=1)
    middle = (least + most) // 2
    best = int(np.argmin(norms - 2 * (centroids @ middle)))
    slope = -2 * (centroids - centroids[best])
    ahead = np.where(slope > 0, slope * least, slope * most).sum(axis=1) + norms - norms[best]
    # ahead: the least by which a centroid is farther than the best one; equal distances go to the smaller number.
    numbers = np.arange(len(centroids))
    return np.flatnonzero((ahead < 0) | ((ahead == 0) & (numbers <= best)) | (numbers == best))


def assigned(box: np.ndarray, scaled: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's vectors in whole numbers, and of each the nearest centroid's number and the squared distance."""
    ends, vectors = whole(box), whole(scaled)
    if object in (ends.dtype, centroids.dtype):
        ends, vectors, centroids = ends.astype(object), vectors.astype(object), centroids.astype(object)
    near = candidates(ends, centroids)
    apart = vectors[:, None, :] - centroids[near][None, :, :]
    distances = (apart * apart).sum(axis=2)
    first = distances.argmin(axis=1)
    return vectors, near[first], distances[np.arange(len(vectors)), first]


def blocks_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for ids, box, scaled in zip(*(batch.column(i) for i in range(3))):
        yield ids.as_py(), np.array(box.values, np.float64).reshape(2, size), np.array(scaled.values, np.float64).reshape(-1, size)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: of each with vectors, the floor of their mean; the others stay."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), np.zeros((k, size), object)
        for batch in batches:
            for _, box, scaled in blocks_of(batch, size):
                vectors, cluster, _ = assigned(box, scaled, centroids)
                for c in np.unique(cluster):
                    own = vectors[cluster == c]
                    counts[c] += len(own)
                    totals[c] += own.sum(axis=0).astype(object)
        there = np.flatnonzero(counts)
        cols = [pa.array(there, pa.int32()), pa.array(counts[there]), pa.array([[Decimal(int(x)) for x in totals[c]] for c in there], pa.list_(pa.decimal128(38, 0)))]
        yield pa.RecordBatch.from_arrays(cols, ["cluster", "n", "sums"])

    parts = blocks.mapInArrow(sums, "cluster int, n long, sums array<decimal(38,0)>").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    out = centroids.copy()
    means = [(r.cluster, r.i, int(r.x) // r.n) for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()]
    if any(abs(x) >= _PLAIN for *_, x in means):
        out = out.astype(object)
    for c, i, x in means:
        out[c, i] = x
    return out


def cluster_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector of vectors (vec_id, embedding).

    Vectors of another number of components, or with a null or non-finite one, are
    left out. There are fewer centroids than k only if there are fewer vectors. Repeated
    rows count as often as they occur; a null vec_id stays null and starts no centroid
    while others can; other columns are not read; an empty table gives no rows. Distances
    and sums of them that exceed a long are null. Components are exact to 10 ** 28.
    """
    kept = kept_vectors(settled(vectors), size, scale)
    n_rows = kept.count()
    starts = np.array(least_hashed(kept, n_rows, k, seed), np.float64).reshape(-1, size)
    centroids = whole(starts)
    fitted = np.array(least_hashed(kept, n_rows, sample, seed), np.float64).reshape(-1, size) if n_rows else np.zeros((1, size))
    blocks = blocks_along(kept, Curve(fitted), size, block)
    for _ in range(rounds if n_rows else 0):
        centroids = moved(blocks, centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, clusters, distances = [], [], []
            for own, box, scaled in blocks_of(batch, size):
                _, cluster, distance = assigned(box, scaled, centroids)
                ids += own
                clusters.append(cluster)
                distances += [d if d <= _LONG else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(clusters), pa.int32()) if clusters else pa.array([], pa.int32()), pa.array(distances, pa.int64())], ["vec_id", "cluster", "distance"])

    found = materialize(blocks.mapInArrow(nearest, "vec_id long, cluster int, distance long"))
    # A row for each centroid.
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.count("distance").alias("m")).collect()
    inertia = {r.cluster: int(r.s) if r.n == r.m and r.s <= _LONG else None for r in own}
    total = None if None in inertia.values() or sum(inertia.values()) > _LONG else sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, x, total, digest[c]) for c, x in inertia.items()]
    totals = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
