"""Centroid clustering over zone maps in the order of a Hilbert curve.

Vectors are put in the order of a space-filling curve and cut into blocks of a few
hundred neighbours; each block carries the least and greatest value of every component.
The distance from a centroid to that box bounds its distance to every vector of the
block from both sides: a centroid that is farther at best than another one is at worst
cannot be the nearest of any of them.  Only a block's candidates are compared with its
vectors.  All sums and distances are exact integers.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import durable

#: Components whose integers are this large or larger keep a vector out: they are no longs that could be taken apart.
LARGEST = 2.0 ** 62
#: Vectors of a block.
BLOCK = 256


def integers(vectors: DataFrame, dim: int, scale: int, id_col: str, value_col: str) -> DataFrame:
    """id, x (floor(scale * component) as int64 little-endian) and place (a number of its own) of the vectors that take part."""
    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            lists = b.column("v")
            whole = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)
            ids, lists = b.column("id").filter(whole), lists.filter(whole)
            x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))  # nulls are NaN
            kept = np.flatnonzero((np.abs(x) < LARGEST).all(1))
            rows = x[kept].astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(kept)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array((part << 36) + at + np.arange(len(rows)))],
                ["id", "x", "place"])
            at += len(rows)

    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "id long, x binary, place long")


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve, as rows of bytes, of points with ``bits`` bits a coordinate.

    The exchanges and inversions of the curve's turns are undone bit plane by bit plane
    for all points at once; the Gray code of what remains, interleaved, is the place.
    """
    x = cells.T.astype(np.int64)
    dim = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dim):
            turned = (x[i] >> level) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, dim):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    planes = np.concatenate([(x >> level) & 1 for level in range(bits - 1, -1, -1)]).astype(np.uint8)
    return np.packbits(planes, axis=0).T


def _spread(kept: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every component: they only shape the curve's cells."""
    def run(batches):
        n, total, square = 0, np.zeros(dim), np.zeros(dim)
        for b in batches:
            x = matrix(b.column("x"), dim).astype(np.float64)
            n, total, square = n + len(x), total + x.sum(0), square + (x * x).sum(0)
        yield pa.RecordBatch.from_pylist([{"n": n, "s": total.tolist(), "q": square.tolist()}])

    parts = kept.select("x").mapInArrow(run, "n long, s array<double>, q array<double>")
    row = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in "sq" for i in range(dim)]).first()
    mean, square = (np.array([row[f"{c}{i}"] for i in range(dim)], np.float64) / max(row["n"] or 0, 1) for c in "sq")
    return mean, np.sqrt(np.maximum(square - mean * mean, 0))


def zone_map(kept: DataFrame, dim: int, block_rows: int = BLOCK) -> DataFrame:
    """The written blocks: n, ids, x of all vectors in Hilbert order, low and high of every component.

    Four cells a component, marked at the mean and a standard deviation to either side;
    the components that spread most come first on the curve.  Equal places are told apart by
    a mixed row number, so that a vector that stands there very often fills many partitions.
    """
    mean, deviation = _spread(kept, dim)
    order = np.argsort(-deviation, kind="stable")
    marks = [mean + t * deviation for t in (-1, 0, 1)]

    def keys(batches):
        for b in batches:
            x = matrix(b.column("x"), dim)
            cells = sum((x > m).astype(np.int64) for m in marks)[:, order]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([k.tobytes() for k in hilbert(cells, 2)], pa.binary())], ["id", "x", "place", "key"])

    def blocks(batches):
        held_id, held = [], []

        def block(rows):
            x = np.frombuffer(b"".join(held[:rows]), "<i8").reshape(-1, dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(x)], pa.int32()), pa.array([held_id[:rows]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()),
                 pa.array([x.min(0).tobytes()], pa.binary()), pa.array([x.max(0).tobytes()], pa.binary())], ["n", "ids", "x", "low", "high"])

        for b in batches:
            held_id += b.column("id").to_pylist()
            held += b.column("x").to_pylist()
            while len(held) >= block_rows:
                yield block(block_rows)
                held_id, held = held_id[block_rows:], held[block_rows:]
        if held:
            yield block(len(held))

    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept.mapInArrow(keys, "id long, x binary, place long, key binary").withColumn("place", F.xxhash64("place"))
    return durable(placed.repartitionByRange(parts, "key", "place").sortWithinPartitions("key", "place").select("id", "x")
                   .mapInArrow(blocks, "n int, ids array<long>, x binary, low binary, high binary"))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be the nearest of a vector in the box."""
    least = np.maximum(0, np.maximum(low - centroids, centroids - high))
    most = np.maximum(np.abs(low - centroids), np.abs(high - centroids))
    least, most = (least * least).sum(1), (most * most).sum(1)
    return np.flatnonzero(least <= most.min())


def exact(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A type in which all squared distances of the block are exact, as (x, centroids): float64, int64 or Python's integers."""
    largest = max(int(np.abs(a).max()) for a in (low, high, centroids))
    room = 4 * x.shape[1] * largest * largest
    kind = np.float64 if room < 2 ** 53 else np.int64 if room < 2 ** 63 else object
    return x.astype(kind), centroids.astype(kind)


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Number of each vector's nearest centroid (ties: the smaller number) and the squared distance, which a lone candidate leaves out."""
    box_low, box = exact(low[None, :], low, high, centroids)
    near = candidates(box_low[0], high.astype(box.dtype), box)
    if len(near) == 1:
        return np.full(len(x), near[0]), None
    own, some = exact(x, low, high, centroids[near])
    if own.dtype == np.float64:
        apart = (own * own).sum(1)[:, None] - 2 * (own @ some.T) + (some * some).sum(1)
    else:
        apart = np.stack([((own - c) ** 2).sum(1) for c in some], axis=1)
    first = np.argmin(apart, axis=1)  # the first of equal ones
    return near[first], apart[np.arange(len(x)), first]


def _block_rows(batch, dim: int):
    for n, ids, x, low, high in zip(*(batch.column(c) for c in ("n", "ids", "x", "low", "high"))):
        yield ids, *(np.frombuffer(v.as_py(), "<i8").reshape(s) for v, s in ((x, (-1, dim)), (low, dim), (high, dim)))


def _sums(centroids: np.ndarray, dim: int):
    """Task function: for each centroid the number of its vectors and their exact sums, a row a task and centroid."""
    def run(batches):
        count = [0] * len(centroids)
        total = np.zeros((len(centroids), dim), object)
        for b in batches:
            for _, x, low, high in _block_rows(b, dim):
                label, _ = nearest(x, low, high, centroids)
                large = max(int(np.abs(low).max()), int(np.abs(high).max())) * len(x) >= 2 ** 63
                for c in np.unique(label):
                    own = x[label == c]
                    count[c] += len(own)
                    total[c] += (own.astype(object) if large else own).sum(0)
        used = [c for c, n in enumerate(count) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([count[c] for c in used], pa.int64()),
             pa.array([[Decimal(int(v)) for v in total[c]] for c in used], pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "total"])

    return run


def _assign(centroids: np.ndarray, dim: int):
    """Task function: id, cluster and squared distance of every vector; a distance that no long holds is missing."""
    def run(batches):
        for b in batches:
            for ids, x, low, high in _block_rows(b, dim):
                label, apart = nearest(x, low, high, centroids)
                if apart is None:
                    own, c = exact(x, low, high, centroids[label[:1]])
                    apart = ((own - c) ** 2).sum(1)
                found = pa.array([int(v) if v < 2 ** 63 else None for v in apart], pa.int64()) if apart.dtype == object else pa.array(apart.astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(label.astype(np.int32)), found], ["id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id",
             value_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors of exactly ``dim`` components, none of them null or not finite, become the
    integers floor(scale * x).  The first centroids are the k vectors with the least
    sha256 of ``seed:id`` (a missing id is empty text; equal hashes go by the components);
    each round gives every vector to its nearest centroid (ties: the smaller number) and
    moves every centroid that has vectors to the floor of their mean.  Repeated rows are
    vectors of their own; fewer than k vectors make fewer clusters; no vector, no row.
    Integers of 2^62 or more keep their vector out, and a squared distance or a sum of them
    that no long holds is missing.  Other columns are left out.
    """
    kept = durable(integers(vectors, dim, scale, id_col, value_col))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = kept.select("x", F.sha2(name.cast("binary"), 256).alias("h")).orderBy("h", "x").limit(k).collect()
    blocks = zone_map(kept, dim)
    centroids = np.array([np.frombuffer(r["x"], "<i8") for r in first], np.int64).reshape(-1, dim)
    for _ in range(rounds if first else 0):
        found = blocks.mapInArrow(_sums(centroids, dim), "cluster int, n long, total array<decimal(38,0)>")
        for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)]).collect():
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    placed = durable(blocks.mapInArrow(_assign(centroids, dim), "id long, cluster int, distance long")) if first else (
        kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
               if r["s"] is not None}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def long_of(value):
        return F.lit(value if value is not None and value < 2 ** 63 else None).cast("long")

    def by_cluster(values):
        return F.element_at(F.array(*values, F.lit(None)), F.col("cluster") + 1)

    return placed.select(
        F.col("id").alias(id_col), "cluster", "distance", by_cluster([long_of(inertia.get(c)) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        long_of(sum(inertia.values())).alias("inertia"), by_cluster([F.lit(d) for d in digest]).cast("string").alias("centroid_sha256"))
