"""Exact top-k search by inner product over a vector-approximation file.

The file holds each distinct vector as one small cell number per component.  A cell
gives bounds for every score: the query times the cell's middle, plus or minus the
query's size times half a cell.  One scan of the cells names for each query the rows
whose upper bound reaches a score that k rows are certain to have.  Their exact vectors
are then fetched by row number, best bound first, until the kth exact score is no lower
than the next bound.  In the scan the cells lie in groups of bounded size, each read
once; the queries pass by every group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable

#: Cells of a component.
CELLS = 256
#: Scores beyond a long are given as the nearest long.
_LEAST, _MOST = -2 ** 63, 2 ** 63 - 1
_BLOCK = "block long, dim int, rows binary, body binary, low binary, width binary"
_SCANNED = pa.schema([("q_row", pa.int64()), ("row", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])


def _whole(batches):
    """row, vec_id, dim and the integers of each vector: 32 bits a component, or doubles where one needs more."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        lists, ids = b.column("embedding"), b.column("vec_id").to_pylist()
        numbers, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        there = lists.is_valid().to_numpy(zero_copy_only=False)
        out = []
        for i, own in enumerate(ids):
            at += 1
            x = numbers[ends[i]:ends[i + 1]]
            if own is None or not there[i] or not len(x) or not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.nan_to_num(np.floor(256 * x)) + 0.0
            small = np.abs(x).max() < 2 ** 31
            out.append((part << 32 | at, own, len(x), (x.astype(np.int32) if small else x).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             ["row", "vec_id", "dim", "exact"])


def _numbers(raw: bytes, dim: int, n: int = 1) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * dim * n else np.float64).reshape(n, dim)


def _blocked(batches, block_rows: int):
    """Runs of at most ``block_rows`` rows of one length and one kind of number: dim, rows, matrix."""
    held: dict[tuple, list] = {}
    for b in batches:
        for row, dim, exact in zip(*(b.column(c).to_pylist() for c in ("row", "dim", "exact"))):
            rows = held.setdefault((dim, len(exact)), [])
            rows.append((row, exact))
            if len(rows) >= block_rows:
                yield dim, np.array([r for r, _ in rows]), _numbers(b"".join(x for _, x in rows), dim, len(rows))
                rows.clear()
    for (dim, _), rows in held.items():
        if rows:
            yield dim, np.array([r for r, _ in rows]), _numbers(b"".join(x for _, x in rows), dim, len(rows))


def _to_blocks(block_rows: int, cells: int | None):
    """Blocks of rows, as cells (with each component's lowest mark and cell width) or, without ``cells``, as they are."""
    def run(batches):
        part = TaskContext.get().partitionId()
        for made, (dim, rows, x) in enumerate(_blocked(batches, block_rows)):
            low = width = np.zeros(0)
            if cells:
                x = x.astype(np.float64)
                with np.errstate(all="ignore"):
                    low = x.min(0)
                    width = np.maximum(1, np.ceil((x.max(0) - low + 1) / cells))
                    x = np.nan_to_num(np.clip(np.floor((x - low) / width), 0, cells - 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made], pa.int64()), pa.array([dim], pa.int32()),
                 *(pa.array([a.tobytes()], pa.binary()) for a in (rows, x, low, width))],
                ["block", "dim", "rows", "body", "low", "width"])

    return run


def vector_file(rows: DataFrame, k: int, block_rows: int = 4096, cells: int = CELLS) -> DataFrame:
    """The written file: blocks of cells of every vector that can be among the k best of some query.

    Of equal vectors only the k + 1 rows of least vec_id can be (one of them may be the
    query itself), so that copies cost nothing.  A cell is as wide as the block's range
    of that component divided by ``cells`` (at most 256): no pass over all data is
    needed to place the marks.
    """
    order = Window.partitionBy("dim", "exact").orderBy("vec_id", "row")
    kept = rows.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1)
    return durable(kept.select("row", "dim", "exact").mapInArrow(_to_blocks(block_rows, cells), _BLOCK))


def _bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every score: half a cell for each component, and what rounding can make of it."""
    with np.errstate(all="ignore"):
        size, half = np.abs(q), (width - 1) / 2
        most = np.maximum(np.abs(low), np.abs(low + width * cut))
        middle = q @ (cells * width + low + half).T
        room = (size @ half + size @ most * ((len(low) + 16) * 4e-16))[:, None]
        return (np.nan_to_num(np.clip(middle - room, _LEAST, _MOST), nan=_LEAST),
                np.nan_to_num(np.clip(middle + room, _LEAST, _MOST), nan=_MOST))


def _scan(k: int, cut: int, most_held: int = 1 << 20):
    """Candidates of each passing query block among a group's cells, which come first and are held."""
    def found(q, q_rows, blocks):
        best, parts, held = np.full((len(q), k), -np.inf), [], 0

        def above():
            at, rows, lower, upper = (np.concatenate(c) for c in zip(*parts))
            good = upper >= best.min(1)[at]
            return at[good], rows[good], lower[good], upper[good]

        def batch(at, rows, lower, upper):
            return pa.RecordBatch.from_arrays([pa.array(q_rows[at]), pa.array(rows), pa.array(lower), pa.array(upper)], schema=_SCANNED)

        for rows, cells, low, width in blocks:
            lower, upper = _bounds(q, cells, low, width, cut)
            own = q_rows[:, None] == rows[None, :]
            lower[own] = upper[own] = -np.inf
            best = -np.partition(-np.hstack([best, lower]), k - 1, axis=1)[:, :k]
            at, to = np.nonzero((upper >= best.min(1)[:, None]) & (upper > -np.inf))
            parts.append((at, rows[to], lower[at, to], upper[at, to]))
            held += len(at)
            if held > most_held:
                parts = [above()]
                held = len(parts[0][0])
                if held > most_held // 2:
                    yield batch(*parts.pop())
                    held = 0
        if parts:
            yield batch(*above())

    def run(batches):
        group, blocks = None, {}
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if r["team"] != group:
                    group, blocks = r["team"], {}
                rows, dim = np.frombuffer(r["rows"], np.int64), r["dim"]
                if r["asks"]:
                    q = _numbers(r["body"], dim, len(rows)).astype(np.float64)
                    yield from found(q, rows, blocks.get(dim, ()))
                else:
                    blocks.setdefault(dim, []).append((rows, np.frombuffer(r["body"], np.uint8).reshape(-1, dim),
                                                       np.frombuffer(r["low"]), np.frombuffer(r["width"])))

    return run


def _product(q: bytes, x: bytes, dim: int) -> int:
    """The exact score, or the nearest long."""
    a, b = _numbers(q, dim)[0], _numbers(x, dim)[0]
    if float(np.abs(a).max()) * float(np.abs(b).max()) * dim < 2 ** 62:
        return int(a.astype(np.int64) @ b.astype(np.int64)) if a.dtype == b.dtype == np.int32 else sum(int(u) * int(v) for u, v in zip(a, b))
    return min(max(sum(int(u) * int(v) for u, v in zip(a.tolist(), b.tolist())), _LEAST), _MOST)


def _exact(batches):
    for b in batches:
        q, x, dim = (b.column(c).to_pylist() for c in ("q_exact", "exact", "dim"))
        yield pa.RecordBatch.from_arrays([b.column("q_row"), b.column("query_id"), b.column("vec_id"),
                                          pa.array(map(_product, q, x, dim), pa.int64())], ["q_row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, block_rows: int = 4096, query_rows: int = 256,
          group_bytes: int = 32 << 20, cells: int = CELLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest inner products of floor(256 x) for every query.

    Queries: rows whose vec_id is divisible by ``every``; candidates: all rows but the
    query's own.  Ties go to the smaller vec_id.  Vectors that are null, empty, or hold
    a null or a number that is not finite take no part, nor do rows without a vec_id;
    only vectors of equal length are compared.  A score that no long holds is given and
    ranked as the nearest long.  Repeated rows are rows of their own.  A query without
    candidates has no row.  Other columns are left out.

    In the scan a task holds a group of at most some ``group_bytes`` of cells, and every
    query is sent to every group: what is shuffled is the cells once and the queries once
    a group.  Exact vectors are fetched by an equality join on the row in rounds of 4 k,
    32 k, ... rows a query, and only those whose bound reaches the kth score so far.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = durable(plain.mapInArrow(_whole, "row long, vec_id long, dim int, exact binary"))
    file = vector_file(rows, k, block_rows, cells)
    held = file.agg(F.sum(F.length("body")).alias("bytes"), F.count("*").alias("blocks")).first()
    teams = max(1, -(-(held["bytes"] or 0) // group_bytes), min(held["blocks"], spark.sparkContext.defaultParallelism))

    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = asked.mapInArrow(_to_blocks(query_rows, None), _BLOCK)
    met = (file.withColumn("team", F.expr(f"cast(pmod(xxhash64(block), {teams}) AS int)")).withColumn("asks", F.lit(False))
           .unionByName(blocks.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1)))).withColumn("asks", F.lit(True))))
    found = durable(met.repartitionById(teams, F.col("team")).sortWithinPartitions("team", "asks")
                    .mapInArrow(_scan(k, cells), "q_row long, row long, lower double, upper double"))

    certain = Window.partitionBy("q_row").orderBy(F.desc("lower"))
    floors = (found.withColumn("n", F.row_number().over(certain)).where(F.col("n") <= k)
              .groupBy("q_row").agg(F.when(F.count("*") == k, F.min("lower")).alias("floor")))
    likely = Window.partitionBy("q_row").orderBy(F.desc("upper"), "row")
    live = durable(found.join(floors, "q_row").where("floor IS NULL OR upper >= floor")
                   .select("q_row", "row", "upper", F.row_number().over(likely).alias("step")))
    wanted = asked.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("exact").alias("q_exact"))
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    best, upto = None, 4 * k
    while True:
        read = live.where(F.col("step") <= upto).join(rows, "row").join(wanted, "q_row")
        scored = read.select("q_row", "query_id", "vec_id", "dim", "q_exact", "exact").mapInArrow(
            _exact, "q_row long, query_id long, vec_id long, score long")
        scored = scored if best is None else scored.unionByName(best.drop("rank"))
        best = durable(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        kth = best.groupBy("q_row").agg(F.min("score").alias("kth"))
        live = durable(live.where(F.col("step") > upto).join(kth, "q_row").where("upper >= kth").drop("kth"))
        if live.isEmpty():
            return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        upto *= 8
