"""What several operators of this folder share: narrow views, words, bit counts, linked groups."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import durable

#: One in every byte of a 64-bit word: eight counters side by side.
_LANES = np.uint64(0x0101010101010101)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds (columns of clashing names are left behind)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small(batches, rows: int = 1000):
    """Arrow batches in slices of few rows, so that what is made of a slice stays small beside the batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def words(text: str | None) -> list[bytes]:
    """UTF-8 words in lower case (A-Z only), cut at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_codes(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def shingle_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """One mixed 64-bit hash for each run of k word codes; a shorter text is one run."""
    if not len(codes):
        return codes
    k = min(k, len(codes))
    n = len(codes) - k + 1
    h = codes[:n].copy()
    for i in range(1, k):
        h = h * np.uint64(0x100000001B3) + codes[i:i + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def bit_majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive groups of hashes: the 64 bits set in over half of each group; 0 for an empty group.

    Eight bits are counted at a time, one in each byte of a word, over runs of at
    most 255 hashes, so that no counter overflows.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full].astype(np.int64)
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first_run, runs)
    at = np.repeat(np.cumsum(n) - n, runs) + 255 * within
    found = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        bits = (counts * 2 > n[:, None]).astype(np.uint64)
        for j in range(8):
            found |= bits[:, j] << np.uint64(k + 8 * j)
    out[full] = found
    return out


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the least node reachable, for every node of a link.

    Each round hooks every node to the least neighbour below it and follows these hooks to
    their ends; the links between different ends are the next round's.  A link is so joined
    once for each of its nodes and gone as soon as they have one label, instead of once a
    round to the last.  The hooks of all rounds are put together at the end.  Hooks are
    partial minima before they are shuffled, and the joins have one row per node on one
    side, so that the other side's hot nodes can be split.
    """
    ends = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where(F.col(a) != F.col(b))
    rest, rounds = durable(ends.distinct()), []
    while not rest.isEmpty():
        hooks = _followed(rest.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("label")))
        rounds.append(hooks)
        moved = rest.join(hooks.select(F.col("node").alias("high"), F.col("label").alias("x")), "high")
        moved = moved.join(hooks.select(F.col("node").alias("low"), F.col("label").alias("y")), "low", "left").select("x", F.coalesce("y", "low").alias("y"))
        rest = durable(moved.where("x != y").select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct())
    if not rounds:
        return rest.select(F.col("low").alias("node"), F.col("high").alias("label"))
    labels = rounds.pop()
    while rounds:  # what a round left as an end may be hooked in a later one
        hooks, further = rounds.pop(), labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
        labels = durable(hooks.join(further, "label", "left").select("node", F.coalesce("end", "label").alias("label")).unionByName(labels))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def _followed(hooks: DataFrame) -> DataFrame:
    """node, label of hooks to lesser nodes, written, each label followed to the end of its chain: rounds grow with the logarithm of its length."""
    def doubled(hooks):
        further = hooks.select(F.col("node").alias("label"), F.col("label").alias("end"))
        return hooks.join(further, "label", "left").select("node", F.coalesce("end", "label").alias("label"))

    while True:
        done = durable(doubled(doubled(hooks)).join(hooks.select(F.col("node").alias("label"), F.lit(True).alias("more")), "label", "left").select("node", "label", "more"))
        hooks = done.select("node", "label")
        if done.where("more").isEmpty():
            return hooks
