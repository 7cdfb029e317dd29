"""Quality by importance resampling.

Two bags of hashed n-grams are counted: of the target (documents labelled good) and of
the raw corpus (all documents).  A document's log importance is the sum over its
n-grams of the log ratio of the two models: how much likelier the target is to have
written it.  Documents are then resampled without replacement in proportion to their
importance: each log importance gets Gumbel noise fixed by the document, and the k
greatest stay.  n-grams: words, pairs of words, and runs of up to three word shapes
(how a word begins and ends, its length, whether it repeats the one before).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import small, texts

#: Buckets: the first half for n-grams of words, the second for n-grams of shapes.
BUCKETS = 1 << 14


def _classes() -> np.ndarray:
    """Class of a byte: lower, upper, digit, beyond ASCII, or the mark itself."""
    out = np.arange(256, dtype=np.uint64) + 8
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 3
    return out


_CLASS = _classes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    found = text.encode("utf-8", "surrogatepass").split() if text else []
    n = len(found)
    if not n:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(zlib.crc32, found), np.uint64, n)
    size = np.fromiter(map(len, found), np.int64, n)
    raw = np.frombuffer(b"".join(found), np.uint8)
    ends = np.cumsum(size)
    begins = ends - size
    second = np.where(size > 1, raw[np.minimum(begins + 1, len(raw) - 1)], 0)
    before = np.where(size > 1, raw[ends - 2], 0)
    repeat = np.r_[False, codes[1:] == codes[:-1]].astype(np.uint64)
    shape = _CLASS[raw[begins]]
    for part in (_CLASS[second], _CLASS[before], _CLASS[raw[ends - 1]], np.minimum(size, 24).astype(np.uint64) >> np.uint64(3), repeat):
        shape = shape * np.uint64(0x100000001B3) + part
    half, out = np.uint64(BUCKETS // 2), []
    out.append(_mix(codes) % half)
    out.append(_mix(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) % half)
    run = shape
    for length in (1, 2, 3):
        if length > 1:
            run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[length - 1:] + np.uint64(length)
        out.append(_mix(run) % half + half)
    return np.concatenate(out).astype(np.int64)


def score_of(text: str | None, ratio: np.ndarray) -> float:
    """Log importance: the sum of the log ratios of all n-grams."""
    return float(ratio[ngrams(text)].sum())


def gumbel(doc_id: int | None, text: str | None, seed: int) -> float:
    """Standard Gumbel noise, fixed by row and seed."""
    raw = f"{seed}:{doc_id}:".encode() + (text or "").encode("utf-8", "surrogatepass")
    u = ((xxhash.xxh64_intdigest(raw, seed) >> 11) + 0.5) / (1 << 53)
    return -math.log(-math.log(u))


class Model:
    """Log ratios of the buckets, and the cut below which labelled documents are bad."""

    def __init__(self, ratio: np.ndarray, cut: float, seed: int):
        self.ratio, self.cut, self.seed = ratio, cut, seed

    def keys(self, ids: list, batch: list) -> tuple[np.ndarray, np.ndarray]:
        """Log importance and log importance plus noise of each document."""
        weight = np.array([score_of(t, self.ratio) for t in batch])
        return weight, weight + np.array([gumbel(i, t, self.seed) for i, t in zip(ids, batch)])


def best_cut(weight: np.ndarray, good: np.ndarray, price: float = 10.0) -> float:
    """The importance that parts good from bad at the least cost; a good document lost counts ``price`` times.

    In the middle of the gap between the two labelled rows it falls between; minus
    infinity (nothing is rejected) where no row is labelled bad.
    """
    if good.all() or not good.any():
        return -math.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    lost = np.r_[0, np.cumsum(g)] * price + np.r_[(~g).sum(), (~g).sum() - np.cumsum(~g)]
    i = int(lost.argmin())  # the first i rows are rejected
    return -math.inf if i == 0 else math.inf if i == len(w) else float((w[i - 1] + w[i]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, smoothing: float = 0.5, seed: int = 11) -> Model:
    """The raw model counts all documents; the target model the good ones among at most ``max_labels`` labelled rows.

    The labelled rows are those of the least hashed ids; a doc_id with several labels is
    good if all say so.  Without labelled rows all ratios are zero and nothing is rejected.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    chosen = durable(chosen)

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in small(batches):
            for text, quality in zip(b.column("text").to_pylist(), b.column("quality").to_pylist()):
                each = np.bincount(ngrams(text), minlength=BUCKETS)
                raw += each
                if quality > 0:
                    target += each
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])],
                                         ["bucket", "raw", "target"])

    marked = texts(docs).join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("quality", F.lit(-1)).alias("quality"))
    counted = (marked.mapInArrow(count, "bucket int, raw long, target long")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():  # one row per bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.zeros(BUCKETS)
    if target.sum():
        for part in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS)):
            p = raw[part] + smoothing
            p /= p.sum()
            t = target[part] + 100 * smoothing * p  # n-grams the target lacks follow the raw model
            ratio[part] = np.log(t / t.sum() / p)

    def weigh(batches):
        for b in small(batches):
            weight = [score_of(t, ratio) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(weight, pa.float64()), b.column("quality")], ["doc_id", "weight", "quality"])

    labelled = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    seen = (labelled.mapInArrow(weigh, "doc_id long, weight double, quality int").groupBy("doc_id")
            .agg(F.min("weight").alias("weight"), F.min("quality").alias("quality")).collect())  # at most max_labels ids, however often they stand there
    weight, good = np.array([r["weight"] for r in seen]), np.array([r["quality"] > 0 for r in seen], bool)
    return Model(ratio, best_cut(weight, good) if len(seen) else -math.inf, seed)


def ordered(key: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = key.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def weights(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, log_importance, key, place (the key as a long of the same order) of every row."""
    def run(batches):
        for b in small(batches):
            weight, key = model.keys(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(weight), pa.array(key), pa.array(ordered(key))],
                                             ["doc_id", "log_importance", "key", "place"])

    return texts(docs).mapInArrow(run, "doc_id long, log_importance double, key double, place long")


def kth_place(places: DataFrame, k: int) -> int:
    """The kth greatest place, exactly: counts of 16 bits at a time, from the top."""
    found, rest = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("place", shift) if shift == 48 else F.shiftright("place", shift).bitwiseAND(0xFFFF)
        inside = places if shift == 48 else places.where(F.shiftright("place", shift + 16) == found)
        for r in sorted(inside.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect(), reverse=True):
            if rest <= r["n"]:
                found = r["d"] if shift == 48 else found << 16 | r["d"]
                break
            rest -= r["n"]
    return found


def threshold(weighed: DataFrame, model: Model) -> int:
    """Place of the last document that stays: as many stay as have an importance above the model's cut."""
    k = weighed.where(F.col("log_importance") >= F.lit(model.cut)).count()
    return kth_place(weighed.select("place"), k) if k else (1 << 63) - 1


def quality(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, seed: int = 11) -> DataFrame:
    """doc_id, log_importance, key, selected for every row.

    Selected are the k documents of the greatest log importance plus Gumbel noise (with
    those equal to the kth), k being how many have an importance above the cut that the
    labels ask for.  A missing or empty text has log importance 0; texts of any length
    are read whole; repeated rows get the same noise and share their fate; rows without
    a doc_id take part; other columns are left out.
    """
    model = fit(docs, labels, max_labels, seed=seed)
    weighed = durable(weights(docs, model))
    last = threshold(weighed, model)
    return weighed.select("doc_id", "log_importance", "key", (F.col("place") >= F.lit(last)).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that ``quality`` selects, with all their columns; odd rows fare as there."""
    model = fit(docs, labels, max_labels, seed=seed)
    last = threshold(durable(weights(docs, model).select("log_importance", "place")), model)

    def run(batches):
        for b in small(batches):
            _, key = model.keys(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
            yield b.filter(pa.array(ordered(key) >= last))

    return docs.mapInArrow(run, docs.schema)
