"""MinHash near duplicates by SuperMinHash signatures.

Every element of a set walks through a random permutation of the signature's places; its
rank at the jth place it visits is j plus a random fraction, and each place keeps the least
rank.  The ranks of one element are so spread evenly over the places, which lowers the
variance of the share of equal places.  A set is done as soon as its largest kept rank
is below the step: long sets end after the first one.  Bands of the signature are the
keys under which candidates meet; links are verified on whole sets and joined to groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import small, texts, words
from .grouping import groups_of, stars

#: Elements that walk at once: their permutations take ELEMENTS x places bytes.
ELEMENTS = 1 << 16
#: Bands whose candidates are verified before the others'.
FIRST = 6


def mix(h: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def superminhash(codes: np.ndarray, sizes: np.ndarray, places: int) -> np.ndarray:
    """Signatures (a row for each set) of consecutive sets of distinct 64-bit codes; an empty set keeps the largest number everywhere.

    A kept rank is step << 32 | fraction.  All elements take their jth step together; after it
    the sets whose largest rank is below the next step leave, which changes no signature.
    """
    out = np.full((len(sizes), places), np.iinfo(np.uint64).max)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    walk = np.tile(np.arange(places, dtype=np.uint16), (len(codes), 1))
    row = np.arange(len(codes))
    for step in range(places):
        draw = mix(codes + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2 ** 64))
        to = step + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - step)) >> np.uint64(32)).astype(np.int64)
        place = walk[row, to]
        walk[row, to] = walk[row, step]
        np.minimum.at(out.reshape(-1), owner * places + place, np.uint64(step << 32) | (draw >> np.uint64(32)))
        going = (out.max(1) >> np.uint64(32) > step)[owner]
        if not going.any():
            break
        if not going.all():
            codes, owner, row = codes[going], owner[going], row[going]
    return out


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signatures of many sets, in runs of a bounded number of elements; a long set's elements go in parts and keep the least ranks."""
    out = np.full((len(sets), places), np.iinfo(np.uint64).max)
    at = 0
    while at < len(sets):
        to, held = at, 0
        while to < len(sets) and (to == at or held + len(sets[to]) <= ELEMENTS):
            held += len(sets[to])
            to += 1
        if held <= ELEMENTS:
            out[at:to] = superminhash(np.concatenate(sets[at:to]), np.array([len(s) for s in sets[at:to]]), places)
        else:
            for part in range(0, held, ELEMENTS):
                own = sets[at][part:part + ELEMENTS]
                out[at] = np.minimum(out[at], superminhash(own, np.array([len(own)]), places)[0])
        at = to
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of a signature, another one in every band."""
    parts = signature[:, :bands * rows].reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key ^ parts[:, :, i])
    return key


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of k words; fewer words are one shingle, no words none."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(found)}
    codes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    h = np.full(len(codes) - min(k, len(codes)) + 1, min(k, len(codes)), np.uint64)
    for i in range(min(k, len(codes))):
        h = mix(h * np.uint64(0x100000001B3) + codes[i:i + len(h)])
    return np.unique(h)


def marks(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, place (a number of its own), n, two hashes of the whole set and the band keys of every row, written."""
    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in small(batches, 500):
            sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            keys = band_keys(signatures(sets, bands * rows), bands, rows).view(np.int64)
            codes = [np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array((part << 36) + at + np.arange(len(sets))), pa.array([len(s) for s in sets], pa.int64()),
                 *map(pa.array, codes), pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "place", "n", "c1", "c2", "keys"])
            at += len(sets)

    return durable(texts(docs).mapInArrow(run, "doc_id long, place long, n long, c1 long, c2 long, keys array<long>"))


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of the nodes ``wanted`` (node, doc_id, c1, c2), written: only their texts are read into sets again."""
    def run(batches):
        for b in small(batches, 500):
            sets = [shingle_set(t, shingle).astype("<u8").tobytes() for t in b.column("text").to_pylist()]
            codes = [np.array([xxhash.xxh64_intdigest(s, seed) for s in sets], np.uint64).view(np.int64) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, codes), pa.array(sets, pa.binary())], ["c1", "c2", "shingles"])

    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    own = texts(docs)
    asked = own.join(ids.hint("merge"), own["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    found = asked.mapInArrow(run, "c1 long, c2 long, shingles binary").join(wanted.select("node", "c1", "c2").hint("merge"), ["c1", "c2"])
    # a doc_id that stands in several rows brings a set more than once
    return durable(found.groupBy("node").agg(F.min("shingles").alias("shingles")))


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, bands: int = 42, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Documents are linked if their sets of distinct word shingles (words in lower case A-Z,
    cut at ASCII white space; a text of fewer words is one shingle) share ``percent`` of
    their union or more; component_id is the least doc_id reachable, kept says that it is the
    row's own.  A text without words is linked with nothing.  Rows of one doc_id are rows of
    their own; rows without a doc_id are linked too, and a group of such rows alone has no
    component_id.  Texts of any length are read whole; other columns are left out.

    A pair of similarity s meets in some band with probability 1 - (1 - s^rows)^bands:
    at 0.8 all but 3 in a million with 42 bands of 6.  What meets is decided on whole sets.
    """
    marked = marks(docs, shingle, bands, rows)
    kinds = durable(marked.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("node")))
    first = marked.select(F.col("place").alias("node"), "keys").join(kinds.select("node").hint("merge"), "node", "left_semi")
    filed = durable(first.select(F.posexplode("keys").alias("band", "key"), "node"))
    shared = filed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    filed = durable(filed.join(shared.hint("merge"), "key"))

    def late(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of one member of each label under every key."""
        labelled = filed.join(labels.hint("merge"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        return stars(labelled.groupBy("key", "label").agg(F.min("node").alias("node")).select("key", "node")), sets

    wanted = kinds.join(filed.select("node").distinct().hint("merge"), "node")
    sets = sets_of(docs, wanted, shingle)
    labels = groups_of(stars(filed.where(F.col("band") < FIRST).select("key", "node")), sets, percent, late)
    named = kinds.join(labels.hint("merge"), "node", "left").select("c1", "c2", "doc_id", F.coalesce("label", "node").alias("label"))
    named = durable(named)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = durable(named.join(least.hint("merge"), "label").select("c1", "c2", "component_id"))
    grouped = marked.where("n > 0").select("doc_id", "n", "c1", "c2").join(found.hint("merge"), ["c1", "c2"]).select("doc_id", "n", "component_id")
    alone = marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                             F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
