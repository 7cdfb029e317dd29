"""SimHash near duplicates by multi-index hashing.

A fingerprint has one bit for each of 64 hash bits, set where over half of the
shingles set it.  Two fingerprints within ``radius`` bits agree, by the pigeonhole
principle, up to a few bits in one of the segments the 64 bits are cut into.  Each
fingerprint is therefore filed under the small Hamming ball around each of its
segments; texts under the same key are compared over all 64 bits.  The balls of two
fingerprints meet half way, so a tolerance of two bits takes the 32 neighbours at one bit.

A key's members are linked by a least spanning forest (members - 1 links at most),
not by all their pairs.  Keys of more than ``limit`` members are cut into blocks and
every two blocks are linked for themselves: exact, with groups of bounded size.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import bit_majority, connected, small, texts, words
from .grouping import groups_of
from .minhash import mix, shingle_set

#: Members of one key that a task links at once: 4,096 of them take 8 million distances.
LIMIT = 4096


def simhashes(batch: list, shingle: int, prints: int = 1, distinct: bool = False) -> list[np.ndarray]:
    """64-bit fingerprints of texts; hash: XXH64 with seed 42 of the words joined by a space.

    Every further one of ``prints`` fingerprints mixes the same hashes anew.  ``distinct``
    counts a shingle once however often it stands in the text.
    """
    digest, parts, sizes, held = xxhash.xxh64_digest, [], [], 0
    out: list[list] = [[] for _ in range(prints)]

    def flush() -> None:
        h = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
        for each in out:
            each.append(bit_majority(h, np.array(sizes, np.int64)))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)

    for text in batch:
        found = words(text)
        if not found:
            sizes.append(0)
            continue
        joined = b" ".join(found)
        k = min(shingle, len(found))
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = [0, *ends[:len(found) - k].tolist()]
        stops = (ends[k - 1:] - 1).tolist()
        hashes = [digest(joined[i:j], 42) for i, j in zip(starts, stops)]
        if distinct:
            hashes = set(hashes)
        parts.append(b"".join(hashes))
        sizes.append(len(hashes))
        held += len(hashes)
        if held > 500_000:
            flush()
            parts, sizes, held = [], [], 0
    flush()
    return [np.concatenate(each) for each in out]


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp (64 bits as a long) for every row; a text without words has fingerprint 0."""
    def run(batches):
        for b in small(batches):
            fp, = simhashes(b.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def segments_of(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, width, tolerance) of each segment; tolerances plus one add up to radius plus one."""
    if not 2 <= segments <= 32 or not 0 <= radius <= 63:
        raise ValueError("2 to 32 segments and a radius from 0 to 63 are supported")
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
    share, more = divmod(radius + 1, segments)
    tolerance = [share - 1 + (i < more) for i in range(segments)]
    return [(sum(widths[:i]), widths[i], tolerance[i]) for i in range(segments) if tolerance[i] >= 0]


def keys_of(fp: np.ndarray, plan: list[tuple[int, int, int]], kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints: each one's balls in all segments; the segment's number is in the top six bits.

    Fingerprints of another ``kind`` never share a key: segments are counted on over the kinds.
    """
    keys, owners = [], []
    for s, (low, width, tolerance) in enumerate(plan, kind * len(plan)):
        value = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        top = np.uint64(s << 58)
        keys.append(value | top)
        owners.append(fp)
        for size in range(1, (tolerance + 1) // 2 + 1):
            for bits in combinations(range(width), size):
                mask = np.uint64(sum(1 << i for i in bits))
                if tolerance == 1:  # of two values one bit apart, one has the bit: clearing it is enough
                    has = (value & mask) != 0
                    keys.append((value[has] ^ mask) | top)
                    owners.append(fp[has])
                else:
                    keys.append((value ^ mask) | top)
                    owners.append(fp)
    return np.concatenate(keys), np.concatenate(owners)


def distances(a: np.ndarray, b: np.ndarray, strict: bool) -> np.ndarray:
    """Differing bits; ``strict``: in the top seven bits, with 57 mixed bits of the pair below, so that no two pairs tie."""
    d = np.bitwise_count(a ^ b)
    return d.astype(np.uint64) << np.uint64(57) | (mix(a) + mix(b)) >> np.uint64(7) if strict else d


def forest(members: np.ndarray, radius: int, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Prim's least spanning forest over Hamming distances up to radius."""
    rest, a, b, far = members[1:].copy(), [], [], (radius + 1 << 57 if strict else radius + 1)
    best = distances(rest, members[:1], strict)
    parent = np.full(len(rest), members[0], np.uint64)
    while len(rest):
        i = int(best.argmin())
        new = rest[i:i + 1].copy()
        if best[i] < far:
            a.append(parent[i])
            b.append(new[0])
        last = len(rest) - 1  # take i out by putting the last in its place
        rest[i], best[i], parent[i] = rest[last], best[last], parent[last]
        rest, best, parent = rest[:last], best[:last], parent[:last]
        d = distances(rest, new, strict)
        closer = d < best
        best[closer], parent[closer] = d[closer], new[0]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def small_forests(runs: np.ndarray, radius: int, strict: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's least spanning forests of many groups of one size (a row each), a step of all groups at a time; with each link's row."""
    rows, a, b, at, far = np.arange(len(runs)), [], [], [], (radius + 1 << 57 if strict else radius + 1)
    best = distances(runs, runs[:, :1], strict)
    taken = np.iinfo(best.dtype).max  # of those that are in the forest
    parent = np.broadcast_to(runs[:, :1], runs.shape).copy()
    best[:, 0] = taken
    for _ in range(runs.shape[1] - 1):
        i = best.argmin(1)
        new, near = runs[rows, i], best[rows, i] < far
        a.append(parent[rows, i][near])
        b.append(new[near])
        at.append(rows[near])
        apart = distances(runs, new[:, None], strict)
        closer = (apart < best) & (best < taken)
        best[closer] = apart[closer]
        parent = np.where(closer, new[:, None], parent)
        best[rows, i] = taken
    return np.concatenate(a), np.concatenate(b), np.concatenate(at)


def first_shared(a: np.ndarray, b: np.ndarray, plan) -> np.ndarray:
    """One key of those that two fingerprints share: of their first common segment, its value if it is the same in both, else the least one."""
    none = np.iinfo(np.uint64).max
    out = np.full(len(a), none)
    for s, (low, width, tolerance) in enumerate(plan):
        flips = (tolerance + 1) // 2
        masks = np.array([sum(1 << i for i in bits) for n in range(flips + 1) for bits in combinations(range(width), n)], np.uint64)
        left = np.flatnonzero(out == none)
        for part in np.split(left, range(10_000, len(left), 10_000)):
            x, y = ((v[part, None] >> np.uint64(low)) & np.uint64((1 << width) - 1) for v in (a, b))
            keys = x ^ masks
            under = lambda v: (np.bitwise_count(keys ^ v) <= flips) & ((tolerance != 1) | (keys & ~v == 0))
            least = np.where(under(x) & under(y), keys, none).min(1)
            key = np.where(x == y, x, least[:, None])[:, 0]
            out[part] = np.where(key == none, none, key | np.uint64(s << 58))
    return out


def with_neighbour(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Whether each fingerprint has another one within the radius in its run of equal keys; those at one offset are compared at a time."""
    near, rows, offset = np.zeros(len(keys), bool), np.arange(len(keys)), 1
    while len(rows := rows[:np.searchsorted(rows, len(keys) - offset)]):
        rows = rows[keys[rows] == keys[rows + offset]]
        found = rows[np.bitwise_count(fps[rows] ^ fps[rows + offset]) <= radius]
        near[found] = near[found + offset] = True
        offset += 1
    return near


def link_runs(keys: np.ndarray, fps: np.ndarray, radius: int, plan, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys.

    Most members of a key meet there by chance, and the more the more texts there are: those
    without a neighbour within the radius are put aside first, as no forest links them.
    ``once`` names a link under one of the keys that its two fingerprints share and no
    other.  Where that key's forest leaves the link out, nearer links of the key take its
    place; as no two pairs tie, the same holds for each of those, down to the nearest.
    """
    near = with_neighbour(keys, fps, radius)
    keys, fps = keys[near], fps[near]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(keys)])
    a, b, under = [], [], []
    for g in np.unique(size[(size > 1) & (size <= 16)]):
        own = at[size == g]
        x, y, row = small_forests(fps[own[:, None] + np.arange(g)], radius, once)
        a.append(x)
        b.append(y)
        under.append(keys[own][row])
    for i, g in zip(at[size > 16], size[size > 16]):
        run = np.unique(fps[i:i + g])
        if plan:  # all reached this key over the same flipped bits: their own key links them
            low, width, _ = plan[int(keys[i]) >> 58]
            values = (run >> np.uint64(low)) & np.uint64((1 << width) - 1)
            if (values == values[0]).all() and int(values[0]) != int(keys[i]) & ((1 << 58) - 1):
                continue
        x, y = forest(run, radius, once)
        a.append(x)
        b.append(y)
        under.append(np.full(len(x), keys[i]))
    a, b, under = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b, under))
    if once:
        own = first_shared(a, b, plan) == under
        a, b = a[own], b[own]
    x, y = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] & (x != y) if len(x) else np.zeros(0, bool)
    return x[new], y[new]


def linker(radius: int, plan, limit: int | None):
    """Task function over rows (key, fp) sorted by key: a, b of each link; b missing and key set for members of too large a key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def out(a, b, key=None):
        a = a.view(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64)),
            pa.nulls(len(a), pa.int64()) if key is None else pa.array(np.full(len(a), key, np.uint64).view(np.int64))], schema=schema)

    def found(keys, fps, labels):
        """Links within runs of equal keys; where there are labels, each one once and none within a label."""
        a, b = link_runs(keys, fps, radius, plan, once=labels is not None)
        if labels is not None and len(a):
            order = np.argsort(fps)
            own = lambda x: labels[order[np.searchsorted(fps, x, sorter=order)]]
            apart = own(a) != own(b)
            a, b = a[apart], b[apart]
        return out(a, b)

    def run(batches):
        keys, fps, large, labels = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None, None
        part = lambda x, i, j=None: None if x is None else x[i:j]
        for batch in batches:
            keys = np.r_[keys, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)]
            fps = np.r_[fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
            if "label" in batch.schema.names:
                new = batch.column("label").to_numpy(zero_copy_only=False)
                labels = new if labels is None else np.r_[labels, new]
            while len(keys):
                if large is not None:
                    n = int(np.argmax(keys != large)) if (keys != large).any() else len(keys)
                    if n:
                        yield out(fps[:n], None, large)
                    keys, fps, labels = keys[n:], fps[n:], part(labels, n)
                    if not len(keys):
                        break
                    large = None
                last = int(np.argmax(keys == keys[-1])) if len(keys) else 0  # the last run may go on in the next batch
                if limit:
                    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                    over = np.flatnonzero(np.diff(np.r_[at, len(keys)]) > limit)
                    if len(over):
                        n, large = int(at[over[0]]), keys[at[over[0]]]
                        if n:
                            yield found(keys[:n], fps[:n], part(labels, 0, n))
                        keys, fps, labels = keys[n:], fps[n:], part(labels, n)
                        continue
                if last:
                    yield found(keys[:last], fps[:last], part(labels, 0, last))
                    keys, fps, labels = keys[last:], fps[last:], part(labels, last)
                break
        if len(keys) and large is None:
            yield found(keys, fps, labels)

    return run


def links(prints: DataFrame, radius: int = 4, segments: int = 2, limit: int = LIMIT) -> DataFrame:
    """a, b: links between fingerprints at most ``radius`` bits apart that connect all that such links connect.

    prints: column fp, distinct and not null.  Every fingerprint keeps a link to its
    nearest one within the radius under each key they share.  Where prints have a column
    ``label``, a link is named under one key alone and links within one label are left out
    (all those of keys of over ``limit`` members stay).
    """
    spark, plan = prints.sparkSession, segments_of(radius, segments)
    more = [c for c in prints.columns if c == "label"]

    def emit(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for part in range(0, len(fp), 2000):
                own = fp[part:part + 2000]
                keys, owners = keys_of(own, plan)
                order = np.argsort(own)
                at = pa.array(order[np.searchsorted(own, owners, sorter=order)] + part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64)), *[b.column(c).take(at) for c in more]],
                                                 ["key", "fp", *more])

    filed = prints.select("fp", *more).mapInArrow(emit, "key long, fp long" + ", label long" * len(more))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = durable(filed.repartition(parts, "key").sortWithinPartitions("key")
                    .mapInArrow(linker(radius, plan, limit), "a long, b long, key long"))
    near, large = found.where("b is not null").select("a", "b"), found.where("b is null").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return near
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") * 2 / limit).alias("n"))
    own = large.join(blocks, "key").select("key", "fp", "n", F.expr("pmod(xxhash64(fp), n)").alias("i"))
    pairs = own.select("fp", F.expr("explode(sequence(0L, n - 1))").alias("j"), "key", "i")
    dealt = pairs.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
    rest = (dealt.repartition(parts, "key").sortWithinPartitions("key")
            .mapInArrow(linker(radius, None, None), "a long, b long, key long").select("a", "b"))
    return near.unionByName(durable(rest))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, segments: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row: the least doc_id reachable over links of at most ``radius`` bits.

    Missing texts count as empty; all texts without words share fingerprint 0.  Rows
    without a doc_id take part; a component of such rows alone has no component_id.
    Repeated rows come back as often as they stand there; other columns are left out.
    """
    prints = durable(fingerprints(docs, shingle))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected(links(distinct, radius, segments)).withColumnRenamed("node", "fp")
    labelled = distinct.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = durable(labelled.join(least, "label").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, shingles (sorted distinct 64-bit hashes, little-endian) of every row."""
    def run(batches):
        for b in small(batches):
            sets = [shingle_set(t, shingle).astype("<u8").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return texts(docs).mapInArrow(run, "doc_id long, shingles binary")


def print_links(kinds: DataFrame, name: str, radius: int, segments: int) -> DataFrame:
    """a, b: nodes of different labels that fingerprint ``name`` connects, written.

    kinds: node, label and the fingerprint.  A print's least node stands for it in the links
    to near prints, and is linked with one node of every other label that has the print.
    """
    held = durable(kinds.groupBy(F.col(name).alias("fp"), "label").agg(F.min("node").alias("node")))
    heads = durable(held.groupBy("fp").agg(F.min(F.struct("node", "label")).alias("h")).select("fp", F.col("h.node").alias("head"), F.col("h.label").alias("own")))
    a = links(heads.withColumnRenamed("own", "label"), radius, segments).distinct().join(
        heads.select(F.col("fp").alias("a"), F.col("head").alias("x"), F.col("own").alias("x_label")).hint("merge"), "a")
    both = a.join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y"), F.col("own").alias("y_label")).hint("merge"), "b").where(
        "x_label != y_label").select("x", "y")
    same = held.join(heads.hint("merge"), "fp").where("own != label").select(F.col("head").alias("x"), F.col("node").alias("y"))
    return durable(both.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 8, segments: int = 3,
                   prints: int = 8) -> DataFrame:
    """doc_id, group (least doc_id of the group) of every document.

    Texts with a fingerprint within ``radius`` bits, by any of ``prints`` independent
    fingerprints of their distinct shingles, are candidates; a link stands if the two
    texts' sets of word shingles have at least the Jaccard similarity asked for.  The least
    spanning links under each key are verified, those of the first two prints before the
    others'.  Texts that candidates connect without being similar to their neighbours
    there meet all other texts so connected inside the tasks of ``grouping.settle``, so that
    no candidate pair of two groups stays undecided and no list of pairs leaves a task.
    Exact copies need no comparison.  Texts without words are copies of each other.  Rows
    without a doc_id are left out; a doc_id that stands for several texts is compared by one
    of them.  Texts of any length are read whole, other columns are left out, and an empty
    table has no groups.
    """
    if prints * segments > 64:
        raise ValueError("at most 64 segments over all fingerprints are supported")
    names = [f"fp{i}" for i in range(prints)]

    def run(batches):
        for b in small(batches):
            batch = b.column("text").to_pylist()
            code = np.array([xxhash.xxh64_intdigest(b" ".join(words(t)), 7) for t in batch], np.uint64)
            found = (code, *simhashes(batch, shingle, prints, distinct=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x.view(np.int64)) for x in found]], ["doc_id", "code", *names])

    own = texts(docs).where("doc_id is not null")
    marked = durable(own.mapInArrow(run, "doc_id long, code long, " + ", ".join(f"{n} long" for n in names)))
    kinds = durable(marked.groupBy("code", *names).agg(F.min("doc_id").alias("node")))  # one row for each text

    def proposed(some: list[str], labelled: DataFrame) -> DataFrame:  # one print after the other: a shuffle holds the keys of one
        return durable(union([print_links(labelled, name, radius, segments) for name in some]).distinct())

    def sets_of(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        if known is not None:
            asked = asked.join(known.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_anti")
        return durable(shingle_sets(own.join(durable(asked), "doc_id", "left_semi").select("doc_id", "text"), shingle)
                       .groupBy(F.col("doc_id").alias("node")).agg(F.min("shingles").alias("shingles")))

    def late(known: DataFrame) -> tuple[DataFrame, DataFrame]:
        labelled = durable(kinds.join(known.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")))
        pairs = proposed(names[2:], labelled)
        return pairs, sets.unionByName(sets_of(pairs, sets))

    first = proposed(names[:2], kinds.withColumn("label", F.col("node")))
    sets = sets_of(first)
    labels = groups_of(first, sets, round(100 * similarity), late if names[2:] else None).withColumnRenamed("label", "group")
    grouped = durable(kinds.join(labels.hint("merge"), "node", "left").select("code", *names, F.coalesce("group", "node").alias("group")))
    return marked.join(grouped.hint("merge"), ["code", *names]).select("doc_id", "group")


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 8, segments: int = 3,
             prints: int = 8) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each group the row of the least doc_id stays.

    Of several rows with that doc_id one stays; rows without a doc_id all stay.  Whole
    rows are shuffled once, by doc_id, to meet the ids that go.
    """
    groups = durable(similar_groups(docs, shingle, similarity, radius, segments, prints))
    gone = groups.where("doc_id != group").select("doc_id").distinct()
    left = docs.where("doc_id is not null").join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    unnamed = docs.where("doc_id is null")
    repeated = durable(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return left.unionByName(unnamed)
    again = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again).unionByName(unnamed)
