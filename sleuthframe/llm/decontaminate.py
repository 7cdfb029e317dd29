"""Benchmark decontamination by SimHash over item-sized windows.

Every text is read through sliding windows whose lengths fit the benchmark's items: a
copy of an item, wherever it begins and with as many broken places as the weighted
similarity allows, holds a whole window of the item on the sliding grid.  Windows and all windows of the items get SimHash fingerprints of word shingles.  Multi-index
blocks (32-bit halves, each with the Hamming ball that the radius asks for) find every
item window within the radius of a text window.  Each candidate is then verified
exactly: the weighted share of the item's shingles that stand at that place.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import shingle_codes, small, texts, word_codes, words

_LANES = np.uint64(0x0101010101010101)
#: Longest window in words: its shingles are counted in bytes.
LONGEST = 128
#: Words that are fingerprinted at a time.
STRETCH = 1 << 17


def most_kept(weights: list[float], n: int, shingle: int, longest: int) -> float:
    """The most weight that a copy of n words keeps without an unbroken stretch of over ``longest`` words.

    weights: of the item's shingles in order.  A break between two words costs the shingles
    over it; each word lost at an end is such a break.
    """
    before = [0.0, *accumulate(weights)]
    best = [0.0] * (n + 1)  # of the first j words, with a break behind them
    open_: deque[int] = deque()  # begins of a last stretch, the best ones in falling order
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        i = j - shingle
        if i >= 0:
            gain = best[i] - before[i]
            while open_ and best[open_[-1]] - before[open_[-1]] <= gain:
                open_.pop()
            open_.append(i)
        while open_ and open_[0] < j - longest:
            open_.popleft()
        if open_:
            best[j] = max(best[j], best[open_[0]] - before[open_[0]] + before[j - shingle + 1])
    return best[n]


def window_of(weights: list[float], n: int, shingle: int, threshold: float) -> tuple[int, int]:
    """Window length and step of the text's grid for an item of n words with these weights of its shingles.

    Every copy that keeps the share ``threshold`` of the weight has an unbroken stretch
    in which a window lies, wherever the grid lies: 128 to 8 words on steps of a quarter
    of them, else 8 words down to one shingle at every word.
    """
    if n <= shingle:
        return n, 1
    need = threshold * sum(weights) - 1e-9
    grids = [(w, w // 4) for w in (128, 64, 32, 16, 8) if w <= LONGEST] + [(w, 1) for w in range(8, shingle, -1)]
    for window, step in grids:
        whole = window + step - 1
        if whole <= n and window >= shingle and most_kept(weights, n, shingle, whole - 1) < need:
            return window, step
    return shingle, 1


def window_prints(codes: np.ndarray, window: int, shingle: int, step: int) -> np.ndarray:
    """Fingerprints of the windows that begin at every ``step``-th word."""
    n = len(codes)
    if n < window:
        return np.zeros(0, np.uint64)
    h = shingle_codes(codes, min(shingle, window))
    count = window - min(shingle, window) + 1  # shingles of a window
    starts = np.arange(0, n - window + 1, step)
    unit = math.gcd(step, count)  # windows are sums of whole units of shingles
    units = len(h) // unit
    first = starts // unit
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        lane = ((h[:units * unit] >> np.uint64(k)) & _LANES).reshape(units, unit)
        lane = lane[:, 0] if unit == 1 else lane.sum(1, dtype=np.uint64)
        total = lane[first]
        for i in range(1, count // unit):
            total = total + lane[first + i]
        over = (total.view(np.uint8) > count // 2).view(np.uint64)
        out |= over << np.uint64(k)
    return out


class Items:
    """The benchmark as lookup tables: item shingles with weights, and item windows by Hamming block."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int, threshold: float):
        self.shingle, self.radius, self.threshold = shingle, radius, threshold
        self.ids, self.codes, self.bags = [], [], []
        for item, text in items:
            found = words(text)
            if found:
                self.ids.append(item)
                self.codes.append(word_codes(found))
                self.bags.append(Counter(shingle_codes(self.codes[-1], shingle).tolist()))
        held = Counter(x for bag in self.bags for x in bag)
        self.weight = {x: math.log(1 + len(self.bags) / n) for x, n in held.items()}
        self.mass = [sum(self.weight[x] * n for x, n in bag.items()) for bag in self.bags]
        self.windows = [window_of([self.weight[x] for x in shingle_codes(c, shingle).tolist()], len(c), shingle, threshold) for c in self.codes]
        self.tables = {w: self.table(w) for w in sorted(set(self.windows))}

    def table(self, grid: tuple[int, int]):
        """Fingerprints, item and offset of all windows of the items on this grid, and the two blocks' sorted keys."""
        prints, owner, offset, window = [], [], [], grid[0]
        for i, codes in enumerate(self.codes):
            if self.windows[i] == grid:
                p = window_prints(codes, window, self.shingle, 1)
                prints.append(p)
                owner.append(np.full(len(p), i))
                offset.append(np.arange(len(p)))
        prints, owner, offset = np.concatenate(prints), np.concatenate(owner), np.concatenate(offset)
        blocks = []
        ball = [0] + [sum(1 << b for b in bits) for size in range(1, self.radius // 2 + 1) for bits in combinations(range(32), size)]
        low = np.uint64(0xFFFFFFFF)
        for shift in (np.uint64(0), np.uint64(32)):
            value = (prints >> shift) & low
            keys = np.concatenate([value ^ np.uint64(m) for m in ball])
            owners = np.tile(np.arange(len(prints)), len(ball))
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 22, bool)  # most text windows are turned away here
            seen[self.slot(keys)] = True
            blocks.append((shift, keys[order], owners[order], seen))
        return prints, owner, offset, blocks

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def candidates(self, codes: np.ndarray, text_of: np.ndarray, grid: tuple[int, int]) -> set[tuple[int, int, int]]:
        """(text, item, place): a window of the text lies within the radius of an item window; the item would begin at place."""
        (window, step), (prints, owner, offset, blocks) = grid, self.tables[grid]
        out: set[tuple[int, int, int]] = set()
        stretch = STRETCH - STRETCH % step
        for base in range(0, len(codes), stretch):
            found = window_prints(codes[base:base + stretch + window - 1], window, self.shingle, step)
            begin = base + step * np.arange(len(found))
            inside = text_of[begin] == text_of[begin + window - 1] if len(begin) else np.zeros(0, bool)
            found, begin = found[inside], begin[inside]
            for shift, keys, owners, seen in blocks:
                value = (found >> shift) & np.uint64(0xFFFFFFFF)
                maybe = np.flatnonzero(seen[self.slot(value)])
                left, right = np.searchsorted(keys, value[maybe], "left"), np.searchsorted(keys, value[maybe], "right")
                some = right > left
                maybe, left, size = maybe[some], left[some], (right - left)[some]
                for at in range(0, len(maybe), 4096):
                    n = size[at:at + 4096]
                    here = np.repeat(maybe[at:at + 4096], n)
                    item_window = owners[np.arange(n.sum()) + np.repeat(left[at:at + 4096] - (np.cumsum(n) - n), n)]
                    near = np.bitwise_count(found[here] ^ prints[item_window]) <= self.radius
                    here, item_window = begin[here[near]], item_window[near]
                    out.update(zip(text_of[here].tolist(), owner[item_window].tolist(), (here - offset[item_window]).tolist()))
        return out

    def similarity(self, codes: np.ndarray, item: int) -> float:
        """Weighted share of the item's shingles, repeats included, in an item-sized window of a text."""
        here = Counter(shingle_codes(codes, self.shingle).tolist())
        return sum(self.weight[x] * min(n, here[x]) for x, n in self.bags[item].items() if x in here) / self.mass[item]

    def scan(self, batch: list) -> list[list[tuple[int, float, int, int]]]:
        """For each text (item id, similarity, first word, end) of each item at its best place."""
        out: list[list] = [[] for _ in batch]
        held, sizes, first = [], [], 0
        for i, text in enumerate(batch):
            found = words(text)
            held += found
            sizes.append(len(found))
            if len(held) >= STRETCH or i == len(batch) - 1:
                codes, ends = word_codes(held), np.cumsum(sizes)
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for grid in self.tables:
                    for t, item, place in self.candidates(codes, text_of, grid):
                        low, high = int(ends[t]) - sizes[t], int(ends[t])
                        begin = max(place, low)
                        s = self.similarity(codes[begin:min(place + len(self.codes[item]), high)], item)
                        if s >= self.threshold - 1e-12 and (s, low - begin) > best.get((t, item), (0.0, 0)):
                            best[t, item] = (s, low - begin)
                for (t, item), (s, at) in sorted(best.items()):
                    out[first + t].append((self.ids[item], s, -at, min(-at + len(self.codes[item]), sizes[t])))
                first, held, sizes = i + 1, [], []
        return out


def items_of(benchmark: DataFrame, shingle: int, radius: int, threshold: float, max_bytes: int) -> Items:
    """The benchmark's items on the driver, after a check of their size.

    One item of each text is enough: the least item_id stands for repeated texts.  A
    benchmark of more than ``max_bytes`` is refused; cut it and scan once for each part.
    """
    own = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
           .where("item_id is not null and text is not null").groupBy("text").agg(F.min("item_id").alias("item_id")))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text, more than max_bytes = {max_bytes}")
    return Items(sorted((r["item_id"], r["text"]) for r in own.collect()), shingle, radius, threshold)


def contamination(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, radius: int = 3, threshold: float = 0.8,
                  max_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, contaminated, hits (item_id, similarity, first word, end) for every row.

    A text is contaminated where a window lies within ``radius`` bits of a window of an
    item and at least ``threshold`` of that item's shingles, weighted by ln(1 + items /
    items that hold it), stand in the item-sized window there.  Each item is reported
    once, at its best and then first place.  Missing and empty texts have no hits, and
    items without words are never hit; texts of any length are read whole; repeated rows
    come back as they are, rows without a doc_id too; other columns are left out.
    """
    items = items_of(benchmark, shingle, radius, threshold, max_bytes)
    hit = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in small(batches):
            found = items.scan(b.column("text").to_pylist())
            rows = [[dict(zip(("item_id", "similarity", "first", "end"), h)) for h in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bool(f) for f in found], pa.bool_()),
                                              pa.array(rows, pa.list_(hit))], ["doc_id", "contaminated", "hits"])

    return texts(docs).mapInArrow(
        run, "doc_id long, contaminated boolean, hits array<struct<item_id:long,similarity:double,first:long,end:long>>")


def keep_clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, radius: int = 3, threshold: float = 0.8,
               max_bytes: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` without contamination, with all their columns.

    Missing and empty texts and rows without a doc_id stay; repeated rows share their fate.
    """
    items = items_of(benchmark, shingle, radius, threshold, max_bytes)

    def run(batches):
        for b in small(batches):
            yield b.filter(pa.array([not f for f in items.scan(b.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
