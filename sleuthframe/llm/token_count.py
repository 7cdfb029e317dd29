"""Token counts by rank-synchronous merging.

The pre-tokens of a batch that were not met before are laid side by side in one array
of symbols.  In each round every sequence takes its own lowest-rank pair and joins all
places of that pair, all sequences at once; rounds go on until no sequence has a pair
left.  What is counted in the end are the surviving symbols.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import HELD, SPACE, byte_symbols
from .common import small, texts

_NONE = np.int64(1 << 40)


class ByteCounter:
    """Counts of a byte-level BPE, read from a tokenizer file's text."""

    def __init__(self, source: str):
        model = json.loads(source)
        vocab = model["model"]["vocab"]
        self.symbol = np.array([vocab[c] for c in byte_symbols()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        special = [t["content"] for t in model["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(c) for c in sorted(special, key=len, reverse=True))) if special else None
        s = SPACE
        self.pieces = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+")
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def ranks_at(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the symbols at the given places with the next one of the same sequence."""
        rank = np.full(len(at), _NONE)
        inner = np.flatnonzero(at < len(symbols) - 1)
        i = at[inner]
        key = symbols[i] << 32 | symbols[i + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[found] == key) & (owner[i] == owner[i + 1])
        rank[inner[known]] = self.rank[found[known]]
        return rank

    def count(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        size = np.array([len(r) for r in raw], np.int64)
        left = size.copy()
        symbols = self.symbol[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        rank = self.ranks_at(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            spread = np.repeat(lowest, np.diff(np.r_[first, len(owner)]))
            live = spread < _NONE  # sequences without a pair are done and leave
            hit = (rank == spread) & live
            if (hit[1:] & hit[:-1]).any():  # x x x: of overlapping places of one pair the first, third, ... are joined
                place = np.arange(len(hit))
                hit &= (place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1
            left -= np.bincount(owner[hit], minlength=len(raw))
            symbols[hit] = self.made[rank[hit]]
            keep = live & ~np.r_[False, hit[:-1]]
            new = (np.cumsum(keep) - 1)[hit]  # where the joined symbols are now: their pairs and those before them changed
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            touched = np.zeros(len(symbols), bool)
            touched[new] = touched[np.maximum(new - 1, 0)] = True
            changed = np.flatnonzero(touched)
            if len(changed):
                rank[changed] = self.ranks_at(symbols, owner, changed)
        return left

    def learn(self, tokens: list[str]) -> None:
        start = 0
        while start < len(tokens):  # by slices of bounded bytes; one long pre-token is a slice of its own
            stop, held = start, 0
            while stop < len(tokens) and (held < 400_000 or stop == start):
                held += len(tokens[stop])
                stop += 1
            self.counts.update(zip(tokens[start:stop], self.count(tokens[start:stop]).tolist()))
            start = stop

    def totals(self, batch: list) -> list[int]:
        """Tokens of each text; a special token's string counts as one."""
        out: list[int] = []
        held, chars = [], 0
        for i, text in enumerate(batch):
            found, special = [], 0
            if text:
                if self.special is not None and self.special.search(text):
                    special = len(self.special.findall(text))
                    found = [t for part in self.special.split(text) for t in self.pieces.findall(part)]
                else:
                    found = self.pieces.findall(text)
                chars += len(text)
            held.append((found, special))
            if chars > 1_000_000 or i == len(batch) - 1:
                self.learn_missing([f for f, _ in held])
                known = self.counts
                out += [sum(map(known.__getitem__, f)) + s for f, s in held]
                held, chars = [], 0
        return out

    def learn_missing(self, lists: list[list[str]]) -> None:
        seen = set().union(*lists)
        missing = [t for t in seen if t not in self.counts]
        if len(self.counts) + len(missing) > HELD // 2:  # counts in use move over, the others are let go with the next turn
            self.older, self.counts, missing = self.counts, {}, list(seen)
        known = self.older
        if known:
            self.counts.update([(t, known[t]) for t in missing if t in known])
            missing = [t for t in missing if t not in known]
        self.learn(missing)


@lru_cache(2)
def model_of(source: str) -> ByteCounter:
    return ByteCounter(source)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row.

    A missing or empty text has no bytes and no tokens; texts of any length are counted
    whole; repeated rows come back as they are, rows without a doc_id too; other columns
    are left out.  tokenizer: path of a byte-level BPE file, read on the driver.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()

    def run(batches):
        model = model_of(source)
        for b in small(batches):
            batch = b.column("text").to_pylist()
            n = model.totals(batch)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in batch]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                                              pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
