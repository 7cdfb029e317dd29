"""BPE encoding and decoding with forced boundaries.

A merge only ever makes a token of the vocabulary.  Two neighbouring byte symbols that
stand side by side in no token are therefore never joined: between them lies a certain
cut, whatever stands around.  A word is cut there, each fragment is encoded for itself
and the ids are concatenated.  Fragments recur far more often than words, so that few
are merged and the rest are looked up.
"""

from __future__ import annotations

import json
import unicodedata
from collections import defaultdict
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small, texts

#: White space as the Unicode property has it (fixed value).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of a lookup; the older half goes when it is full.
HELD = 1 << 18


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Memo(dict):
    """Computed values by key: the newer half, and the older one from which what is asked for again moves over."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.hold(key, value)
        return value

    def hold(self, key, value) -> None:
        if len(self) >= HELD // 2:
            self.older = dict(self)
            self.clear()
        self[key] = value


class WordBpe:
    """Lower-case word BPE with word ends, read from a tokenizer file's text."""

    def __init__(self, source: str):
        model = json.loads(source)
        self.vocab: dict[str, int] = dict(model["model"]["vocab"])
        self.end = model["model"]["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.added = {c: np.array([i], "<u4").tobytes() for c, i in added.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.symbols = byte_symbols()
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["model"]["merges"])}
        self.inner, self.final = self.neighbours()
        self.words = Memo(self.word)
        self.fragments = Memo(self.cut_fragment)
        self.raw = defaultdict(bytes, {t: i.to_bytes(4, "little") for t, i in self.vocab.items()})  # a symbol without an id has none
        names = {i: t for t, i in (self.vocab | added).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

    def neighbours(self) -> tuple[set[str], set[str]]:
        """Pairs of byte symbols side by side in some token: anywhere, and at the end of a word."""
        inner, final = set(), set()
        for token in self.vocab:
            ends = bool(self.end) and token.endswith(self.end)
            body = token[:-len(self.end)] if ends else token
            pairs = [body[i:i + 2] for i in range(len(body) - 1)]
            inner.update(pairs[:-1] if ends else pairs)
            if ends:
                final.update(pairs[-1:])
        return inner, final

    def word(self, word: str) -> bytes:
        """Ids of a word: of its fragments between the certain cuts."""
        symbols = self.symbols
        chars = "".join([symbols[b] for b in word.encode("utf-8", "surrogatepass")])
        pairs = list(map(add, chars, chars[1:]))
        if not pairs:
            return self.fragment(chars, True)
        inner, n = self.inner, len(chars)
        cuts = [] if inner.issuperset(pairs[:-1]) else [i + 1 for i, p in enumerate(pairs[:-1]) if p not in inner]
        if pairs[-1] not in self.final:
            cuts.append(n - 1)
        if not cuts:
            return self.fragment(chars, True)
        cuts.append(n)
        return b"".join([self.fragments[chars[i:j] if j < n else chars[i:] + " "] for i, j in zip([0, *cuts], cuts)])

    def cut_fragment(self, key: str) -> bytes:
        """A fragment as it is looked up: a space marks the end of a word."""
        return self.fragment(key[:-1], True) if key[-1] == " " else self.fragment(key, False)

    def fragment(self, chars: str, last: bool) -> bytes:
        """Ids of a fragment: the lowest-ranked neighbours are joined, the leftmost first, until no two are ranked."""
        parts = list(chars)
        if last:
            parts[-1] += self.end
        rank_of, none = self.ranks.get, 1 << 30
        ranks = [rank_of(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            if len(ranks) > 64 and ranks.count(best) > 16:  # a long run of the same pair: all places in one pass from the left
                parts = self.joined(parts, ranks, best)
                ranks = [rank_of(p, none) for p in zip(parts, parts[1:])]
                continue
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), none)
        return b"".join(map(self.raw.__getitem__, parts))

    @staticmethod
    def joined(parts: list[str], ranks: list[int], best: int) -> list[str]:
        out, i, n = [], 0, len(parts)
        while i < n:
            if i < n - 1 and ranks[i] == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        return out

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            # one character at a time: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, self.pieces.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; the special tokens' strings become their ids."""
        if self.split is None or not any(c in text for c in self.added):
            return self.plain(text)
        return b"".join(self.added[p] if p in self.added else self.plain(p) for p in self.split.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The tokens as the vocabulary writes them, joined by spaces: the file names no decoder."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def model_of(source: str) -> WordBpe:
    return WordBpe(source)


def encode(docs: DataFrame, tokenizer: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) for every row.

    With ``decoded`` the text that the ids decode to comes along, from the same pass.
    tokenizer: path of a tokenizer file, read once on the driver and sent to the tasks
    (one file, a few MB).  A missing or empty text has no ids; texts of any length are
    encoded whole; repeated rows come back as they are, rows without a doc_id too;
    other columns are left out.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]

    def run(batches):
        model = model_of(source)
        for b in small(batches):
            ids = [model.encode(t) if t else b"" for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([model.decode(x).decode("utf-8", "replace") for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of ``encode`` and decoded: the text of the ids, special tokens included; missing ids give empty text."""
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()

    def run(batches):
        model = model_of(source)
        for b in small(batches):
            out = [model.decode(x).decode("utf-8", "replace") if x else "" for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), b.column("ids"), pa.array(out, pa.string())],
                                             ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
