"""Alignment of two tokenizers' tokens through sparse incidence matrices.

The bytes of a run of texts are the columns of two incidence matrices, one row for each
token of tokenizer A or B, in compressed rows built here.  Gustavson's row product of A
with the transpose of B gives the overlap links and how many bytes each shares.  Byte
offsets at which both tokenizers end cut the tokens into groups; the product of the
token-id-by-group incidence of A with the group-by-token-id incidence of B gives, for each
text, how often two ids are linked by a shared group.

How many documents hold a pair of ids is counted over the whole corpus.  Texts travel in
chunks of a few megabytes, so that a pair is counted, and asked for, once for each chunk
and not once for each document.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .bpe import byte_symbols
from .common import small, texts

#: Bytes of text of a chunk, and of a run of texts that is aligned at once; one longer text is a chunk of its own.
CHUNK, RUN = 8 << 20, 1 << 19
#: Products that are expanded at a time.
EXPANDED = 1 << 21
#: Fixed value: how byte-level BPE cuts a text before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NUMBERS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")


class Rows(NamedTuple):
    """A sparse matrix in compressed rows: row i has columns column[start[i]:start[i + 1]] with these values."""
    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int


def _add_up(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if len(key) < 2:
        return key, value
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(value, first)


def rows_of(row: np.ndarray, column: np.ndarray, height: int, width: int) -> Rows:
    """Compressed rows of places that may stand there repeatedly: a place's value is how often."""
    key, value = _add_up(row * width + column, np.ones(len(row), np.int64))
    return Rows(np.searchsorted(key, np.arange(height + 1) * width), key % width, value, width)


def product(a: Rows, b: Rows) -> Rows:
    """Gustavson's product: row i is the sum of b's rows at the columns of a's row i, times a's values there.

    Rows are expanded side by side, at most about EXPANDED products at a time.
    """
    height = len(a.start) - 1
    row = np.repeat(np.arange(height), np.diff(a.start))
    size = b.start[a.column + 1] - b.start[a.column]
    ends, keys, values, at = np.cumsum(size), [], [], 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
        n = size[at:to]
        place = np.repeat(b.start[a.column[at:to]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, value = _add_up(np.repeat(row[at:to], n) * b.width + b.column[place], np.repeat(a.value[at:to], n) * b.value[place])
        keys.append(key)
        values.append(value)
        at = to
    key, value = _add_up(np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Rows(np.searchsorted(key, np.arange(height + 1) * b.width), key % b.width, value, b.width)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> Rows:
    """A times B transposed: for each token of A the tokens of B it shares bytes with, and how many."""
    n = int(ends_a[-1]) if len(ends_a) else 0
    by_byte = Rows(np.r_[0, ends_a], np.arange(n), np.ones(n, np.int64), n)  # every byte is in one token
    owner = Rows(np.arange(n + 1), np.repeat(np.arange(len(ends_b)), np.diff(np.r_[0, ends_b])), np.ones(n, np.int64), len(ends_b))
    return product(by_byte, owner)


class Pair:
    """Two tokenizers: A, a byte-level BPE file's text, reads space + text; B, a sentencepiece model, reads the text.

    A's vocabulary goes to the quicker of two public libraries as ranks: in a file whose merges
    stand in the order of their ids, two symbols that make up a token are that token's own merge.
    """

    def __init__(self, source_a: str, source_b: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(source_a)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != sorted(set(made)) or model["pre_tokenizer"]["type"] != "ByteLevel" or model["normalizer"]:
            raise ValueError("a byte-level file without a normalizer whose merges stand in the order of their ids is asked for")
        special = {t["content"] for t in model["added_tokens"]}
        byte_of = {c: i for i, c in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=source_b)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.width = max(len(self.bytes_a), len(self.bytes_b))
        # an id in the list of groups, with what stands behind it: inside and at the end of its group's side
        self.names = [f"{i}{end}" for ends in (",|", ",;") for end in ends for i in range(self.width)]

    def tokens(self, batch: list) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each text; none where the text is missing or empty, or their bytes are not space + text."""
        own_a, own_b = [], self.b.encode([t or "" for t in batch], num_threads=1)
        part_a, part_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for i, t in enumerate(batch):
            ids, want = [], b""
            if t:
                spaced = " " + t
                ids, want = self.a.encode_ordinary(spaced), spaced.encode()
            if b"".join(map(part_a, ids)) != want or b"".join(map(part_b, own_b[i])) != want:
                ids, own_b[i] = [], []
            own_a.append(ids)
        return own_a, own_b

    def align(self, batch: list):
        """For a run of texts: the numbers of each text (rows NUMBERS), its groups' digest, and its linked ids.

        Linked ids: start (n + 1 offsets), code (id of A << 32 | id of B), times (links of that pair in the text).
        """
        own_a, own_b = self.tokens(batch)
        n = len(batch)
        a, b = (np.fromiter(chain.from_iterable(lists), np.int64) for lists in (own_a, own_b))
        n_a, n_b = (np.array([len(ids) for ids in lists], np.int64) for lists in (own_a, own_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        # texts end in both, so no group reaches over two texts and the run is one string of bytes
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        text_a = np.repeat(np.arange(n), n_a)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        text_of = np.zeros(len(cuts), np.int64)
        text_of[group_a] = text_a
        shared = overlaps(ends_a, ends_b)
        n_overlaps = np.bincount(np.repeat(text_a, np.diff(shared.start)), minlength=n)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, text_of, in_a * in_b)
        numbers = np.stack([n_a, n_b, np.bincount(text_of, minlength=n), n_overlaps, n_links])
        own, row = np.unique(text_a * self.width + a, return_inverse=True)  # a row for each id of A in a text
        linked = product(rows_of(row, group_a, len(own), max(len(cuts), 1)), rows_of(group_b, b, len(cuts), self.width))
        per_row = np.diff(linked.start)
        code = np.repeat(own % self.width, per_row) << 32 | linked.column
        pairs = np.zeros(n, np.int64)
        np.add.at(pairs, own // self.width, per_row)
        return numbers, self.digests(a, b, group_a, group_b, in_a, in_b, n_a, n_b), np.r_[0, np.cumsum(pairs)], code, linked.value

    def digests(self, a, b, group_a, group_b, in_a, in_b, n_a, n_b) -> list[str]:
        """sha256 of the ids by group: ``a1,a2|b1;a3|b2,b3``; empty for a text without tokens."""
        last_a = np.r_[group_a[1:] != group_a[:-1], True] if len(a) else np.zeros(0, bool)
        last_b = np.r_[group_b[1:] != group_b[:-1], True] if len(b) else np.zeros(0, bool)
        order = np.empty(len(a) + len(b), np.int64)
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        order[np.arange(len(a)) + before_b[group_a]] = a + last_a * self.width
        order[np.arange(len(b)) + before_a[group_b]] = b + (2 + last_b) * self.width
        names, out, at = list(map(self.names.__getitem__, order.tolist())), [], 0
        for size in (n_a + n_b).tolist():
            out.append(hashlib.sha256("".join(names[at:at + size])[:-1].encode()).hexdigest() if size else "")
            at += size
        return out


@lru_cache(1)
def pair_of(source_a: str, source_b: bytes) -> Pair:
    return Pair(source_a, source_b)


_FILE = ("chunk long, doc_id array<long>, numbers binary, digests array<string>, start binary, at binary, times binary, codes binary, "
         "held binary")


class _Chunk:
    """What the runs of a chunk have gathered."""

    def __init__(self, number: int):
        self.number, self.ids, self.digests, self.bytes = number, [], [], 0
        self.numbers, self.sizes, self.codes, self.times = [], [], [], []

    def add(self, ids: list, found) -> None:
        numbers, digests, start, code, times = found
        self.ids += ids
        self.digests += digests
        self.numbers.append(numbers)
        self.sizes.append(np.diff(start))
        self.codes.append(code)
        self.times.append(times)

    def row(self) -> pa.RecordBatch:
        code = np.concatenate(self.codes)
        codes, at = np.unique(code, return_inverse=True)  # a text has a pair once: places of a pair are its documents
        held = np.bincount(at, minlength=len(codes))
        times = np.concatenate(self.times)
        times = times.astype(np.min_scalar_type(times.max(initial=0)))  # mostly one byte
        raw = [np.concatenate(self.numbers, axis=1), np.r_[0, np.cumsum(np.concatenate(self.sizes))], at.astype(np.int32), times, codes, held]
        numbers, start, at, times, codes, held = (pa.array([x.tobytes()], pa.binary()) for x in raw)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number]), pa.array([self.ids], pa.list_(pa.int64())), numbers, pa.array([self.digests]), start, at, times, codes, held],
            ["chunk", "doc_id", "numbers", "digests", "start", "at", "times", "codes", "held"])


def aligned_chunks(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """The written file: a row for each chunk of texts with their alignments and the chunk's distinct pairs of ids."""
    with open(tokenizer_a, encoding="utf-8") as f:
        source_a = f.read()
    with open(tokenizer_b, "rb") as f:
        source_b = f.read()

    def run(batches):
        model, part, made = pair_of(source_a, source_b), TaskContext.get().partitionId(), 0
        chunk, ids, batch, size = _Chunk(part << 32), [], [], 0

        def flush():
            if batch:
                chunk.add(ids, model.align(batch))

        for b in small(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(doc_id)
                batch.append(text)
                size += len(text or "") + 16
                if size >= RUN or len(batch) >= 2000:
                    flush()
                    chunk.bytes += size
                    ids, batch, size = [], [], 0
                    if chunk.bytes >= chunk_bytes:
                        yield chunk.row()
                        made += 1
                        chunk = _Chunk(part << 32 | made)
        flush()
        if chunk.ids:
            yield chunk.row()

    # partitions of little text are read by one task, so that the number of chunks follows the text and not the files
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    most = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // (2 * chunk_bytes)))
    return durable(texts(docs).coalesce(most).mapInArrow(run, _FILE))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """chunk, pair, n (documents of the corpus that hold the pair), best (no pair of its id of A is held by more)."""
    def spread(batches):
        for b in batches:
            for chunk, codes, held in zip(*(b.column(c).to_pylist() for c in ("chunk", "codes", "held"))):
                codes, held = np.frombuffer(codes, np.int64), np.frombuffer(held, np.int64)
                for i in range(0, len(codes), 50_000):
                    own = codes[i:i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.array(own), pa.array(held[i:i + 50_000])],
                                                     ["chunk", "pair", "held"])

    asked = chunks.select("chunk", "codes", "held").mapInArrow(spread, "chunk long, pair long, held long")
    counts = asked.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # one row for each id of A: no more than its vocabulary
    known = counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return asked.select("chunk", "pair").join(known.hint("merge"), "pair").select("chunk", "pair", "n", "best")


def alignment(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum, groups_sha256 for every row.

    n_overlaps: pairs of tokens that share bytes; n_links: pairs that share a group; n_best:
    links whose pair of ids is held by as many documents as any of its id of A; count_sum:
    over the links, the documents that hold the pair.  Every row is a document, repeated
    rows too; rows without a doc_id come back without it.  Texts that are missing or empty,
    or whose tokens' bytes are not space + text, have no tokens: zeros and an empty digest.
    Texts of any length are aligned whole; other columns are left out.
    tokenizer_a, tokenizer_b: paths of a byte-level BPE file and a sentencepiece model, read on the driver.
    """
    chunks = aligned_chunks(docs, tokenizer_a, tokenizer_b, chunk_bytes)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        n, best = (right.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "best"))
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        start, at = np.frombuffer(row["start"], np.int64), np.frombuffer(row["at"], np.int32)
        times = np.frombuffer(row["times"], f"u{len(row['times']) // max(len(at), 1) or 1}").astype(np.int64)
        numbers = np.frombuffer(row["numbers"], np.int64).reshape(len(NUMBERS), -1)
        upto = [np.r_[0, np.cumsum(times * x[at])] for x in (best, n)]
        sums = [u[start[1:]] - u[start[:-1]] for u in upto]
        return pa.table([pa.array(row["doc_id"], pa.int64()), *[pa.array(x) for x in (*numbers, *sums)], pa.array(row["digests"], pa.string())],
                        names=["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"])

    counted = pair_counts(chunks)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*NUMBERS, "n_best", "count_sum")) + ", groups_sha256 string"
    return chunks.drop("codes", "held").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(finish, schema)
