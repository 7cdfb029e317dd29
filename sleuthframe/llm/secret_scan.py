"""Secret scan with multipart linking.

Strong forms (an assignment to a key name, an access identifier, a long hexadecimal
run) are reported wherever they stand.  Weak parts, a mixed run of 32 characters or
more, padded or not, also of the url-safe alphabet, that may be a secret key, a service endpoint, a user name beside "user", are reported only where
parts that complete each other stand in one scope: an identifier or user name with a
secret, or a secret with an endpoint.  Two parts share a scope if at most ``reach``
characters lie between them, however long they are.  The interval join of a text's parts
searches their sorted starts beside the running maximum of their ends.
"""

from __future__ import annotations

import bisect
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, texts

#: Reported kinds, in the order that settles equal starts.
KINDS = ("assign", "access", "hex", "user", "secret", "endpoint")
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
_USER = re.compile(rb"""(?<![a-z0-9])(?:user(?:name)?|login|client_?id)["']?\x20*[:=]\x20*["']?[a-z0-9@_.-]{3,}""")
_SECRET = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(rb"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]{3,}""")


def strong(text: bytes, lower: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the strong forms."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(lower) if m.end() - m.start(1) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]


def mixed(run: bytes) -> bool:
    """Upper case, lower case and digits: not a word, not a path of words."""
    return bool(re.search(rb"[A-Z]", run) and re.search(rb"[a-z]", run) and re.search(rb"[0-9]", run))


def weak(found: list[tuple[int, int, int]], text: bytes, lower: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the weak parts outside the strong forms."""
    taken = [(i, j) for i, j, _ in sorted(found)]
    begins = [i for i, _ in taken]

    def free(i: int, j: int) -> bool:
        k = bisect.bisect_right(begins, i) - 1
        return not (k >= 0 and taken[k][1] > i or k + 1 < len(taken) and begins[k + 1] < j)

    users = [(m.start(), m.end(), 3) for m in _USER.finditer(lower) if free(*m.span())]
    ends = [(m.start(), m.end(), 5) for m in _ENDPOINT.finditer(lower) if free(*m.span())] if b"://" in lower else []
    places = [i for i, _, _ in ends]  # endpoints do not overlap

    def path(m: re.Match) -> bool:
        """A run with slashes inside an endpoint, but for one of the usual 40 characters, is a part of its path."""
        k = bisect.bisect_right(places, m.start()) - 1
        return k >= 0 and m.end() <= ends[k][1] and len(m.group()) != 40 and b"/" in m.group()

    runs = [(m.start(), m.end(), 4) for m in _SECRET.finditer(text) if mixed(m.group()) and not path(m) and free(*m.span())]
    return users + runs + ends


def near(parts: list[tuple[int, int, int]], reach: int):
    """Function (start, end): whether one of the parts lies at most ``reach`` away."""
    parts = sorted(parts)
    starts, ends = [i for i, _, _ in parts], list(accumulate((j for _, j, _ in parts), max))

    def test(start: int, end: int) -> bool:
        k = bisect.bisect_right(starts, end + reach)
        return k > 0 and ends[k - 1] >= start - reach

    return test


def linked(found: list[tuple[int, int, int]], parts: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """Weak parts that a complementary part stands beside."""
    held = near([x for x in found if x[2] in (0, 2)] + [x for x in parts if x[2] == 4], reach)  # whatever may be the secret part
    names = near([x for x in found if x[2] == 1] + [x for x in parts if x[2] == 3], reach)
    places = near([x for x in parts if x[2] == 5], reach)
    return [(i, j, kind) for i, j, kind in parts if (names(i, j) or places(i, j) if kind == 4 else held(i, j))]


def in_points(raw: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The parts with byte places turned into code points."""
    at, seen, place = {}, 0, 0
    for p in sorted({p for i, j, _ in found for p in (i, j)}):
        place += len(raw[seen:p].decode("utf-8", "surrogatepass"))
        at[p] = place
        seen = p
    return [(at[i], at[j], kind) for i, j, kind in found]


def spans_of(text: str, reach: int) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start, then kind."""
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower()  # bytes: A-Z only
    found = strong(raw, lower)
    parts = weak(found, raw, lower)
    if len(raw) != len(text):
        found, parts = in_points(raw, found), in_points(raw, parts)
    return sorted(found + (linked(found, parts, reach) if parts else []), key=lambda x: (x[0], x[2], x[1]))


def secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, spans (array of start, end, kind; code points, end exclusive) for every row.

    ``reach``: code points between parts of one scope.  A missing or empty text has no
    spans; a text of any length is searched whole.  Repeated rows come back as they
    are, rows without a doc_id too; other columns are left out.
    """
    kind = pa.array(KINDS)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches):
        for b in small(batches):
            found = [spans_of(t, reach) if t else [] for t in b.column("text").to_pylist()]
            flat = [x for row in found for x in row]
            offsets = [0]
            for row in found:
                offsets.append(offsets[-1] + len(row))
            values = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()),
                                                 kind.take(pa.array([x[2] for x in flat], pa.int64()))], fields=list(span))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
                                             ["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for i, j, kind in sorted(spans):
        if j <= at:
            continue
        if i >= at:
            out.append(text[at:i] + f"[{KINDS[kind]}]")
        at = j
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """The rows of ``docs`` with all columns; each secret in ``text`` is replaced by its kind, ``n_chars`` follows.

    Missing and empty texts, repeated rows and rows without a doc_id stay as they are.
    """
    def run(batches):
        for b in small(batches):
            new = []
            for t in b.column("text").to_pylist():
                found = spans_of(t, reach) if t else []
                new.append(redacted(t, found) if found else t)
            out = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(new, b.schema.field("text").type))
            at = b.schema.get_field_index("n_chars")
            if at >= 0:
                size = [None if t is None else len(t) for t in new]
                out = out.set_column(at, b.schema.field("n_chars"), pa.array(size, b.schema.field("n_chars").type))
            yield out

    return docs.mapInArrow(run, docs.schema)
