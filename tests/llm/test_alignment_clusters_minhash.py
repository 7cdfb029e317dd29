"""Token alignment, centroid clustering and MinHash groups against brute force; nulls, empty, long, repeated and clashing input."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sleuthframe.llm import alignment, clustering, minhash

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "   \n\t", "one", "one two three", "Ünïcode  wörds – ΟΔΟΣ 東京   x", "a" * 5000, "the cat " * 3000, "x\x1cy\x85z w",
       "<|endoftext|> <s>a</s><unk>", "a▁b", "'LL it's 12³ Ⅷ ½", "\U0001f600\U0001f600 é é İ ẞ", "one two three", "ends in space  "]
CLASHING = ("n_a", "pair", "chunk", "node", "key", "a", "b", "n", "cluster", "x", "place", "id", "component_id", "kept", "label")


@pytest.fixture(scope="module")
def docs(spark):
    sample = [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (3, "one"), (None, None)] + sample
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})


def aligned_by_hand(text, a, b, piece):
    """Tokens, groups and links of one text, token by token; None where the bytes differ."""
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    part_a, part_b = [piece[0][i] for i in ids_a], [piece[1][i] for i in ids_b]
    want = (" " + text).encode()
    if b"".join(part_a) != want or b"".join(part_b) != want:
        return None
    ends = [[sum(map(len, p[:0])) + n for n in np.cumsum([len(x) for x in p]).tolist()] for p in (part_a, part_b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    sides = [[[] for _ in cuts] for _ in "ab"]
    for side, ids, at in zip(sides, (ids_a, ids_b), ends):
        for i, e in zip(ids, at):
            side[bisect.bisect_left(cuts, e)].append(i)
    links = Counter((x, y) for u, v in zip(*sides) for x in u for y in v)
    starts = [[0, *e[:-1]] for e in ends]
    shared = sum(1 for i, e in enumerate(ends[0]) for j in range(bisect.bisect_right(ends[1], starts[0][i]), len(ids_b)) if starts[1][j] < e) \
        if len(ids_a) < 400 else None
    spelt = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in zip(*sides))
    return len(ids_a), len(ids_b), len(cuts), shared, links, hashlib.sha256(spelt.encode()).hexdigest()


@pytest.mark.parametrize("chunk", [2000, 1 << 23])
def test_alignment_against_every_link(spark, docs, chunk):
    a, b, pair = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.Pair(open(A).read(), open(B, "rb").read())
    a.encode_special_tokens = True
    rows = [(r["doc_id"], aligned_by_hand(r["text"], a, b, (pair.bytes_a, pair.bytes_b))) for r in docs.collect()]
    held = Counter(k for _, f in rows if f for k in f[4])
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    want = Counter()
    for i, f in rows:
        want[(i, 0, 0, 0, 0, 0, 0, "") if f is None else (
            i, *f[:3], sum(f[4].values()), sum(n for k, n in f[4].items() if held[k] == top[k[0]]), sum(n * held[k] for k, n in f[4].items()), f[5])] += 1
    got = alignment.alignment(docs, A, B, chunk).collect()
    assert Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got) == want
    shared = Counter((i, f[3]) for i, f in rows if f and f[3] is not None)
    assert not shared - Counter((r["doc_id"], r["n_overlaps"]) for r in got)
    assert any(f is None for _, f in rows[2:]) and alignment.alignment(docs.where("false"), A, B).count() == 0


def test_byte_tokenizer_equals_the_library():
    """Both libraries give the same ids, also for hostile texts and special strings."""
    library, pair, rnd = Tokenizer.from_file(A), alignment.Pair(open(A).read(), open(B, "rb").read()), random.Random(2)
    library.encode_special_tokens = True
    words = [t.decode("utf-8", "ignore") for t in pair.bytes_a[:50000:7]]
    pool = [chr(c) for c in range(0x180)] + list("ΣςİıDž᠎​ 　﻿\U0001f600́中٣²Ⅷ가") + [" "] * 30 + ["<|endoftext|>", "'s", "the "]
    batch = ["".join(rnd.choices(pool, k=rnd.randint(1, 40))) for _ in range(3000)] + ["".join(rnd.choices(words, k=12)) for _ in range(3000)]
    for text, e in zip(batch, library.encode_batch(batch, add_special_tokens=False)):
        assert pair.a.encode_ordinary(text) == e.ids, text


def test_products_of_sparse_rows(monkeypatch):
    rnd = np.random.default_rng(1)
    for expanded in (3, 1 << 20):
        monkeypatch.setattr(alignment, "EXPANDED", expanded)
        x, y = rnd.integers(0, 3, (9, 7)) * rnd.integers(0, 2, (9, 7)), rnd.integers(0, 3, (7, 11)) * rnd.integers(0, 2, (7, 11))
        sparse = [alignment.rows_of(np.repeat(r, m[r, c]), np.repeat(c, m[r, c]), *m.shape) for m in (x, y) for r, c in [np.nonzero(m)]]
        got, dense = alignment.product(*sparse), np.zeros((9, 11), int)
        for i in range(9):
            dense[i, got.column[got.start[i]:got.start[i + 1]]] = got.value[got.start[i]:got.start[i + 1]]
        assert (dense == x @ y).all()


def by_hand(rows, k, rounds, scale=64):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes()))[:k]
    centroids = [list(v) for _, v in first]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for _ in range(rounds + 1):
        best = [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if _ < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, best) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    inertia = Counter()
    for d, n in best:
        inertia[n] += d
    return Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, best))


def test_centroids_by_hand(spark):
    rnd = random.Random(5)
    centre = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rnd.gauss(0, 0.2) for c in centre[i % 5]]) for i in range(250)] + [(500 + i, centre[0]) for i in range(60)]
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 63 + [None]), (904, [0.5] * 63 + [float("nan")]), (905, [float("inf")] * 64),
             (None, [0.25] * 64), (None, [0.5] * 64), (7, [0.1] * 64), (906, [0.0] * 64), (907, [-0.0] * 64)]
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def found(data, **more):
        table = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHING if c != "kept"})
        return Counter(tuple(r) for r in clustering.clusters(table.repartition(3), **more).select(columns).collect())

    assert found(rows) == by_hand(rows, 16, 3)
    assert found(rows, k=400, rounds=1) == by_hand(rows, 400, 1)
    assert found(rows[:3], rounds=2) == by_hand(rows[:3], 16, 2)
    assert not found(rows[310:316])
    large = rows[:40] + [(i, [2.0 ** 21 * x for x in v]) for i, v in rows[40:80]] + [(950, [2.0 ** 60] * 64)]  # integers that no double, no long can hold squared
    got = found(large[:-1], k=4)
    assert got == by_hand(large[:-1], 4, 3)
    wide = [(i, [2.0 ** 40 * x for x in v]) for i, v in rows[:30]]
    assert {(r[0], r[1]) for r in found(wide, k=4)} == {(r[0], r[1]) for r in by_hand(wide, 4, 3)} and all(r[2] is None or r[2] == 0 for r in found(wide, k=4))
    assert sum(found(large, k=4).values()) == 80


def test_hilbert_places_are_a_walk():
    """Places along the curve differ by one step in one coordinate."""
    for dim, bits in ((2, 4), (3, 2), (5, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), -1).reshape(-1, dim)
        place = [int.from_bytes(k.tobytes(), "big") for k in clustering.hilbert(points, bits)]
        assert len(set(place)) == len(points)
        walk = points[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_leave_the_nearest_centroid_in():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        x, c = rnd.integers(-9, 9, (20, 4)) + rnd.integers(-30, 30, 4), rnd.integers(-30, 30, (6, 4))
        label, apart = clustering.nearest(x, x.min(0), x.max(0), c)
        every = ((x[:, None] - c) ** 2).sum(2)
        assert (label == every.argmin(1)).all() and (apart is None or (apart == every.min(1)).all())


def signature_by_hand(codes, places):
    out = [2 ** 64 - 1] * places
    for code in codes:
        walk = list(range(places))
        for step in range(places):
            draw = int(minhash.mix(np.array([(int(code) + (step + 1) * 0x9E3779B97F4A7C15) % 2 ** 64], np.uint64))[0])
            to = step + ((draw & 0xFFFFFFFF) * (places - step) >> 32)
            walk[step], walk[to] = walk[to], walk[step]
            out[walk[step]] = min(out[walk[step]], step << 32 | draw >> 32)
    return out


def test_signatures_equal_the_whole_walk(monkeypatch):
    """Early stopping, long sets in parts and sets side by side change nothing; equal places estimate the similarity."""
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 0, 200, 90)]
    for most in (64, 1 << 16):
        monkeypatch.setattr(minhash, "ELEMENTS", most)
        got = minhash.signatures(sets, 24)
        assert [list(map(int, r)) for r in got] == [signature_by_hand(s, 24) for s in sets]
    errors = []
    for _ in range(60):
        both = rnd.integers(0, 2 ** 63, 240).astype(np.uint64)
        x, y = minhash.signatures([both[:200], both[40:]], 252)
        errors.append((x == y).mean() - 160 / 240)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < np.sqrt(2 / 9 / 252)


def test_minhash_groups_against_all_pairs(spark, docs):
    def words(text):
        return (text or "").encode().lower().split()

    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choices("klmnopqrst", k=5)) for _ in range(900)]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for g in range(60):  # edited copies on both sides of the limit, and texts with half in common
        base = rnd.choices(vocabulary, k=rnd.choice((1, 2, 5, 12, 60, 150)))
        for c in range(5):
            new = list(base)
            for p in rnd.sample(range(len(new)), min(len(new), round(len(new) * c * 0.03))):
                new[p] = "edited" + str(rnd.randrange(3))
            rows.append((5000 + 10 * g + c, " ".join(new)))
    line = " ".join(rnd.choices(vocabulary, k=80))
    rows += [(9000 + i, line + " " + " ".join(rnd.choices(vocabulary, k=18 + i % 9))) for i in range(80)]  # around the limit, all with one passage
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = Counter()
    for i, (d, _) in enumerate(rows):
        component = least.get(root(i)) if sets[i] else d
        want[(d, len(sets[i]), component, d == component)] += 1
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING}).repartition(5)
    got = Counter(tuple(r) for r in minhash.near_duplicates(table).collect())
    assert got == want
    assert minhash.near_duplicates(table.where("false")).count() == 0
