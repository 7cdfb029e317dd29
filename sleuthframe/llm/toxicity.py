"""Toxic passages by maximum-scoring segments.

Every word has a log-odds weight between toxic and clean labelled texts, shrunk by a
Dirichlet prior in proportion to the word's frequency in the whole corpus; words not
listed fall back to their first letters.  Less a constant drift, ordinary text scores
below zero on average, and a passage of toxic words stands out as a segment of large
sum.  One scan finds all maximal segments of a text in linear time.  The best segment
of a clean text of n words follows an extreme-value law whose place grows with ln n:
fitted on labelled clean texts, it says how significant a segment is.  The score is
the probability that labels give to that significance.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import small, texts

#: Words of a listed start: these many first characters.
STARTS = (5, 7)
_BUCKETS = 1 << 15
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def bucket(word: str) -> int:
    import zlib
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % _BUCKETS


def features(word: str) -> list[str]:
    """The word and its longer starts, longest first."""
    return [word] + [f"{word[:n]}*" for n in reversed(STARTS) if len(word) > n]


def segments(at: list[int], weight: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, end), in order.

    at, weight: places and weights of the words that score above zero; every other word
    scores -drift.  A candidate that reaches a new height joins back over those before
    it up to the last one that started lower (one pass with a stack).
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest one that starts lower
    total, last = 0.0, -1
    for i, w in zip(at, weight):
        total -= drift * (i - last - 1)
        first, end, low, high = i, i + 1, total, total + w
        total, last = high, i
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= high:
                stack.append((first, end, low, high, k))
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:]
    return [(high - low, first, end) for first, end, low, high, _ in stack]


class Model:
    """Word weights, the extreme-value law of clean texts and the curve from significance to probability."""

    def __init__(self, weights: dict[str, float], drift: float):
        self.weights, self.drift = weights, drift
        self.scale, self.place, self.spread = 1.0, 0.0, 1.0
        self.curve = np.zeros(4)

    def weigh(self, word: str) -> float:
        for f in features(word):
            w = self.weights.get(f)
            if w is not None:
                return w
        return 0.0

    def scan(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of words, maximal segments."""
        found = tokens(text)
        known, at, weight = self.known, [], []
        for i, w in enumerate(map(known, found)):
            if w > 0:
                at.append(i)
                weight.append(w)
        return len(found), segments(at, weight, self.drift) if at else []

    def ready(self) -> "Model":
        """Weights of listed words are looked up once per word."""
        from .bpe import Memo
        self.known = Memo(self.weigh).__getitem__
        return self

    def excess(self, score: float, n: int) -> float:
        """A segment's score in standard places of the clean law for n words."""
        return (self.scale * score - math.log(max(n, 1)) - self.place) / self.spread

    def significance(self, n: int, found: list[tuple[float, int, int]]) -> list[float]:
        """Chance that clean text of n words has a segment as good, for each segment."""
        return [-math.expm1(-math.exp(-max(-30.0, min(700.0, self.excess(s, n))))) for s, _, _ in found]

    def evidence(self, n: int, found: list[tuple[float, int, int]]) -> np.ndarray:
        """What the curve sees: best excess, sum of all positive excesses, one, no segment at all."""
        over = [self.excess(s, n) for s, _, _ in found]
        best = max(over, default=-3.0)
        return np.array([min(max(best, -5.0), 20.0), math.log1p(sum(x for x in over if x > 0)), 1.0, float(not over)])

    def probability(self, n: int, found: list[tuple[float, int, int]]) -> float:
        z = float(self.evidence(n, found) @ self.curve)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def training(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """doc_id, text, toxic of at most ``max_labels`` labelled rows, those of the least hashed ids.

    The chosen labels are few and bounded, so that they go to the documents and not the
    documents to them.  A doc_id with several labels counts as toxic if one of them says so.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def corpus_frequency(docs: DataFrame) -> np.ndarray:
    """Share of the words of all documents that fall into each hashed bucket."""
    def run(batches):
        total = np.zeros(_BUCKETS, np.int64)
        from .bpe import Memo
        known = Memo(bucket).__getitem__
        for b in small(batches):
            for text in b.column("text").to_pylist():
                found = tokens(text)
                if found:
                    total += np.bincount(np.fromiter(map(known, found), np.int64, len(found)), minlength=_BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    counted = texts(docs).select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.ones(_BUCKETS)
    for r in counted.collect():  # one row per bucket
        out[r["bucket"]] += r["n"]
    return out / out.sum()


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, max_features: int = 20_000, prior_share: float = 0.005,
        least: int = 3, least_z: float = 3.0, drift: float = 1.0) -> Model:
    """Learn from at most ``max_labels`` labelled rows; word frequencies come from all documents.

    ``least``: toxic texts a word has to stand in to be listed; ``least_z``: standard
    deviations its log-odds has to lie above zero; ``max_features``: listed words, those
    of the greatest ratio; ``prior_share``: weight of the corpus in the Dirichlet prior, as
    a share of the labelled words; ``drift``: what every unlisted word costs a segment.
    Seven tenths of the labelled rows give the words, the others the calibration.
    Without labelled rows of both kinds no word is listed and every text gets the same score.
    """
    train = durable(training(docs, labels, max_labels))

    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(10)) < 3  # three tenths calibrate, on words chosen without them

    def count(batches):
        n_tox, n_clean, docs_tox, words = Counter(), Counter(), Counter(), [0, 0]
        for b in small(batches):
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                found = tokens(text)
                words[toxic > 0] += len(found)
                each = Counter()
                for w, n in Counter(found).items():
                    for f in features(w):
                        each[f] += n
                (n_tox if toxic > 0 else n_clean).update(each)
                if toxic > 0:
                    docs_tox.update(each.keys())
        rows = [(f, n_tox[f], n_clean[f], docs_tox[f]) for f in n_tox.keys() | n_clean.keys()] + [("", words[1], words[0], 0)]
        for i in range(0, len(rows), 50_000):
            f, a, b, c = zip(*rows[i:i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())],
                                             ["feature", "tox", "clean", "docs"])

    summed = durable(train.where(~fold).select("text", "toxic").mapInArrow(count, "feature string, tox long, clean long, docs long")
                     .groupBy("feature").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"), F.sum("docs").alias("docs"))
                     .where(f"docs >= {least} or feature = ''"))
    totals = summed.where("feature = ''").first()
    n_tox, n_clean = (totals["tox"], totals["clean"]) if totals else (0, 0)
    frequency = corpus_frequency(docs)
    # a bounded list: the greatest raw ratios first, the prior then decides
    ratio = F.col("tox") / F.lit(float(max(n_tox, 1))) / ((F.col("clean") + 0.5) / F.lit(float(max(n_clean, 1))))
    listed = summed.where("feature != ''").orderBy(F.desc(ratio * F.log1p("docs")), "feature").limit(max_features).collect()
    weights, prior = {}, prior_share * (n_tox + n_clean)
    for r in listed:
        a = prior * frequency[bucket(r["feature"].rstrip("*"))] + 0.01
        odds_tox = (r["tox"] + a) / (n_tox + prior - r["tox"] - a)
        odds_clean = (r["clean"] + a) / (n_clean + prior - r["clean"] - a)
        delta = math.log(max(odds_tox, 1e-12) / max(odds_clean, 1e-12))
        spread = math.sqrt(1 / (r["tox"] + a) + 1 / (r["clean"] + a))
        sure = delta - 1.0 * min(spread, 3.0)  # what is left after one standard deviation
        if sure > drift and delta / spread > least_z:
            weights[r["feature"]] = round(sure - drift, 6)
    model = Model(weights, drift)
    return calibrate(model, train.where(fold))


def calibrate(model: Model, train: DataFrame) -> Model:
    """Fit the clean texts' extreme-value law, then the curve, on the labelled rows.

    What comes to the driver is a few numbers for each labelled doc_id: where an id stands in
    several rows, the least of them.
    """
    def each(of, names: list[str]) -> list:
        def run(batches):
            own = model.ready()
            for b in small(batches):
                rows = [of(*own.scan(text)) for text in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *[pa.array([float(r[i]) for r in rows]) for i in range(len(names))]],
                                                 ["doc_id", "toxic", *names])

        found = train.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, " + ", ".join(f"{n} double" for n in names))
        return found.groupBy("doc_id").agg(F.min(F.struct("toxic", *names)).alias("r")).select("r.*").collect()

    tops = np.array([(math.log(max(r["n"], 1)), r["best"]) for r in each(lambda n, found: (n, max((s for s, _, _ in found), default=-1)), ["n", "best"])
                     if r["toxic"] <= 0 and r["best"] > 0]).reshape(-1, 2)
    if len(tops) >= 30:
        top = tops[:, 1]
        beta = max(float(top.std()) * math.sqrt(6) / math.pi, 1e-3)
        model.scale = 1 / beta
        rest = top / beta - tops[:, 0]
        model.spread = max(float(rest.std()) * math.sqrt(6) / math.pi, 1e-3)
        model.place = float(rest.mean()) - 0.5772156649 * model.spread
    seen = each(model.evidence, ["best", "over", "one", "none"])
    x = np.array([[r["best"], r["over"], r["one"], r["none"]] for r in seen]).reshape(-1, 4)
    y = np.array([r["toxic"] > 0 for r in seen], float)
    if len(y) and 0 < y.sum() < len(y):
        model.curve = logistic(x, y)
    elif len(y):
        model.curve = np.array([0, 0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0])
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, model: Model, alpha: float = 0.01) -> DataFrame:
    """doc_id, score, passages (first word, end, score, chance) for every row.

    passages: all maximal segments that clean text of that length has with a chance
    below ``alpha``.  A missing or empty text has no passage and the score of a text
    without evidence; texts of any length are scanned whole; repeated rows come back as
    they are, rows without a doc_id too; other columns are left out.
    """
    passage = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())])

    def run(batches):
        own = model.ready()
        for b in small(batches):
            scores, passages = [], []
            for text in b.column("text").to_pylist():
                n, found = own.scan(text)
                scores.append(own.probability(n, found))
                passages.append([{"first": i, "end": j, "score": s, "chance": c}
                                 for (s, i, j), c in zip(found, own.significance(n, found)) if c < alpha])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))],
                                             ["doc_id", "score", "passages"])

    return texts(docs).mapInArrow(
        run, "doc_id long, score double, passages array<struct<first:int,end:int,score:double,chance:double>>")
