"""Url rules, shards, vectors and the pipeline against brute-force versions."""

import math
import random
import sys
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sleuthframe.llm import queries, sharding, urls, vectors


def verdict(url, rules, default="allow"):
    url = url or ""
    place = url.split("://", 1)[1] if "://" in url else ""
    for mark in "?#":
        place = place.split(mark, 1)[0]
    host = place.split("/", 1)[0]
    path = place[len(host):]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_urls_against_every_rule(spark):
    rnd = random.Random(1)
    hosts = ["net", "example.net", "a.example.net", "NET", "xnet", "example.com", "b.example.com", "org", "x.org", "a-b.org", "a.b.c.org", "", "net.", "net:80", "é.org"]
    paths = ["", "/", "/en/", "/en/x", "/de/y", "/fr/", "/fr/z?q=/en/", "#/en/", "?a://b", "/en", "//en/", "/de/\n?x"]
    rows = [(i, rnd.choice(["http://", "x://", "", "://"]) + rnd.choice(hosts) + rnd.choice(paths)) for i in range(600)]
    rows += [(600, None), (601, ""), (600, None), (None, "http://net/")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, host int, verdict int")
    many = list(queries.RULES) + [("com", "/", "allow"), ("a.example.net", "/en/", "block"), ("b.c.org", "", "block"), ("example.net", "/", "allow"),
                                  ("net", "/en/x", "block")]
    for rules in (queries.RULES, many):
        table = urls.rule_table(spark, rules).unionByName(spark.createDataFrame([(None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string"))
        got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_verdicts(pages, table).collect())
        assert got == Counter((i, *verdict(u, rules)) for i, u in rows)
    assert urls.url_verdicts(pages.where("false"), urls.rule_table(spark, many)).count() == 0
    free = urls.url_verdicts(pages, urls.rule_table(spark, many).where("false")).collect()
    assert len(free) == len(rows) and all(r["rule"] is None and r["verdict"] == "allow" for r in free)


def test_hypergeometric_law(spark):
    """Draws follow the exact law, at the ends of the range too."""
    total, good, drawn = 30, 12, 9
    got = spark.range(20000).select(sharding.hypergeometric(
        sharding.uniform(3, F.col("id")), F.lit(total), F.lit(good), F.lit(drawn)).alias("k")).groupBy("k").count().collect()
    seen = {r["k"]: r["count"] for r in got}
    ways = math.comb(total, drawn)
    chi = 0.0
    for k in range(0, 10):
        want = 20000 * math.comb(good, k) * math.comb(total - good, drawn - k) / ways
        if want >= 5:
            chi += (seen.get(k, 0) - want) ** 2 / want
    assert chi < 30 and all(0 <= k <= 9 for k in seen)
    for t, g, n, k in ((10, 10, 4, 4), (10, 0, 4, 0), (10, 5, 0, 0), (10, 5, 10, 5), (0, 0, 0, 0), (10 ** 12, 10 ** 11, 10, None)):
        value = spark.range(1).select(sharding.hypergeometric(F.lit(0.999999), F.lit(t), F.lit(g), F.lit(n))).first()[0]
        assert value == k if k is not None else 0 <= value <= 10


@pytest.mark.parametrize("count,cell_rows,parts", [(40, 250_000, 3), (7, 20, 5), (3, 10, 1), (1, 50, 4)])
def test_shards_are_exact_and_whole(spark, count, cell_rows, parts):
    rows = [(i if i % 10 else None, None if i % 7 == 0 else "é" * (i % 5), 1) for i in range(503)] + [(1, "x", 1)] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(parts)
    got = sharding.shards(docs, count, cell_rows=cell_rows).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(count)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 603
    assert sharding.shards(docs.where("false"), count).count() == 0


def test_shards_are_uniform(spark):
    """Over many seeds every row is in every shard about equally often."""
    docs = spark.createDataFrame([(i, "x") for i in range(20)], "doc_id long, text string").repartition(4).cache()
    seen = Counter((r["doc_id"], r["shard"]) for seed in range(60) for r in sharding.shards(docs, 4, seed=seed, cell_rows=3).collect())
    chi = sum((seen[d, s] - 15) ** 2 / 15 for d in range(20) for s in range(4))
    assert chi < 115  # 60 degrees of freedom


def test_vectors_against_every_pair(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(50, rows[50][1]), (None, [0.1] * 8), (1000, None), (1050, []), (1100, [None] * 8), (1150, [float("nan")] * 8),
             (1200, [float("inf")] + [0.0] * 7), (1250, [0.5, 0.25]), (1300, [0.1, -3.0]), (1350, [1.0] * 3), (1400, [1e300] * 8),
             (1450, [1e7, -1e7] + [0.0] * 6), (1451, [3e9] * 8), (1500, [1.7e308, -1.7e308] + [0.0] * 6)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    own = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows)
           if i is not None and v and all(x is not None and math.isfinite(x) and abs(x) < 1e301 for x in v)]
    own.append((len(rows) - 1, 1500, [math.floor(sys.float_info.max), -math.floor(sys.float_info.max)] + [0] * 6))  # 256 x is beyond a double
    want = Counter()
    for n, i, v in own:
        if i % 50 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -2 ** 63), 2 ** 63 - 1), j) for m, j, w in own if m != n and len(w) == len(v))[:5]
            want.update((i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1))
    for blocks in ((4096, 256), (32, 3), (32, 3, 600, 2), (50, 7, 100, 1)):
        got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.top_k(frame, 50, 5, *blocks).collect())
        assert got == want
    assert vectors.top_k(frame.where("false")).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, before, folder).cache()
        assert kept.columns == docs.columns, name
        ids, was = [r["doc_id"] for r in kept.select("doc_id").collect()], {r["doc_id"] for r in before.select("doc_id").collect()}
        assert len(ids) == len(set(ids)) and set(ids) <= was
        before = kept
    last = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in before.collect()}
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(whole.select("doc_id", "n_tokens").collect()) == sorted(last.select("doc_id", "n_tokens").collect())


def test_pipeline_odd_rows(spark):
    """Missing values, repeated rows, a column more and an empty table go through every stage."""
    folder = "/root/testdata/sf0.001"
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (2, "hello there world", "en", "s", 17, 1), (2, "hello there world", "en", "s", 17, 1),
            (3, "token = abcdefgh1234", "en", "s", 20, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int")
    for frame in (docs, docs.where("false"), docs.drop("fp").repartition(3)):
        before = frame
        for _, stage in corpus_pipeline.STAGES:
            before = stage(spark, before, folder)
        before.collect()
