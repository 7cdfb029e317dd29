import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from sleuthframe.config import Settings, Weights
from sleuthframe.functions import similarity as sim
from sleuthframe.operators import correlate, scan

T0 = datetime(2024, 1, 1)
COLUMNS = ("type string, id string, label string, entity_value string, entity_type string, timestamp timestamp, "
           "source string, event_type string, case_id long")


def artifacts(spark, rows):
    """(id, entity, seconds or None, source, event, case)"""
    data = [("X", i, i, e, "ip", None if t is None else T0 + timedelta(seconds=t), s, v, c) for i, e, t, s, v, c in rows]
    return spark.createDataFrame(data, COLUMNS).withColumn("t", F.unix_micros("timestamp"))


# ---- the scoring rules in plain Python, as the tests' own yardstick ---------

def py_entity(a, b):
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 0.75 if (a in b or b in a) and len(min(a, b)) >= 4 else 0.0


def py_source(a, b):
    if not a or not b:
        return 0.1
    return 1.0 if a == b else 0.6 if a in b or b in a else 0.2


def py_event(a, b):
    if not a or not b:
        return 0.2
    if a == b:
        return 1.0
    kinds = {frozenset((x in sim.AUTH_EVENTS, x in sim.EXEC_EVENTS)) for x in (a, b)}
    crossed = (a in sim.AUTH_EVENTS and b in sim.EXEC_EVENTS) or (a in sim.EXEC_EVENTS and b in sim.AUTH_EVENTS)
    return 0.7 if crossed else 0.3


def py_pairs(rows, focus, window=3600, cross_case=False):
    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if not (a[0] in focus or b[0] in focus) or (not cross_case and a[5] != b[5]):
                continue
            same = py_entity(a[1], b[1]) == 1.0
            undated = a[2] is None or b[2] is None
            delta = None if undated else abs(a[2] - b[2])
            if not (same or undated or delta < window):
                continue
            s_time = 0.0 if undated or delta >= window else round(1 - delta / window, 4)
            score = round(0.30 * s_time + 0.35 * py_entity(a[1], b[1]) + 0.15 * py_source(a[3], b[3]) + 0.20 * py_event(a[4], b[4]), 4)
            if score >= 0.15:
                out[frozenset((a[0], b[0]))] = score
    return out


row = st.tuples(st.sampled_from(["10.0.0.1", "10.0.0.10", "host", "", "zabc", "azabc", "USER "]),
                st.one_of(st.none(), st.integers(0, 9000)), st.sampled_from(["a.log", "a.log.1", "b", ""]),
                st.sampled_from(["4624", "4688", "click", ""]), st.integers(1, 2))


@hyp(max_examples=12, deadline=None)
@given(st.lists(row, min_size=2, max_size=25), st.integers(1, 6), st.booleans())
def test_focus_pairs_equal_brute_force(spark, drawn, n_focus, cross):
    rows = [(f"x{i:02d}", *r) for i, r in enumerate(drawn)]
    focus = {r[0] for r in rows[:n_focus]}
    df = artifacts(spark, rows)
    got = correlate.focus_pairs(df, df.filter(F.col("id").isin(*focus)), Settings(cross_case=cross)).collect()
    keys = [frozenset((r.artifact_a_id, r.artifact_b_id)) for r in got]
    assert len(keys) == len(set(keys))
    want = py_pairs(rows, focus, cross_case=cross)
    assert set(keys) == set(want)
    for k, r in zip(keys, got):
        assert r.score == pytest.approx(want[k], abs=1.1e-4)


def test_large_focus_needs_no_broadcast(spark, monkeypatch):
    rows = [(f"x{i:02d}", f"e{i % 3}", i * 700, "s", "v", 1) for i in range(20)]
    df = artifacts(spark, rows)
    whole = {(r.artifact_a_id, r.artifact_b_id) for r in correlate.focus_pairs(df, df, Settings(cross_case=False)).collect()}
    monkeypatch.setattr(correlate, "FOCUS_LIMIT", 3)
    again = {(r.artifact_a_id, r.artifact_b_id) for r in correlate.focus_pairs(df, df, Settings(cross_case=False)).collect()}
    assert whole == again and whole


def test_reference_rows(spark):
    df = artifacts(spark, [("a", "192.168.1.50", 0, "auth.log", "ip", 1), ("b", "192.168.1.50", 300, "network.pcap", "ip", 1),
                           ("c", "10.99.99.99", 86400, "network.pcap", "ip", 1)])
    got = {(r.artifact_a_id, r.artifact_b_id): r for r in correlate.focus_pairs(df, df, Settings(cross_case=False)).collect()}
    strong = got["a", "b"]
    assert strong.score >= 0.70 and strong.strength_category == "Strong" and "192.168.1.50" in strong.reason
    assert all(r.score < 0.40 for k, r in got.items() if "c" in k)


@pytest.mark.parametrize("a, b, want", [("b1234567", "azz", 0.0), ("abc", "xabcx", 0.0), ("zabc", "azabc", 0.75),
                                        ("bcd", "abcde", 0.75), (" A ", "a", 1.0), (None, "a", 0.0)])
def test_entity_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(sim.entity_similarity(F.col("a"), F.col("b"))).first()[0] == want


def test_scores_and_categories(spark):
    df = spark.range(1)
    lit = F.lit
    score = sim.weighted_score(lit(1.0), lit(0.0), lit(0.0), lit(0.0), Weights(0.5, 0.2, 0.1, 0.2))
    assert df.select(score).first()[0] == 0.50
    names = [df.select(sim.strength(lit(x))).first()[0] for x in (0.85, 0.70, 0.65, 0.40, 0.35, 0.10)]
    assert names == ["Strong", "Strong", "Moderate", "Moderate", "Weak", "Weak"]
    assert df.select(sim.event_similarity(lit("4624"), lit("process"))).first()[0] == 0.7


def test_settings_are_checked():
    for bad in (lambda: Weights(time=1.5), lambda: Settings(window_seconds=0), lambda: Settings(anomaly_threshold=-0.1)):
        with pytest.raises(ValueError):
            bad()


# ---- buckets, counts, scans -------------------------------------------------

def py_buckets(times, window):
    out, start = {}, None
    for t in sorted(set(times)):
        if start is None or t - start > window:
            start = t
        out[t] = start
    return out


@hyp(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 40000), min_size=1, max_size=60))
def test_anchored_buckets_equal_greedy_loop(spark, times):
    df = artifacts(spark, [(f"x{i}", "e", t, "s", "v", 1) for i, t in enumerate(times)])
    base = df.agg(F.min("t")).first()[0] - min(times) * 1_000_000
    got = {(r.t - base) // 1_000_000: (r.bucket_start - base) // 1_000_000
           for r in correlate.anchored_buckets(df, Settings()).collect()}
    assert got == py_buckets(times, 3600)


def test_fixture_buckets(spark):
    df = artifacts(spark, [(f"x{t}", "e", t, "s", "v", 1) for t in (0, 3000, 3600, 3601, 7000)])
    got = correlate.anchored_buckets(df, Settings()).groupBy("bucket_start").count().orderBy("bucket_start").collect()
    assert [r["count"] for r in got] == [3, 2]


@hyp(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 3_000_000_000)), min_size=1, max_size=60), st.integers(1, 2_000_000_000))
def test_band_counts_equal_brute_force(spark, points, width):
    df = spark.createDataFrame(points, "k long, t long")
    got = {(r.k, r.t): r.n_near for r in scan.band_counts(df, ["k"], "t", width).collect()}
    assert got == {(k, t): sum(1 for a, b in points if a == k and abs(b - t) < width) for k, t in set(points)}


plain = st.tuples(st.sampled_from(["10.0.0.1", "host", ""]), st.integers(0, 9000), st.sampled_from(["a.log", "b"]),
                  st.sampled_from(["click", "4624"]), st.integers(1, 2))


@hyp(max_examples=6, deadline=None)
@given(st.lists(plain, min_size=2, max_size=40))
def test_pair_summary_equals_brute_force(spark, drawn):
    rows = [(f"x{i:02d}", *r) for i, r in enumerate(drawn)]
    df = artifacts(spark, rows)
    got = {(r.case_id, r.correlation_type, r.strength_category): r.n_pairs
           for r in correlate.pair_summary(df, Settings(cross_case=False)).collect()}
    pairs = correlate.focus_pairs(df, df, Settings(cross_case=False))
    want = {(r.case_id, r.correlation_type, r.strength_category): r["count"]
            for r in pairs.groupBy("case_id", "correlation_type", "strength_category").count().collect()}
    assert got == want


def test_hot_key_is_not_one_window(spark):
    """A key with most of the rows is cut into seconds: no window of the plan is partitioned by the key alone."""
    df = spark.range(20000).select(F.lit(1).alias("k"), (F.col("id") * 1000).alias("t"))
    plan = scan.band_counts(df, ["k"], "t", 5_000_000)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_sec" in w or "_blk" in w for w in windows)
    assert scan.band_counts(df, ["k"], "t", 5_000_000).agg(F.max("n_near")).first()[0] == 9999


def test_no_cartesian_plans(spark):
    df = artifacts(spark, [(f"x{i}", f"e{i % 5}", i * 100, "s", "v", 1) for i in range(50)])
    plan = correlate.focus_pairs(df, df.limit(3))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_last_correlation_wins(spark):
    edges = spark.createDataFrame([(1, "a", "b", 0.9, "Strong", "r1", "ENTITY_MATCH"), (2, "a", "c", 0.2, "Weak", "r2", "MULTI_FACTOR")],
                                  "record_id long, artifact_a_id string, artifact_b_id string, score double, strength_category string, reason string, correlation_type string")
    got = {r.artifact_id: (r.score, r.group_id) for r in correlate.last_correlation(edges).collect()}
    assert got == {"a": (0.2, "group_multi_factor_2"), "b": (0.9, "group_entity_match_1"), "c": (0.2, "group_multi_factor_2")}


def test_containing_values_by_grams(spark):
    """All contained values, short and long ones, of many alphabets; one value of 20,000 characters beside 300 others."""
    import random
    import time
    rnd = random.Random(3)
    words = ["".join(rnd.choices("ab", k=rnd.randint(1, 7))) for _ in range(150)] + ["東京", "京", "😀x", "x😀xy", "a b", " a", "user1", "user12", "xuser12y"]
    words += [rnd.choice(words) + rnd.choice(words) for _ in range(150)]
    long = "".join(rnd.choices("abcdefghij0123456789", k=20_000))
    words += [long, long[500:900], long[7000:7004], long[19_990:], long + "z"]
    rows = [(i % 3 if i % 5 else None, w) for i, w in enumerate(words)] + [(0, w) for w in words[-5:]] + [(0, None), (0, "  "), (1, "USER1")]
    frame = spark.createDataFrame(rows, "case_id long, entity_value string")
    start = time.time()
    got = {tuple(r) for r in correlate.containing_values(frame).select("case_id", "outer_value", "inner_value").collect()}
    took = time.time() - start
    clean = lambda w: (w or "").strip(" ").lower()
    held = {(c, clean(w)) for c, w in rows if c is not None and clean(w)}
    want = {(c, x, y) for c, x in held for d, y in held if c == d and x != y and y in x and len(min(x, y)) >= 4}
    assert got == want and len(want) > 100 and took < 60


@pytest.mark.parametrize("target", [None, 2])
def test_sightings_in_other_cases_against_all_pairs(spark, target):
    """Many sightings at one time, runs of one case, negative times; rows without entity, time or case have none."""
    rnd = random.Random(5)
    rows = [(f"x{i:03}", rnd.choice((1, 1, 1, 2, 3)), rnd.choice(("Ann ", "ann", "bob")), rnd.randint(-12, 12) * rnd.choice((1, 10 ** 12))) for i in range(150)]
    rows += [(f"y{i}", 1, "eve", i) for i in range(4)] + [("z0", None, "ann", 1), ("z1", 1, " ", 1), ("z2", 2, "ann", None), ("z3", 2, None, 5)]
    got = correlate.other_case_sightings(spark.createDataFrame(rows, "id string, case_id long, entity_value string, t long"), target).collect()
    side = lambda r: r[1] if target is None else r[1] == target
    kept = [r for r in rows if r[1] is not None and (r[2] or "").strip() and r[3] is not None]
    want = set()
    for a in kept:
        others = [b for b in kept if b[2].strip().lower() == a[2].strip().lower() and side(b) != side(a)]
        before = min(((-b[3], b[0]) for b in others if b[3] <= a[3]), default=(None, None))
        after = min(((b[3], b[0]) for b in others if b[3] >= a[3]), default=(None, None))
        want.add((a[0], before[1], None if before[0] is None else -before[0], after[1], after[0]))
    assert {(r["id"], r["before_id"], r["before_t"], r["after_id"], r["after_t"]) for r in got} == want and len(got) == len(kept)
