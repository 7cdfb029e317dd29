import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sleuthframe.catalog import anomaly as anomaly_queries
from sleuthframe.operators import aggregates as agg, anomaly, evaluate, filters, rank


def test_row_text(spark):
    df = spark.createDataFrame([(4625, "Security", {"TargetUserName": "admin"}), (None, None, {})], "e int, p string, d map<string,string>")
    got = [r[0] for r in df.select(anomaly.row_text(F.col("e"), F.col("p"), F.col("d"))).collect()]
    assert got == ["EventID 4625 Provider Security Data TargetUserName:admin", "EventID 0 Provider Unknown Data "]


@pytest.fixture(scope="module")
def scored(spark):
    """Four hundred plain log-ons and eight odd rows."""
    usual = [(i, 4624, "Security", {"TargetUserName": f"user{i % 5}", "Workstation": f"WORK-00{i % 5}"}) for i in range(400)]
    odd = [(1000 + i, 4688, "Sysmon", {"NewProcessName": f"mimikatz{i}.exe", "CommandLine": "sekurlsa logonpasswords dump"}) for i in range(8)]
    df = spark.createDataFrame(usual + odd, "record long, event_id int, provider string, data map<string,string>")
    model = anomaly.fit_detector(df, "record")
    return df, model, anomaly.score_records(df, model).cache()


def test_forest_ranks_odd_rows_first(scored):
    _, _, rows = scored
    worst = [r.record for r in rows.orderBy("decision").limit(8).collect()]
    assert sum(r >= 1000 for r in worst) >= 7


def test_forest_flags_the_contamination(scored):
    df, model, rows = scored
    flagged = rows.filter("is_outlier").count()
    assert 8 <= flagged <= math.ceil(0.15 * (df.count() + len(anomaly.NORMAL_LINES))) + 1
    assert rows.filter("confidence < 0.6 OR confidence > 0.95").count() == 0


def test_same_input_same_model(spark, scored):
    df, model, rows = scored
    again = anomaly.fit_detector(df.repartition(7), "record")
    assert again.offset == pytest.approx(model.offset, abs=1e-12)


def test_explanation_shares(scored):
    df, model, rows = scored
    flagged = anomaly.findings(rows)
    shares = anomaly.explain(flagged, "record", model)
    total = shares.groupBy("record").agg(F.sum("contribution_pct").alias("s"))
    assert total.filter("s < 95 OR s > 105").count() == 0
    told = anomaly.summaries(shares, flagged, "record").first().reason
    assert told.startswith("Isolation Forest flagged anomaly (Anomaly Score: 0.") and "vs Threshold: 0.80" in told


def test_average_path():
    assert list(anomaly.average_path([1, 2])) == [0.0, 1.0]
    assert anomaly.average_path([256])[0] == pytest.approx(10.2448, abs=1e-3)


def test_tree_over_values_that_differ_by_rounding():
    x = np.full((64, 2), 0.1)
    x[::2, 0] = np.nextafter(0.1, 1)
    x[::3, 1] = 0.1 + 2e-7
    for seed in range(50):
        assert sum(n[6] for n in anomaly._grow(x, np.random.default_rng(seed)) if n[1] < 0) == 64


def test_tree_isolates_an_outlier():
    x = np.vstack([np.random.default_rng(0).normal(0, 0.1, (255, 3)), [[9, 9, 9]]])
    nodes = anomaly._grow(x, np.random.default_rng(1))
    assert sum(n[6] for n in nodes if n[1] < 0) == 256 and max(n[5] for n in nodes) <= 8


@pytest.mark.parametrize("values, q", [([3.0], 0.15), ([5.0, 1.0, 2.0, 2.0, 9.0], 0.15), (None, 0.15), (None, 0.5), (None, 0.999)])
def test_exact_quantile(spark, values, q):
    values = values or [random.Random(7).gauss(0, 1) for _ in range(3000)] + [0.25] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert agg.exact_quantile(df, "x", q, bins=16, small=40) == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def py_auc(scores, labels):
    if len(set(labels)) < 2:
        return 0.5
    pos, neg = sum(labels), len(labels) - sum(labels)
    pts = []
    for i in range(51):
        th = i / 50.0
        pts.append((sum(s >= th and l == 0 for s, l in zip(scores, labels)) / neg, sum(s >= th and l == 1 for s, l in zip(scores, labels)) / pos))
    pts.sort(key=lambda p: p[0])
    return round(abs(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))), 4)


@pytest.mark.parametrize("rows", [[(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], [(0.1, 1), (0.2, 1)],
                                  [(random.Random(3).random(), random.Random(i).randint(0, 1)) for i in range(60)]])
def test_roc_auc(spark, rows):
    df = spark.createDataFrame(rows, "s double, l int")
    assert evaluate.roc_auc(df, "s", "l").first()[0] == pytest.approx(py_auc(*zip(*rows)), abs=1e-4)


def test_extraction_quality(spark):
    df = spark.createDataFrame([(["192.168.1.100", "x"], ["192.168.1.100", "admin"]), (["powershell.exe -enc"], ["powershell.exe"])], "a array<string>, e array<string>")
    r = evaluate.extraction_quality(df, "a", "e").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 6) and r.balance == round((r.precision + r.recall) / 2, 4)


def test_many_queries_go_in_batches(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    q = v.withColumnRenamed("vec_id", "query_id")
    key = lambda df: sorted((r.query_id, r.vec_id, round(r.cosine, 9)) for r in df.collect())
    whole = key(rank.top_similar(q, v, 3))
    assert key(rank.top_similar(q, v, 3, block=5)) == whole and len(whole) == 180


def test_grounding_rules(spark):
    a = spark.createDataFrame([(1, "see 10.0.0.1 and evil.net, app.log; verified by the investigator"), (2, "nothing")], "id long, text string")
    known = spark.createDataFrame([("10.0.0.1",)], "value string")
    got = {r.id: (r.entities_checked, r.fabricated_entities, r.grounding_score, r.has_disclaimer) for r in rank.grounding(a, ["id"], known).collect()}
    assert got == {1: (3, 1, 0.67, True), 2: (0, 0, 1.0, False)}


def test_orders(spark):
    df = spark.createDataFrame([("low",), ("Critical",), ("info",), ("high",)], "severity string")
    assert [r[0] for r in filters.grid_sort(df, "severity", ascending=False).collect()] == ["Critical", "high", "low", "info"]
    numbers = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "x string")
    assert [r[0] for r in filters.grid_sort(numbers, "x").collect()] == ["9", "10", "a", "b"]
    pages = spark.range(25).toDF("n")
    assert [r.n for r in filters.page(pages, [F.col("n").desc()], 2, 10).collect()] == list(range(14, 4, -1))
    assert len(filters.page(pages, [F.col("n")], 0, 0).collect()) == 1
    got, after = [], None
    while True:
        rows = filters.next_page(pages.withColumn("k", F.floor(F.col("n") / 3)), "k", "n", after, 4).collect()
        if not rows:
            break
        got += [r.n for r in rows]
        after = (rows[-1].k, rows[-1].n)
    assert got == list(range(24, -1, -1))


def test_timeline_order_and_fixture(spark):
    from datetime import datetime
    from sleuthframe.operators import timeline as tl
    f = spark.createDataFrame([(401, 1, "Alert", "CRITICAL", 95, "cat", datetime(2024, 1, 1, 3), 10, None)],
                              "id long, case_id long, title string, severity string, risk_score long, threat_category string, created_at timestamp, evidence_id long, filename string")
    n = spark.createDataFrame([(301, 1, 11, "10.0.0.1", "10.0.0.2", 1, 2, "TCP", None, None)],
                              "id long, case_id long, evidence_id long, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, value string, timestamp string")
    r = spark.createDataFrame([(1, 10, "security.evtx", 0, 4625, "Security", "2024-01-01T01:00:00Z", {"u": "Admin"}), (1, 10, "security.evtx", 1, 4688, None, "2024-01-01T02:00:00Z", {})],
                              "case_id long, evidence_id long, filename string, idx long, event_id int, provider string, timestamp string, data map<string,string>")
    rows = tl.build([tl.sessions(n), tl.alerts(f), tl.log_records(r)], ordered=True).collect()
    assert [x.event_id for x in rows] == ["evtx_10_4625_0", "evtx_10_4688_1", "finding_evt_401", "net_art_301"]
    assert rows[0].priority == "critical" and rows[3].timezone_badge == "MISSING" and rows[3].original_timestamp == "MISSING"


def test_streams_match_batches_over_several_micro_batches(spark, tmp_path):
    from sleuthframe.streaming import streams
    for i in range(4):
        (spark.range(i * 50, i * 50 + 60).select(F.col("id").alias("evidence_id"), F.lit(1).alias("case_id"), (F.col("id") % 70).cast("string").alias("text"))
         .coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}")))
    src = str(tmp_path / "in" / "*")
    schema = "evidence_id long, case_id int, text string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = streams.run_ingest(stream, str(tmp_path / "out"), F.col("text"))
    assert got.select("sha256").distinct().count() == got.count() == 70


def test_timers_fail_stuck_jobs_over_batches_and_restarts(spark, tmp_path):
    from datetime import datetime
    from sleuthframe.streaming import streams
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    parts = [[(1, at(1), 1, "PROCESSING", "parse"), (2, at(1), 2, "PROCESSING", "hash"), (3, at(1), 3, "PROCESSING", "parse")],
             [(2, at(1, 20), 4, "COMPLETED", "done"), (3, at(1, 20), 5, "PROCESSING", "score"), (4, at(1, 25), 6, "FAILED", "parse")],
             [(3, at(1, 45), 7, "COMPLETED", "done"), (5, at(3), 8, "PROCESSING", "parse"), (6, at(3), 9, None, None)],
             [(7, at(5), 10, "COMPLETED", "done")]]
    schema = "job long, at timestamp, n long, status string, stage string"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        if i != 1:  # the query is stopped and started again between the parts
            out = streams.run_append(streams.stuck_by_timer(stream, "job", "at", "n"), str(tmp_path / "out"))
    assert sorted((r.job, r.stage) for r in out.collect()) == [(1, "parse"), (5, "parse")]
    assert [r.status for r in streams.failed(out).collect()] == ["FAILED", "FAILED"]
    assert {r.description for r in streams.cleanup_audit(out, "job").collect()} == {
        "Job 1 failed: stuck at stage 'parse'.", "Job 5 failed: stuck at stage 'parse'."}


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    from datetime import datetime
    from sleuthframe.streaming import streams
    rows = [[datetime(2024, 1, 10, 1)], [datetime(2024, 1, 20, 1)], [datetime(2024, 1, 2, 1)], [datetime(2024, 1, 20, 2)]]
    for i, r in enumerate(rows):
        spark.createDataFrame([(x,) for x in r], "ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = {r.day: r.n for r in streams.run_update(streams.daily_counts(stream), ["day"], str(tmp_path / "out")).collect()}
    assert got == {"2024-01-10": 1, "2024-01-20": 2}
