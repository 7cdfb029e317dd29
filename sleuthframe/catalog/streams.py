"""Streams over the tables, each checked against the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..config import DEFAULT
from ..functions import text as tx
from ..streaming import streams
from . import ORACLES, query
from .correlation import ARTIFACT
from . import text as _text   # its queries are twins of the streams here


def _events(spark, folder):
    return streams.read_table(spark, f"{folder}/events.parquet")


def _as_artifacts(e):
    i = lambda c: F.col(c).cast("string")
    return e.select(F.concat(F.lit("ev_"), i("event_id")).alias("id"), (F.col("user_id") % 10).alias("case_id"),
                    F.concat(F.lit("user"), i("user_id")).alias("entity_value"), F.col("ts").alias("timestamp"), "value")


@query("stream_dedup", """
SELECT min(doc_id) AS evidence_id, doc_id % 20 AS case_id, sha256(text) AS sha256 FROM documents GROUP BY 2, 3
""")
def stream_dedup(spark, folder):
    d = streams.read_table(spark, f"{folder}/documents.parquet")
    arrivals = d.select(F.col("doc_id").alias("evidence_id"), (F.col("doc_id") % 20).alias("case_id"), "text")
    return streams.run_ingest(arrivals, streams.work_path(spark, "ingest"), F.col("text")).select("evidence_id", "case_id", "sha256")


@query("stream_extract", ORACLES["iocs"])
def stream_extract(spark, folder):
    d = streams.read_table(spark, f"{folder}/documents.parquet", max_files=1000)
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    body = tx.searchable_text(name, F.lit("text/plain"), F.lit("txt"), F.col("text"))
    rows = d.select("doc_id", F.inline(tx.indicators(body, F.sha2(F.col("text").cast("binary"), 256))))
    return streams.run_append(rows, streams.work_path(spark, "extract"))


def _feed(spark, folder):
    status = (F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("PROCESSING"))
    return _events(spark, folder).select("user_id", F.col("ts").alias("at"), "event_id", status.alias("status"), F.col("event_type").alias("stage"))


def _latest(spark, folder):
    latest = streams.latest_status(_feed(spark, folder), ["user_id"], "at", ["event_id", "status", "stage"])
    return streams.run_update(latest, ["user_id"], streams.work_path(spark, "latest"))


LATEST = """
latest AS (SELECT user_id, max(struct_pack(t := epoch_us(ts), i := event_id, e := event_type)) AS l FROM events GROUP BY 1),
st AS (SELECT user_id, l.t AS t, l.i AS event_id, l.e AS stage,
  CASE l.e WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'PROCESSING' END AS status FROM latest)
"""


@query("stream_latest", f"WITH {LATEST} SELECT user_id, event_id, t, status FROM st")
def stream_latest(spark, folder):
    """events as a status feed of one job per user."""
    return _latest(spark, folder).select("user_id", "event_id", F.unix_micros("at").alias("t"), "status")


@query("stream_stuck", f"""
WITH {LATEST}
SELECT user_id, 'FAILED' AS status, 'Job timed out while processing at stage ''' || stage || '''.' AS stage_message FROM st
WHERE status = 'PROCESSING' AND t < epoch_us(TIMESTAMP '2024-01-30 12:00:00') - 1800000000
""")
def stream_stuck(spark, folder):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return streams.stuck(_latest(spark, folder), now).select("user_id", "status", "stage_message")


@query("stream_stuck_timer", f"""
WITH {LATEST}
SELECT user_id, t, 'FAILED' AS status, 'Job timed out while processing at stage ''' || stage || '''.' AS stage_message,
  '{{"error":"no progress before the time limit","stage_at_timeout":"' || stage || '","cleanup_action":"auto_reset_to_failed"}}' AS error_info,
  'STUCK_JOB_CLEANUP' AS action, 'Job ' || user_id || ' failed: stuck at stage ''' || stage || '''.' AS description FROM st
WHERE status = 'PROCESSING' AND t // 1000 + 1800000 < (SELECT max(epoch_us(ts)) FROM events) // 1000 - 600000
""")
def stream_stuck_timer(spark, folder):
    """The feed watched by timers until its input is used up; each job failed with its audit row."""
    late = streams.stuck_by_timer(_feed(spark, folder), "user_id", "at", "event_id")
    found = streams.run_append(late, streams.work_path(spark, "timers"))
    return streams.failed(found).drop("stage").join(streams.cleanup_audit(found, "user_id"), "user_id")


@query("stream_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def stream_daily(spark, folder):
    return streams.run_update(streams.daily_counts(_events(spark, folder)), ["day"], streams.work_path(spark, "daily"))


@query("stream_pairs", f"""
WITH {ARTIFACT}
SELECT a.case_id, a.id AS a_id, b.id AS b_id FROM artifact a JOIN artifact b
  ON a.case_id = b.case_id AND a.entity_value = b.entity_value AND a.id <> b.id AND abs(a.t - b.t) < 3600000000
WHERE a.weight >= 100
""")
def stream_pairs(spark, folder):
    """Alerts are the events of value 100 and more."""
    alerts = _as_artifacts(_events(spark, folder).filter("value >= 100"))
    pairs = streams.alert_pairs(alerts, _as_artifacts(_events(spark, folder)), DEFAULT)
    out = pairs.select(F.col("a_case_id").alias("case_id"), "a_id", "b_id", "a_timestamp", "b_timestamp")
    return streams.run_append(out, streams.work_path(spark, "pairs")).select("case_id", "a_id", "b_id")


SESSIONS = """
g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS s FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, t, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g),
sessions AS (SELECT user_id, min(t) AS first_t, max(t) + 3600000000 AS end_t, count(*) AS n FROM n GROUP BY user_id, k)
"""


@query("session_users", f"WITH {SESSIONS} SELECT user_id, first_t, end_t, n FROM sessions")
def session_users(spark, folder):
    a = views.artifacts(spark, folder)
    rows = a.select(F.substring("entity_value", 5, 20).cast("long").alias("user_id"), "t")
    return streams.sessions_batch(rows, ["user_id"], "t", DEFAULT.window_micros)


@query("stream_sessions", f"""
WITH {SESSIONS} SELECT user_id, first_t, end_t, n FROM sessions
WHERE end_t <= (SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000 - 600000000
""")
def stream_sessions(spark, folder):
    """Sessions that are over when the input is used up (ten minutes of delay are waited for)."""
    out = streams.sessions(_events(spark, folder), "user_id", "ts")
    return streams.run_append(out, streams.work_path(spark, "sessions"))
