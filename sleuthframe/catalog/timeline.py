"""Timelines in UTC and in a zone, last correlations, timestamp notations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import similarity, timeparse
from ..operators import correlate, scan, timeline as tl
from ..session import table
from . import query
from .correlation import ARTIFACT, IN_CASE, SCORE, SIMILARITY
from .graph_rank import FINDING


EXTRACTED_KINDS = ("username", "session_id", "command", "email")
HOST = "^[a-z]+://([^/?#:]+)"


def _parts(spark, folder):
    """All nine sources: events as log records and as extracted artifacts, orders as findings, lineitem as sessions,
    pages as visits, documents as ingested files of every kind."""
    i = lambda c: F.col(c).cast("string")
    e = table(spark, folder, "events", spread=True)
    records = e.select(
        (F.col("user_id") % 10).alias("case_id"), F.col("user_id").alias("evidence_id"),
        F.concat(F.lit("log"), i("user_id"), F.lit(".evtx")).alias("filename"), F.col("event_id").alias("idx"),
        F.element_at(F.array(*[F.lit(x) for x in (4624, 4625, 4688, 7036)]), (F.col("event_id") % 4 + 1).cast("int")).alias("event_id"),
        F.col("event_type").alias("provider"),
        F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("timestamp"),
        F.create_map(F.lit("props"), F.col("props")).alias("data"))
    kinds = F.array(*[F.lit(x) for x in EXTRACTED_KINDS])
    x = e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("case_id"), F.col("user_id").alias("evidence_id"), F.lit(None).cast("string").alias("filename"),
        F.get(kinds, (F.col("event_id") % len(EXTRACTED_KINDS)).cast("int")).alias("artifact_type"), F.concat(F.lit("user"), i("user_id"), F.lit(" "), F.col("props")).alias("value"),
        F.lit(0.9).alias("confidence"), F.lit("regex").alias("extractor"), F.col("ts").alias("extracted_at"))
    b = table(spark, folder, "pages", spread=True).select(
        F.col("page_id").alias("id"), (F.col("page_id") % 20).alias("case_id"), F.col("page_id").alias("evidence_id"), F.lit("chromium").alias("browser"),
        F.lit("page_visit").alias("artifact_type"), F.col("url"), F.regexp_extract("url", HOST, 1).alias("domain"), F.lit(None).cast("string").alias("title"),
        F.concat(F.lit("2023-08-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:30:00+02:00")).alias("timestamp"))
    f = views.findings(spark, folder).withColumn("filename", F.lit(None).cast("string"))
    n = views.flows(spark, folder, spread=True).withColumns({
        "id": F.col("order_key") * 10 + F.col("line_no"), "evidence_id": F.col("order_key"),
        "timestamp": F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss")})
    d = views.evidence(spark, folder)
    k = F.col("evidence_id") % 4
    day = F.lpad((F.col("evidence_id") % 28 + 1).cast("string"), 2, "0")
    d = d.withColumns({
        "kind": F.when(k == 0, "image").when(k == 1, "pdf").when(k == 2, "docx").otherwise("text"),
        "timestamp": F.concat(F.lit("2023:05:"), day, F.lit(" 08:15:00")), "camera_make": F.lit("ACME"), "camera_model": F.col("lang"),
        "creation_date": F.concat(F.lit("D:202306"), day, F.lit("101500+05'30'")), "author": F.col("source"), "title": F.lit(None).cast("string"),
        "created": F.concat(F.lit("2023-07-"), day, F.lit(" 09:00:00+00:00")), "sha256": F.sha2("text", 256),
        "ingested_at": (F.col("evidence_id") * 60 + 1_700_000_000).cast("string")})
    return [tl.ingests(d), tl.captures(d), tl.documents(d, "pdf"), tl.documents(d, "docx"), tl.log_records(records),
            tl.extracted(x), tl.browsing(b), tl.sessions(n), tl.alerts(f)]


TIMELINE = f"""
{FINDING},
raw AS (
  SELECT doc_id % 20 AS case_id, 'ev_ingest_' || doc_id AS event_id, 'Evidence file ingested: ' || source || '_' || doc_id || '.txt' AS event,
    epoch_us(to_timestamp(1700000000 + doc_id * 60)) AS t, 'info' AS priority, false AS is_suspicious, '+00:00' AS original_timezone FROM documents
  UNION ALL SELECT doc_id % 20, 'ev_exif_' || doc_id, 'Image captured (EXIF DateTimeOriginal)',
    epoch_us(TIMESTAMP '2023-05-01 08:15:00' + INTERVAL 1 DAY * (doc_id % 28)), 'low', false, '+00:00' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id % 20, 'ev_pdf_' || doc_id, 'PDF document created (Author: ' || source || ')',
    epoch_us(TIMESTAMP '2023-06-01 04:45:00' + INTERVAL 1 DAY * (doc_id % 28)), 'low', false, '+05:30' FROM documents WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id % 20, 'ev_docx_' || doc_id, 'DOCX document created',
    epoch_us(TIMESTAMP '2023-07-01 09:00:00' + INTERVAL 1 DAY * (doc_id % 28)), 'low', false, '+00:00' FROM documents WHERE doc_id % 4 = 2
  UNION ALL SELECT user_id % 10, 'evtx_' || user_id || '_' || c || '_' || event_id, 'Windows Log Event ID ' || c || ' (' || event_type || ')',
    CASE WHEN event_type <> 'error' THEN epoch_us(date_trunc('second', ts)) END,
    CASE c WHEN 4625 THEN 'critical' WHEN 4688 THEN 'high' ELSE 'info' END, c IN (4625, 4688), '+00:00'
    FROM (SELECT *, [4624, 4625, 4688, 7036][(event_id % 4 + 1)::INT] AS c FROM events)
  UNION ALL SELECT user_id % 10, 'extracted_art_' || event_id, 'Extracted ' || upper(kind) || ': ' || substr('user' || user_id || ' ' || props, 1, 35),
    epoch_us(ts), CASE WHEN kind IN ('session_id', 'command') THEN 'high' ELSE 'medium' END, kind IN ('session_id', 'command'), '+00:00'
    FROM (SELECT *, ['username', 'session_id', 'command', 'email'][(event_id % 4 + 1)::INT] AS kind FROM events)
  UNION ALL SELECT page_id % 20, 'browser_art_' || page_id, 'Browser Page Visit: ' || coalesce(nullif(regexp_extract(url, '{HOST}', 1), ''), nullif(url, ''), 'Record'),
    epoch_us(TIMESTAMP '2023-08-01 08:30:00' + INTERVAL 1 DAY * (page_id % 28)), 'medium', false, '+02:00' FROM pages
  UNION ALL SELECT l_orderkey % 20, 'net_art_' || (l_orderkey * 10 + l_linenumber),
    'Network Session (' || CASE l_returnflag WHEN 'A' THEN 'TCP' WHEN 'N' THEN 'UDP' ELSE 'ICMP' END || '): 172.' || ((l_partkey >> 16) % 256) || '.' || ((l_partkey >> 8) % 256) || '.' || (l_partkey % 256),
    epoch_us(l_shipdate), 'medium', false, '+00:00' FROM lineitem
  UNION ALL SELECT case_id, 'finding_evt_' || id, 'AI Threat Alert: ' || title, epoch_us(o_orderdate), severity, true, '+00:00'
    FROM f JOIN orders ON o_orderkey = id)
"""


@query("timeline_utc", f"""
WITH {TIMELINE}
SELECT case_id, event_id, event, t, priority, is_suspicious, original_timezone,
  CASE WHEN t IS NULL THEN 'No Timestamp / Missing' ELSE strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S') || ' UTC (+00:00)' END AS display_timestamp,
  CASE WHEN t IS NULL THEN 'MISSING' ELSE 'UTC (+00:00)' END AS timezone_badge
FROM raw
""")
def timeline_utc(spark, folder):
    t = tl.build(_parts(spark, folder), ordered=True)
    return t.select("case_id", "event_id", "event", F.unix_micros("timestamp").alias("t"), "priority", "is_suspicious",
                    "original_timezone", "display_timestamp", "timezone_badge")


@query("timeline_zone", f"""
WITH {TIMELINE},
y AS (SELECT *, year(make_timestamp(t)) AS y FROM raw),
rule AS (SELECT y, CASE WHEN y >= 2007 THEN make_date(y, 3, 8) + CAST((7 - dayofweek(make_date(y, 3, 8))) % 7 AS INTEGER)
                        ELSE make_date(y, 4, 1) + CAST((7 - dayofweek(make_date(y, 4, 1))) % 7 AS INTEGER) END + INTERVAL 7 HOUR AS begins,
                CASE WHEN y >= 2007 THEN make_date(y, 11, 1) + CAST((7 - dayofweek(make_date(y, 11, 1))) % 7 AS INTEGER)
                     ELSE make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INTEGER) END + INTERVAL 6 HOUR AS ends
  FROM (SELECT DISTINCT y::INTEGER AS y FROM y WHERE y >= 1987)),
z AS (SELECT y.*, CASE WHEN make_timestamp(t) >= begins AND make_timestamp(t) < ends THEN 4 WHEN begins IS NOT NULL THEN 5 END AS h FROM y LEFT JOIN rule USING (y))
SELECT case_id, event_id, coalesce(strftime(make_timestamp(t) - INTERVAL 1 HOUR * h, '%Y-%m-%d %H:%M:%S') || CASE h WHEN 4 THEN ' EDT (-04:00)' ELSE ' EST (-05:00)' END,
  'No Timestamp / Missing') AS display_timestamp
FROM z
""")
def timeline_zone(spark, folder):
    """All events as New York sees them, by the rules for clocks of their years."""
    return tl.build(_parts(spark, folder), "America/New_York").select("case_id", "event_id", "display_timestamp")


@query("timeline_totals", f"""
WITH {TIMELINE} SELECT case_id, count(*) AS total_events, count(*) FILTER (is_suspicious) AS suspicious_count FROM raw GROUP BY 1
""")
def timeline_totals(spark, folder):
    return tl.totals(tl.build(_parts(spark, folder)), "case_id")


@query("timeline_last_corr", f"""
WITH {ARTIFACT},
scored AS (SELECT a, b, apart, {SCORE} AS score FROM (
  SELECT a.id AS a, b.id AS b, abs(a.t - b.t) AS apart, {SIMILARITY}
  FROM artifact a JOIN artifact b ON a.case_id = b.case_id AND a.id <> b.id
   AND (a.entity_value = b.entity_value OR abs(a.t - b.t) < 3600000000))),
best AS (SELECT a, max(score) AS score FROM scored WHERE score >= 0.15 GROUP BY 1)
SELECT id AS artifact_id, score AS correlation_score,
  CASE WHEN score >= 0.70 THEN 'Strong' WHEN score >= 0.40 THEN 'Moderate' WHEN score IS NOT NULL THEN 'Weak' END AS correlation_category
FROM artifact LEFT JOIN best ON a = id
""")
def timeline_last_corr(spark, folder):
    """Every event as an extracted artifact of the timeline, with its strongest correlation."""
    a = views.artifacts(spark, folder)
    # the category follows from the score, so that records of one score need no order
    last = correlate.last_correlation(correlate.best_partner(a, IN_CASE), F.col("score"), ("score", "strength_category"))
    return (a.select(F.col("id").alias("artifact_id")).join(last, "artifact_id", "left")
            .select("artifact_id", F.col("score").alias("correlation_score"), F.col("strength_category").alias("correlation_category")))


FORMS = 11


@query("time_formats", f"""
WITH e AS (SELECT event_id, event_id % {FORMS} AS form, epoch_us(ts) AS us, epoch_us(date_trunc('second', ts)) AS s FROM events)
SELECT event_id, CASE WHEN form IN (0, 5) THEN us WHEN form = 1 THEN (us + 11644473600000000)::DOUBLE::BIGINT - 11644473600000000 WHEN form = 2 THEN us - us % 1000 WHEN form = 10 THEN NULL
    WHEN form = 4 THEN s WHEN form = 7 THEN s WHEN form = 9 THEN s - 19800000000 ELSE s END AS t,
  CASE WHEN form = 10 THEN NULL WHEN form = 4 THEN '+05:30' WHEN form = 9 THEN '+05:30' WHEN form IN (0, 1, 2, 3, 5) THEN '+00:00' ELSE '+00:00' END AS zone
FROM e
""")
def time_formats(spark, folder):
    """The time of each event written in one of eleven notations and read back."""
    e = table(spark, folder, "events", spread=True)
    us, s = F.unix_micros("ts"), F.unix_seconds("ts")
    write = lambda pattern: F.date_format("ts", pattern)
    forms = [
        us.cast("string"), (us + 11_644_473_600_000_000).cast("string"), F.floor(us / 1000).cast("string"), s.cast("string"),
        F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "'D:'yyyyMMddHHmmss'+05''30'''"),
        write("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), write("yyyy:MM:dd HH:mm:ss"), write("MMM  d HH:mm:ss"),
        write("yyyy/MM/dd HH:mm:ss"), write("yyyyMMdd'T'HHmmss") , F.concat(F.lit("at "), write("HH:mm"))]
    form = F.col("event_id") % FORMS
    raw = F.element_at(F.array(*forms), (form + 1).cast("int"))
    # notation 9 carries no zone and is read as Indian time; all others as UTC
    n = e.select("event_id", form.alias("form"), raw.alias("raw"))
    read = timeparse.with_utc(n.filter("form <> 9"), "raw", "UTC", default_year=2024).unionByName(
        timeparse.with_utc(n.filter("form = 9"), "raw", "IST"))
    return read.select("event_id", F.unix_micros("utc").alias("t"), F.col("original_timezone").alias("zone"))


@query("sql_functions", f"""
WITH {ARTIFACT},
points AS (SELECT case_id, entity_value, t, arg_max(source, seq) AS source, arg_max(event_type, seq) AS event_type FROM artifact GROUP BY 1, 2, 3),
before AS (SELECT case_id, entity_value, t AS here, lag(t) OVER w AS t, lag(source) OVER w AS source, lag(event_type) OVER w AS event_type
  FROM points WINDOW w AS (PARTITION BY case_id, entity_value ORDER BY t)),
p AS (SELECT a.id, {SIMILARITY} FROM artifact a JOIN before b ON a.case_id = b.case_id AND a.entity_value = b.entity_value AND a.t = b.here
  WHERE b.t IS NOT NULL)
SELECT id, s_time, s_entity, s_source, s_event, {SCORE} AS score FROM p
""")
def sql_functions(spark, folder):
    """The similarities and the score by their SQL names, between each sighting of an entity and the last row of the instant before."""
    similarity.register_sql_functions(spark)
    a, keys = views.artifacts(spark, folder), ["case_id", "entity_value"]
    points = a.groupBy(*keys, "t").agg(F.max(F.struct("t", "seq", "entity_value", "source", "event_type")).alias("last"))
    before = scan.ordered_scan(points, keys, "t", {"b": ("max", F.col("last"))}, "before").where("b IS NOT NULL")
    each = a.join(before.select(*keys, "t", "b"), [*keys, "t"]).selectExpr(
        "id", "time_similarity(t, b.t) AS s_time", "entity_similarity(entity_value, b.entity_value) AS s_entity",
        "source_similarity(source, b.source) AS s_source", "event_similarity(event_type, b.event_type) AS s_event")
    return each.selectExpr("*", "correlation_score(s_time, s_entity, s_source, s_event) AS score")
