"""Counts, dashboards, summaries, latest rows, digests and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import aggregates as agg, dedup, integrity
from ..session import table
from . import query

SEVERITY = "['critical', 'high', 'medium', 'low', 'info'][substr(o_orderpriority, 1, 1)::INT]"
EVIDENCE = """
evidence AS (SELECT doc_id AS evidence_id, doc_id % 20 AS case_id, source || '_' || doc_id || '.txt' AS filename,
  text, octet_length(encode(text)) AS file_size, lang, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents)
"""


@query("severity_counts", f"""
SELECT s.severity, coalesce(n, 0) AS n
FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity)
LEFT JOIN (SELECT {SEVERITY} AS severity, count(*) AS n FROM orders GROUP BY 1) USING (severity)
""")
def severity_counts(spark, folder):
    return agg.severity_counts(views.findings(spark, folder))


@query("sum_size", "SELECT coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS total, count(*) AS n FROM lineitem")
def sum_size(spark, folder):
    return table(spark, folder, "lineitem").agg(
        F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("total"), F.count("*").alias("n"))


@query("dashboard", f"""
WITH facts AS (
  SELECT doc_id % 20 AS case_id, 1 AS e, octet_length(encode(text)) AS b, 0 AS d, 0 AS c, 0 AS j FROM documents
  UNION ALL SELECT o_custkey % 20, 0, 0, 1, CASE WHEN {SEVERITY} = 'critical' THEN 1 ELSE 0 END, 0 FROM orders
  UNION ALL SELECT o_custkey % 20, 0, 0, 0, 0, 1 FROM orders)
SELECT case_id, sum(e)::BIGINT AS n_evidence, sum(b)::BIGINT AS evidence_bytes, sum(d)::BIGINT AS n_detections,
       sum(c)::BIGINT AS n_critical, sum(j)::BIGINT AS n_jobs
FROM facts GROUP BY ROLLUP (case_id)
""")
def dashboard(spark, folder):
    return agg.dashboard(views.evidence(spark, folder), views.findings(spark, folder), views.jobs(spark, folder))


@query("category_hist", """
SELECT CASE WHEN ext IN ('e01','dd','iso','raw','img','ova','001') THEN 'Disk Images'
            WHEN ext IN ('mem','vmem','dmp') THEN 'Memory Dumps'
            WHEN ext IN ('pdf','docx','txt','csv','xlsx','doc','rtf','msg') THEN 'Documents'
            WHEN ext IN ('pcap','pcapng','log','evtx','evt','json') THEN 'Logs & Network' ELSE 'Other' END AS category,
       count(*) AS n
FROM (SELECT ['txt', 'log', 'iso', 'vmem', 'mp4', 'pdf', 'json'][(doc_id % 7 + 1)::INT] AS ext FROM documents)
GROUP BY 1
""")
def category_hist(spark, folder):
    kinds = F.array(*[F.lit(e) for e in (".TXT", "log", "iso", "vmem", "mp4", "pdf", "json")])
    ev = views.evidence(spark, folder).withColumn(
        "extension", F.element_at(kinds, (F.col("evidence_id") % 7 + 1).cast("int")))
    return agg.category_histogram(ev)


@query("events_per_day", """
WITH last AS (SELECT max(ts::DATE) AS d FROM events),
days AS (SELECT (d - i::INT) AS day FROM last, range(7) r(i)),
n AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(day, '%a') AS label, coalesce(n, 0) AS n FROM days LEFT JOIN n USING (day)
""")
def events_per_day(spark, folder):
    return agg.events_per_day(table(spark, folder, "events")).withColumn("day", F.col("day").cast("string"))


@query("review_summary", """
WITH r AS (SELECT doc_id % 20 AS case_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS s FROM labels)
SELECT case_id, count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'approved') AS approved,
  count(*) FILTER (s = 'rejected') AS rejected, 0::BIGINT AS escalated, bool_and(s <> 'pending') AS all_reviewed,
  count(*) FILTER (s = 'approved') AS review_ready_for_report
FROM r GROUP BY 1
""")
def review_summary(spark, folder):
    return agg.review_summary(views.reviews(spark, folder), "case_id")


@query("stuck_jobs", """
SELECT o_orderpriority AS current_stage, count(*) AS n_stuck, epoch_us(min(o_orderdate)) AS oldest_stuck FROM orders
WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 30 MINUTE
GROUP BY ROLLUP (o_orderpriority)
""")
def stuck_jobs(spark, folder):
    now = F.lit("1999-01-01").cast("timestamp")
    out = agg.stuck_summary(agg.stuck_jobs(views.jobs(spark, folder), now))
    return out.withColumn("oldest_stuck", F.unix_micros("oldest_stuck"))


@query("stuck_cleanup", """
SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'QUEUED'
  WHEN o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 30 MINUTE THEN 'FAILED' ELSE 'PROCESSING' END AS status,
  CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 30 MINUTE
       THEN 'Job timed out while processing at stage ''' || o_orderpriority || '''.' END AS stage_message
FROM orders
""")
def stuck_cleanup(spark, folder):
    out = agg.fail_stuck(views.jobs(spark, folder), F.lit("1999-01-01").cast("timestamp"))
    return out.select("job_id", "status", "stage_message")


@query("distinct_types", """
SELECT DISTINCT 'event_type' AS "column", event_type AS value FROM events
UNION SELECT DISTINCT 'source', 'sensor' || (event_id % 5) FROM events
""")
def distinct_types(spark, folder):
    return agg.distinct_values(views.artifacts(spark, folder), "event_type", "source")


@query("stage_counters", """
SELECT count(DISTINCT l_orderkey % 20) AS n_cases, count(*) AS n_artifacts,
       count(*) FILTER (list_contains([22, 3389, 4444, 1337, 31337],
         [80, 443, 53, 22, 3389, 4444, 8080, 1337, 31337, 25][(l_partkey % 10 + 1)::INT]) OR l_linestatus = 'F') AS n_suspicious
FROM lineitem
""")
def stage_counters(spark, folder):
    from ..operators import rules
    f = views.flows(spark, folder)
    return f.agg(F.countDistinct("case_id").alias("n_cases"), F.count("*").alias("n_artifacts"),
                 F.count_if(rules.suspicious_network()).alias("n_suspicious"))


@query("latest_job", f"""
SELECT o_custkey AS evidence_id, max(struct_pack(t := epoch_us(o_orderdate), k := o_orderkey)).k AS job_id
FROM orders GROUP BY 1
""")
def latest_job(spark, folder):
    j = views.jobs(spark, folder)
    return agg.latest(j, ["evidence_id"], ["started_at", "job_id"], ["job_id"])


@query("digests", "SELECT doc_id AS evidence_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def digests(spark, folder):
    return dedup.with_digests(views.evidence(spark, folder), F.col("text")).select("evidence_id", "md5", "sha1", "sha256")


@query("digests_long", """
SELECT doc_id AS evidence_id, 'MD5' AS algorithm, md5(text) AS digest FROM documents
UNION ALL SELECT doc_id, 'SHA1', sha1(text) FROM documents
UNION ALL SELECT doc_id, 'SHA256', sha256(text) FROM documents
""")
def digests_long(spark, folder):
    return dedup.digests_long(dedup.with_digests(views.evidence(spark, folder), F.col("text")))


@query("dups", """
SELECT doc_id AS evidence_id, first_id, first_id <> doc_id AS is_duplicate FROM (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY doc_id % 20, sha256(text) ORDER BY doc_id) AS first_id FROM documents)
""")
def dups(spark, folder):
    ev = dedup.with_digests(views.evidence(spark, folder), F.col("text"))
    return dedup.flag_duplicates(ev, ["case_id", "sha256"], "evidence_id").select("evidence_id", "first_id", "is_duplicate")


@query("dups_history", """
SELECT doc_id AS evidence_id FROM documents WHERE lang <> 'en'
 AND (doc_id % 20, sha256(text)) NOT IN (SELECT doc_id % 20, sha256(text) FROM documents WHERE lang = 'en')
""")
def dups_history(spark, folder):
    """Arrivals (all but English) that no earlier file of their case equals."""
    ev = dedup.with_digests(views.evidence(spark, folder), F.col("text"))
    return dedup.not_seen(ev.filter("lang <> 'en'"), ev.filter("lang = 'en'")).select("evidence_id")


INTEGRITY = f"""
WITH {EVIDENCE},
present AS (SELECT evidence_id, sha256(CASE WHEN lang = 'fr' THEN text || ' ' ELSE text END) AS actual FROM evidence WHERE lang <> 'es'),
checked AS (SELECT e.case_id, e.evidence_id, e.filename, p.actual AS actual_sha256,
  CASE WHEN p.actual IS NULL THEN 'MISSING' WHEN p.actual = e.sha256 THEN 'VERIFIED' ELSE 'TAMPERED' END AS status
  FROM evidence e LEFT JOIN present p USING (evidence_id))
"""


def _checked(spark, folder):
    """The stored digests against what is there: Spanish files are gone, French ones changed."""
    ev = views.evidence(spark, folder)
    manifest = dedup.with_digests(ev, F.col("text")).select("case_id", "evidence_id", "filename", "sha256")
    present = ev.filter("lang <> 'es'").select(
        "evidence_id", F.when(F.col("lang") == "fr", F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("content"))
    return integrity.verify(manifest, present)


@query("integrity_status", INTEGRITY + "SELECT evidence_id, status, actual_sha256 FROM checked")
def integrity_status(spark, folder):
    return _checked(spark, folder).select("evidence_id", "status", "actual_sha256")


@query("integrity_report", INTEGRITY + """
SELECT case_id, count(*) AS total_checked, count(*) FILTER (status = 'VERIFIED') AS verified,
  count(*) FILTER (status <> 'VERIFIED') AS failed, count(*) FILTER (status <> 'VERIFIED') = 0 AS all_passed,
  count(*) FILTER (status = 'TAMPERED') AS tampered, count(*) FILTER (status = 'MISSING') AS missing
FROM checked GROUP BY 1
""")
def integrity_report(spark, folder):
    return integrity.report(_checked(spark, folder))
