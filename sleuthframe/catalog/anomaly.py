"""Row texts, terms, TF-IDF, isolation forest, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly
from ..session import table
from . import query

CODES = {"click": 4624, "view": 7036, "purchase": 4688, "error": 4625, "signup": 6416}


def records(spark, folder):
    """events as Windows log records."""
    e = table(spark, folder, "events", spread=True)
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[F.col("event_type")]
    s = lambda c: F.col(c).cast("string")
    data = F.create_map(
        F.lit("TargetUserName"), F.concat(F.lit("user"), s("user_id")),
        F.lit("Workstation"), F.concat(F.lit("WORK-"), F.lpad((F.col("user_id") % 40).cast("string"), 3, "0")),
        F.lit("LogonType"), F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("record"), code.alias("event_id"), F.lit("Security").alias("provider"), "ts", data.alias("data"))


TEXT = """
texts AS (SELECT event_id AS record, 'EventID ' || CASE event_type WHEN 'click' THEN 4624 WHEN 'view' THEN 7036 WHEN 'purchase' THEN 4688
    WHEN 'error' THEN 4625 ELSE 6416 END || ' Provider Security Data TargetUserName:user' || user_id || ' Workstation:WORK-' ||
    lpad((user_id % 40)::VARCHAR, 3, '0') || ' LogonType:' || (props->>'$.k') AS text FROM events)
"""
TERMS = f"""
{TEXT},
corpus AS (SELECT record, text FROM texts UNION ALL SELECT -1 - i, line FROM (SELECT unnest(range({len(anomaly.NORMAL_LINES)})) AS i,
  unnest([{", ".join("'" + t + "'" for t in anomaly.NORMAL_LINES)}]) AS line)),
words AS (SELECT record, unnest(regexp_extract_all(lower(text), '\\b\\w\\w+\\b')) AS term FROM corpus),
kept AS (SELECT record, term, count(*) AS tf FROM words WHERE term NOT IN ('by', 'for', 'from', 'system') GROUP BY 1, 2),
terms AS (SELECT term, sum(tf)::BIGINT AS n_total, count(*) AS n_rows FROM kept GROUP BY 1 ORDER BY n_total DESC, term LIMIT 100),
vocab AS (SELECT *, ln((1 + (SELECT count(*) FROM corpus)) / (1 + n_rows)::DOUBLE) + 1 AS idf FROM terms)
"""


@query("row_text", f"WITH {TEXT} SELECT record, text FROM texts")
def row_text(spark, folder):
    return records(spark, folder).select("record", anomaly.row_text(F.col("event_id"), F.col("provider"), F.col("data")).alias("text"))


def _texts(spark, folder):
    return row_text(spark, folder)


@query("term_frequency", f"WITH {TERMS} SELECT term, n_total, n_rows, round(idf, 9) AS idf FROM vocab")
def term_frequency(spark, folder):
    v = anomaly.vocabulary(_texts(spark, folder), "text", anomaly.stop_words(spark))
    return v.withColumn("idf", F.round("idf", 9))


@query("tfidf", f"""
WITH {TERMS},
w AS (SELECT record, term, tf * idf AS w FROM kept JOIN vocab USING (term) WHERE record >= 0),
n AS (SELECT record, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
SELECT record, term, round(w / n, 6) AS weight FROM w JOIN n USING (record)
""")
def tfidf(spark, folder):
    texts, stops = _texts(spark, folder), anomaly.stop_words(spark)
    vocab = anomaly.fit_vocabulary(texts, "text", stops)
    names = F.array(*[F.lit(t) for t in vocab.terms])
    x = texts.select("record", F.explode(anomaly.features(F.col("text"), vocab, stops)).alias("e"))
    return x.select("record", F.get(names, F.col("e.i")).alias("term"), F.round("e.w", 6).alias("weight"))


@query("token_reasons", f"""
WITH {TERMS},
fields AS (SELECT event_id AS record, CASE event_type WHEN 'click' THEN 4624 WHEN 'view' THEN 7036 WHEN 'purchase' THEN 4688
  WHEN 'error' THEN 4625 ELSE 6416 END AS code, 'user' || user_id AS account, 'WORK-' || lpad((user_id % 40)::VARCHAR, 3, '0') AS station FROM events)
SELECT record, term, CASE
  WHEN term LIKE '%ip%' OR term LIKE '%workstation%' THEN 'rare source IP / endpoint (' || station || ')'
  WHEN term LIKE '%4625%' OR code = 4625 THEN 'repeated authentication failure (Event ID 4625)'
  WHEN term LIKE '%4688%' OR term = '1' OR code IN (4688, 1) THEN 'unusual process execution (unusual binary)'
  WHEN term LIKE '%6416%' OR code = 6416 THEN 'unusual USB hardware insertion (Event ID 6416)'
  WHEN term LIKE '%user%' OR term LIKE '%admin%' THEN 'unusual account access (' || account || ')'
  WHEN term LIKE '%time%' OR term LIKE '%logon%' THEN 'unusual login time or logon type'
  ELSE 'anomalous event characteristic (' || term || ')' END AS reason
FROM (SELECT DISTINCT record, term FROM kept WHERE record >= 0) JOIN fields USING (record)
""")
def token_reasons(spark, folder):
    """Every term of every record with the reason it would be given."""
    r = records(spark, folder)
    words = anomaly.tokens(anomaly.row_text(F.col("event_id"), F.col("provider"), F.col("data")), anomaly.stop_words(spark))
    each = r.select("record", "event_id", "data", F.explode(F.array_distinct(words)).alias("term"))
    return each.select("record", "term", anomaly.token_reason(F.col("term"), F.col("data"), F.col("event_id")).alias("reason"))


@query("finding_fields", """
WITH r AS (SELECT event_id AS record, CASE event_type WHEN 'click' THEN 4624 WHEN 'view' THEN 7036 WHEN 'purchase' THEN 4688
  WHEN 'error' THEN 4625 ELSE 6416 END AS code, value / 200::DOUBLE AS confidence FROM events WHERE value >= 100)
SELECT record, 'Anomaly Event ID ' || code || ': Security' AS title, CASE WHEN confidence >= 0.8 THEN 'high' ELSE 'medium' END AS severity,
  floor(confidence * 100)::BIGINT AS risk_score, CASE
  WHEN code = 4625 THEN 'Investigate workstation brute force patterns and check for Active Directory lockouts.'
  WHEN code IN (4688, 1) THEN 'Analyze execution binary hashes against VirusTotal and check parent process chains.'
  WHEN code = 6416 THEN 'Review physical security logs and audit active USB registry entries.'
  ELSE 'Validate host network traffic logs and execute memory forensics.' END AS recommendation FROM r
""")
def finding_fields(spark, folder):
    """Title, severity, risk and advice of findings; events of value 100 and more stand for outliers, their value for the confidence."""
    value = table(spark, folder, "events").select(F.col("event_id").alias("record"), "value")
    scored = records(spark, folder).join(value, "record").withColumns(
        {"is_outlier": F.col("value") >= 100, "confidence": F.col("value") / F.lit(200.0)})
    return anomaly.findings(scored).select("record", "title", "severity", "risk_score", "recommendation")


@query("iforest_rank")
def iforest_rank(spark, folder):
    """Every record with its decision value and confidence; tests check the ranking and the share flagged."""
    r = records(spark, folder)
    model = anomaly.fit_detector(r, "record")
    return anomaly.score_records(r, model).select("record", "event_id", F.round("decision", 6).alias("decision"), "is_outlier",
                                                  F.round("confidence", 6).alias("confidence"))


@query("ablation")
def ablation(spark, folder):
    """Findings of the flagged records, with the terms behind them."""
    r = records(spark, folder)
    model = anomaly.fit_detector(r, "record")
    flagged = anomaly.findings(anomaly.score_records(r, model))
    explained = anomaly.explain(flagged, "record", model)
    return anomaly.summaries(explained, flagged, "record").select("record", "title", "severity", "risk_score", "reason")
