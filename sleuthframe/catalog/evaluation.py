"""Confusion matrix, ROC, extraction quality, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as agg, evaluate
from ..session import table
from . import query
from .text import sql_pattern

SCORED = """
scored AS (SELECT doc_id, lang, quality AS label, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))
"""
TRIPLE = """
round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 4) AS accuracy,
CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 4) ELSE 0 END AS "precision",
CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 4) ELSE 0 END AS recall
"""


def _scored(spark, folder):
    """labels with a score that has nothing to do with them (the length of the text, cut to 0..1)."""
    return (table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
            .select("doc_id", "lang", F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("score")))


@query("confusion", f"""
WITH {SCORED},
c AS (SELECT lang, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label <> 1 AND score < 0.5) AS tn,
  count(*) FILTER (label <> 1 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM scored GROUP BY 1),
m AS (SELECT *, {TRIPLE} FROM c)
SELECT lang, tp, tn, fp, fn, accuracy, "precision", recall,
  CASE WHEN "precision" + recall > 0 THEN round(2 * "precision" * recall / ("precision" + recall), 4) ELSE 0 END AS f1_score FROM m
""")
def confusion(spark, folder):
    return evaluate.confusion(_scored(spark, folder), "score", "label", 0.5, "lang")


POINTS = f"""
{SCORED},
steps AS (SELECT i AS step, i / 50.0::DOUBLE AS th FROM range(51) r(i)),
points AS (SELECT lang, step, count(*) FILTER (score >= th AND label <> 1) / (count(*) FILTER (label <> 1))::DOUBLE AS fpr,
  count(*) FILTER (score >= th AND label = 1) / (count(*) FILTER (label = 1))::DOUBLE AS tpr
  FROM scored, steps GROUP BY 1, 2 HAVING count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label <> 1) > 0)
"""


@query("auc_points", f"WITH {POINTS} SELECT lang, step, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM points")
def auc_points(spark, folder):
    return evaluate.roc_points(_scored(spark, folder), "score", "label", "lang").select(
        "lang", "step", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("roc_auc", f"""
WITH {POINTS},
a AS (SELECT lang, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS area FROM points WINDOW w AS (PARTITION BY lang ORDER BY fpr, step)),
s AS (SELECT lang, round(least(1, greatest(0, abs(sum(area)))), 4) AS roc_auc FROM a GROUP BY 1)
SELECT lang, coalesce(roc_auc, 0.5) AS roc_auc FROM (SELECT DISTINCT lang FROM scored) LEFT JOIN s USING (lang)
""")
def roc_auc(spark, folder):
    return evaluate.roc_auc(_scored(spark, folder), "score", "label", "lang")


@query("calibrated", """
SELECT doc_id, round(1.0 / (1.0 + exp(((n_chars % 1000) / 1000.0::DOUBLE - 0.5) * 6.0)), 9) AS probability FROM documents
""")
def calibrated(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.round(evaluate.calibrated((F.col("n_chars") % 1000) / 1000.0 - 0.5), 9).alias("probability"))


@query("percentile_cut", """
SELECT round(quantile_cont(value, 0.15), 9) AS cut, count(*) FILTER (value <= (SELECT quantile_cont(value, 0.15) FROM events)) AS n_below FROM events
""")
def percentile_cut(spark, folder):
    e = table(spark, folder, "events")
    cut = agg.exact_quantile(e, "value", 0.15)
    return e.agg(F.round(F.lit(cut), 9).alias("cut"), F.count_if(F.col("value") <= cut).alias("n_below"))


@query("nlp_quality", f"""
WITH s AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(text, {sql_pattern(tx.IP_V4)})) AS extracted,
   list_distinct(list_transform(regexp_extract_all(text, '\\d+\\.\\d+\\.\\d+'), lambda x: x)) AS expected FROM documents),
c AS (SELECT lang,
  len(list_filter(extracted, lambda v: len(list_filter(expected, lambda w: contains(v, w) OR contains(w, v))) > 0)) AS tp,
  len(list_filter(extracted, lambda v: len(list_filter(expected, lambda w: contains(v, w) OR contains(w, v))) = 0)) AS fp,
  len(list_filter(expected, lambda w: len(list_filter(extracted, lambda v: contains(v, w) OR contains(w, v))) = 0)) AS fn FROM s),
t AS (SELECT lang, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS n_samples FROM c GROUP BY 1),
u AS (SELECT *, greatest(0, n_samples * 5 - tp - fp - fn) AS tn FROM t),
m AS (SELECT *, {TRIPLE} FROM u)
SELECT lang, tp, fp, fn, tn, n_samples, accuracy, "precision", recall,
  CASE WHEN "precision" + recall > 0 THEN round(2 * "precision" * recall / ("precision" + recall), 4) ELSE 0 END AS f1_score,
  round(("precision" + recall) / 2, 4) AS balance FROM m
""")
def nlp_quality(spark, folder):
    """Extracted addresses against dotted numbers taken as the expected entities."""
    d = table(spark, folder, "documents")
    s = d.select("lang", tx.find_all(F.col("text"), tx.IP_V4).alias("extracted"),
                 F.regexp_extract_all("text", F.lit(r"\d+\.\d+\.\d+"), F.lit(0)).alias("expected"))
    return evaluate.extraction_quality(s, "extracted", "expected", "lang")
