"""Filters, searches, ordering, paging, simple joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import views
from ..operators import aggregates as agg, filters as flt
from ..session import table
from . import query


def _extracted(spark, folder):
    """events as extracted artifacts: the value of a field, its confidence and its JSON details."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("artifact_type"), F.col("user_id").alias("evidence_id"),
        F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("value"),
        F.round(F.least(F.lit(1.0), F.col("value") / 100.0), 4).alias("confidence"),
        F.when(F.col("value") > 50, "rule-based").otherwise("regex-fallback").alias("extractor"),
        F.concat(F.lit('{"is_suspicious": "'), (F.col("event_type") == "error").cast("string"), F.lit('"}')).alias("details"),
        F.col("ts").alias("extracted_at"))


@query("artifact_filter", """
WITH x AS (SELECT event_id AS id, event_type AS artifact_type, 'User' || user_id AS value,
  least(1.0, value / 100.0) AS confidence, ts, value AS v FROM events)
SELECT id, artifact_type, value FROM x
WHERE artifact_type = 'error' AND lower(value) LIKE '%user1%' AND v <= 50 AND confidence >= 0.05 AND confidence <= 0.45
  AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'
""")
def artifact_filter(spark, folder):
    out = flt.filter_artifacts(
        _extracted(spark, folder), artifact_type="error", value_contains="USER1", extractor="regex-fallback",
        min_confidence=0.05, max_confidence=0.45, is_suspicious=True, date_from="2024-01-05", date_to="2024-01-25")
    return out.select("id", "artifact_type", "value")


@query("search_literal", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE contains(lower(c_name), 'r#0000001') OR contains(lower(c_mktsegment), 'r#0000001')
""")
def search_literal(spark, folder):
    return (table(spark, folder, "customer").filter(flt.matches("R#0000001", "c_name", "c_mktsegment"))
            .select("c_custkey", "c_name", "c_mktsegment"))


@query("search_escaped", """
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'd_w') OR contains(lower(p_brand), '#2')
""")
def search_escaped(spark, folder):
    """The underscore is a character, not a wildcard."""
    p = table(spark, folder, "part")
    return p.filter(flt.matches("d_w", "p_name") | flt.matches("#2", "p_brand")).select("p_partkey", "p_name")


@query("membership", """
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P'
""")
def membership(spark, folder):
    o = table(spark, folder, "orders")
    return (flt.in_case(o, "P", "o_orderstatus").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .select("o_orderkey", "o_orderpriority"))


@query("json_path_filter", "SELECT event_id, event_type FROM events WHERE props->>'$.k' = '42'")
def json_path_filter(spark, folder):
    return table(spark, folder, "events").filter(flt.json_equals("props", "$.k", "42")).select("event_id", "event_type")


@query("pending_queue", """
SELECT doc_id AS finding_id, doc_id % 20 AS case_id FROM labels WHERE toxic <> 1 AND quality <> 1
""")
def pending_queue(spark, folder):
    r = views.reviews(spark, folder)
    return r.filter(F.col("review_status") == "pending").orderBy("finding_id").select("finding_id", "case_id")


@query("owner_scope", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def owner_scope(spark, folder):
    return flt.owned_by(table(spark, folder, "customer"), 7, "c_nationkey").select("c_custkey", "c_name")


@query("grid_filter", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE (contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')) AND contains(c_custkey::VARCHAR, '7')
""")
def grid_filter(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return flt.grid_filter(c, "BUILD", c_custkey="7")


@query("page_desc", """
SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100
""")
def page_desc(spark, folder):
    o = table(spark, folder, "orders")
    out = flt.page(o, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], number=3, size=50)
    return out.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("page_keyset", """
SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders
WHERE o_orderdate < TIMESTAMP '1997-06-01' OR (o_orderdate = TIMESTAMP '1997-06-01' AND o_orderkey < 500)
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50
""")
def page_keyset(spark, folder):
    o = table(spark, folder, "orders")
    out = flt.next_page(o, "o_orderdate", "o_orderkey", after=(datetime(1997, 6, 1), 500))
    return out.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("page_totals", "SELECT count(*) AS total, greatest(1, ceil(count(*) / 50.0))::BIGINT AS total_pages FROM orders")
def page_totals(spark, folder):
    return flt.page_totals(table(spark, folder, "orders"), 50)


@query("topk_findings", """
SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT % 101 AS risk_score FROM orders ORDER BY 2 DESC, 1 LIMIT 5
""")
def topk_findings(spark, folder):
    f = views.findings(spark, folder)
    return f.orderBy(F.col("risk_score").desc(), "id").limit(5).select("id", "risk_score")


@query("severity_sort", """
SELECT id, severity FROM (
  SELECT o_orderkey AS id, ['critical', 'high', 'medium', 'low', 'info'][substr(o_orderpriority, 1, 1)::INT] AS severity,
         substr(o_orderpriority, 1, 1)::INT AS w FROM orders)
""")
def severity_sort(spark, folder):
    return flt.grid_sort(views.findings(spark, folder).select("id", "severity"), "severity", ascending=False)


@query("nulls_last", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(ts) END AS t FROM events
""")
def nulls_last(spark, folder):
    a = views.artifacts(spark, folder)
    a = a.select(F.col("seq").alias("event_id"), F.when(F.col("event_type") != "error", F.col("t")).alias("t"))
    return a.orderBy(F.col("t").desc_nulls_last(), F.col("event_id").desc())


@query("list_newest", """
SELECT o_orderkey, epoch_us(o_orderdate) AS t FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC
""")
def list_newest(spark, folder):
    o = table(spark, folder, "orders")
    out = o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return out.select("o_orderkey", F.unix_micros("o_orderdate").alias("t"))


@query("first_n", """
SELECT case_id, event_id, rank FROM (
  SELECT user_id % 10 AS case_id, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS rank
  FROM events) WHERE rank <= 15
""")
def first_n(spark, folder):
    a = views.artifacts(spark, folder)
    return agg.top_per_group(a, ["case_id"], [F.col("t").asc_nulls_last(), F.col("seq")], 15).select(
        "case_id", F.col("seq").alias("event_id"), "rank")


@query("join_inner", """
SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
""")
def join_inner(spark, folder):
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_lookup", """
SELECT source, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM (
  SELECT coalesce(p.p_name, 'Extracted Engine') AS source, l_quantity FROM lineitem
  LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) p ON l_partkey = p.p_partkey) GROUP BY 1
""")
def join_lookup(spark, folder):
    """Fact rows with the name of their source, or a default where the source is gone."""
    li, p = table(spark, folder, "lineitem"), table(spark, folder, "part")
    named = li.join(p.filter("p_size <= 25"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return (named.groupBy(F.coalesce("p_name", F.lit("Extracted Engine")).alias("source"))
            .agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")))
