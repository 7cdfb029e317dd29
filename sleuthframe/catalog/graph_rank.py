"""Graphs, similarity search, grounding, triage, model activation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import text as tx
from ..operators import classify, correlate, dedup, graph, rank
from ..session import table
from . import query
from .correlation import ARTIFACT, IN_CASE, SCORE, SIMILARITY
from .rules import WATCHED
from .text import sql_pattern


def _edges(spark, folder):
    ev = dedup.with_digests(views.evidence(spark, folder), F.col("text")).withColumn("metadata", F.col("text"))
    found = views.findings(spark, folder)
    n = F.col("id") % 4 == 0
    found = found.withColumn("evidence_id", F.when(~n, F.col("evidence_id")))
    return graph.case_edges(ev, findings=found)


EDGES = f"""
ev AS (SELECT doc_id, doc_id % 20 AS case_id, source || '_' || doc_id || '.txt' AS filename, text, sha256(text) AS h FROM documents),
fnd AS (SELECT o_orderkey AS id, o_custkey % 20 AS case_id, o_custkey AS evidence_id,
  ['critical', 'high', 'medium', 'low', 'info'][substr(o_orderpriority, 1, 1)::INT] AS severity FROM orders),
edges AS (
  SELECT 0 AS rank, case_id, 'case_' || case_id AS source, 'evidence_' || doc_id AS target, 'contains' AS label, 1.0 AS score, filename AS node_label, 'evidence' AS node_type FROM ev
  UNION ALL SELECT 1, case_id, 'evidence_' || doc_id, 'hash_' || h, 'hashes_to', 1.0, 'SHA256: ' || substr(h, 1, 8) || '...', 'hash' FROM ev
  UNION ALL SELECT 2, case_id, 'evidence_' || doc_id, 'ip_' || v, 'references_ip', 0.85, v, 'ip'
    FROM (SELECT case_id, doc_id, unnest(list_distinct(regexp_extract_all(text, {sql_pattern(tx.IP_V4)}))) AS v FROM ev)
  UNION ALL SELECT 3, case_id, 'evidence_' || doc_id, 'email_' || v, 'contains_email', 0.85, v, 'email'
    FROM (SELECT case_id, doc_id, unnest(list_distinct(regexp_extract_all(text, {sql_pattern(graph.GRAPH_EMAIL)}))) AS v FROM ev)
  UNION ALL SELECT 6, case_id, 'evidence_' || evidence_id, 'finding_' || id, 'triggers (' || severity || ')', 0.9, 'Finding ' || id, 'finding' FROM fnd WHERE id % 4 <> 0
  UNION ALL SELECT 6, case_id, 'case_' || case_id, 'finding_' || id, 'affects', 0.8, 'Finding ' || id, 'finding' FROM fnd WHERE id % 4 = 0)
"""


@query("graph_edges", f"""
WITH {EDGES}
SELECT case_id, source, target, label, score::DOUBLE AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, least(source, target), greatest(source, target) ORDER BY rank, source, target, label) AS k FROM edges) WHERE k = 1
""")
def graph_edges(spark, folder):
    return graph.distinct_edges(_edges(spark, folder)).select("case_id", "source", "target", "label", "score")


@query("graph_nodes", f"""
WITH {EDGES},
n AS (SELECT case_id, target AS id, node_label AS label, node_type AS type, rank FROM edges
  UNION ALL SELECT DISTINCT case_id, source, 'Case ' || case_id, 'case', -1 FROM edges WHERE rank = 0)
SELECT case_id, id, label, type FROM (SELECT *, row_number() OVER (PARTITION BY case_id, id ORDER BY rank, label, type) AS k FROM n) WHERE k = 1
""")
def graph_nodes(spark, folder):
    return graph.nodes(_edges(spark, folder))


@query("graph_correlations", f"""
WITH {ARTIFACT}, {EDGES},
scored AS (SELECT *, {SCORE} AS score FROM (
  SELECT a.case_id, a.id AS a, b.id AS b, abs(a.t - b.t) AS apart, {SIMILARITY}
  FROM artifact a JOIN artifact b ON a.case_id = b.case_id AND a.id <> b.id
   AND (a.entity_value = b.entity_value OR abs(a.t - b.t) < 3600000000))),
best AS (SELECT * FROM scored WHERE score >= 0.15
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, apart, b) = 1),
corr AS (SELECT DISTINCT case_id, 'corr_' || least(a, b) AS source, 'corr_' || greatest(a, b) AS target,
    CASE WHEN s_entity > 0.8 THEN 'ENTITY_MATCH' WHEN s_time > 0.7 THEN 'TIME_PROXIMITY'
         WHEN s_source > 0.8 THEN 'COMMON_SOURCE' ELSE 'MULTI_FACTOR' END
      || ' (' || round(CAST(CAST(score AS VARCHAR) AS DECIMAL(10, 4)), 2)::DECIMAL(10, 2)::VARCHAR || ')' AS label,
    round(CAST(CAST(score AS VARCHAR) AS DECIMAL(10, 4)), 2)::DOUBLE AS score,
    CASE WHEN score >= 0.70 THEN 'Strong' WHEN score >= 0.40 THEN 'Moderate' ELSE 'Weak' END AS strength_category FROM best),
every AS (SELECT rank, case_id, source, target, label, score::DOUBLE AS score, 'Strong' AS strength_category FROM edges WHERE rank < 6
  UNION ALL SELECT 7, * FROM corr)
SELECT case_id, source, target, label, score, strength_category,
  CASE strength_category WHEN 'Strong' THEN '#06b6d4' WHEN 'Moderate' THEN '#f59e0b' ELSE '#64748b' END AS color FROM every
QUALIFY row_number() OVER (PARTITION BY case_id, least(source, target), greatest(source, target) ORDER BY rank, source, target, label) = 1
""")
def graph_correlations(spark, folder):
    """Graph edges of the files and of every event's best correlation, with colours."""
    best = correlate.best_partner(views.artifacts(spark, folder), IN_CASE)
    # edges show neither labels nor reasons, so that the rows of both ends are not joined; a pair found from both ends is one edge
    pairs = best.withColumns({"artifact_a_id": F.least("artifact_a_id", "artifact_b_id"), "artifact_b_id": F.greatest("artifact_a_id", "artifact_b_id"),
                              **{c: F.lit(None).cast("string") for c in ("artifact_b_label", "artifact_b_type", "reason")}})
    ev = dedup.with_digests(views.evidence(spark, folder), F.col("text")).withColumn("metadata", F.col("text"))
    return graph.distinct_edges(graph.case_edges(ev, correlations=pairs).drop("reason"))


FLOW_EDGES = f"""
{WATCHED},
fe AS (SELECT source_ip AS source, destination_ip AS target, protocol AS label, count(*) AS weight FROM flow GROUP BY ALL)
"""


@query("flow_edges", f"WITH {FLOW_EDGES} SELECT * FROM fe")
def flow_edges(spark, folder):
    return graph.flow_edges(views.flows(spark, folder))


@query("flow_degree", f"""
WITH {FLOW_EDGES},
d AS (SELECT id, sum(weight) AS degree FROM (SELECT source AS id, weight FROM fe UNION ALL SELECT target, weight FROM fe) GROUP BY 1)
SELECT fe.* FROM fe WHERE source IN (SELECT id FROM d WHERE degree >= 40) AND target IN (SELECT id FROM d WHERE degree >= 40)
""")
def flow_degree(spark, folder):
    return graph.min_degree(graph.flow_edges(views.flows(spark, folder)), 40).select("source", "target", "label", "weight")


@query("neighbours", f"""
WITH {FLOW_EDGES}, e AS (SELECT * FROM fe WHERE source = '10.0.0.5' OR target = '10.0.0.5')
SELECT source AS id FROM e UNION SELECT target FROM e
""")
def neighbours(spark, folder):
    return graph.neighbours(graph.flow_edges(views.flows(spark, folder)), "10.0.0.5")


@query("cosine_topk", """
WITH q AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY 1),
qv AS (SELECT query_id, embedding AS v FROM q JOIN embeddings ON vec_id = query_id),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS cosine FROM qv, embeddings)
SELECT query_id, vec_id, round(cosine, 6) AS cosine FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""")
def cosine_topk(spark, folder):
    """The 20 vectors nearest to the first vector of each label."""
    e = table(spark, folder, "embeddings", spread=True)
    first = e.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("q")).select(
        F.col("q.vec_id").alias("query_id"), F.col("q.embedding").alias("embedding"))
    return rank.top_similar(first, e, 20).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


LOOSE = f"""
ans AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
m AS (SELECT conv_id, turn, 'ip' AS kind, unnest(list_distinct(regexp_extract_all(text, {sql_pattern(rank.LOOSE_IP)}))) AS value FROM ans
  UNION ALL SELECT conv_id, turn, 'domain', unnest(list_distinct(regexp_extract_all(text, {sql_pattern(rank.LOOSE_DOMAIN)}))) FROM ans),
known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, {sql_pattern(rank.LOOSE_IP)} || '|' || {sql_pattern(rank.LOOSE_DOMAIN)}))) AS value FROM documents),
c AS (SELECT *, NOT (kind = 'domain' AND (value IN ('example.com', 'localhost') OR regexp_matches(value, '\\.(log|txt|csv|json|pdf|docx|exe|dll|evtx|pcap|png|jpg)$'))) AS loose FROM m)
"""


@query("grounding", f"""
WITH {LOOSE}, p AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (loose AND lower(value) NOT IN (SELECT value FROM known)) AS bad FROM c GROUP BY 1, 2)
SELECT a.conv_id, a.turn, coalesce(n, 0) AS entities_checked, coalesce(bad, 0) AS fabricated_entities,
  CASE WHEN coalesce(n, 0) > 0 THEN round(greatest(0, 1.0 - bad / n::DOUBLE), 2) ELSE 1.0 END AS grounding_score
FROM ans a LEFT JOIN p USING (conv_id, turn)
""")
def grounding(spark, folder):
    """Answers checked against the addresses and domains that the documents mention."""
    c = table(spark, folder, "conversations").filter("role = 'assistant'")
    known = table(spark, folder, "documents", spread=True).select(F.explode(tx.find_all(F.col("text"), rank.LOOSE_IP + "|" + rank.LOOSE_DOMAIN)).alias("value"))
    return rank.grounding(c, ["conv_id", "turn"], known).select(
        "conv_id", "turn", "entities_checked", "fabricated_entities", "grounding_score")


@query("grounding_strict", f"""
WITH {LOOSE}, p AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (loose) AS bad FROM c GROUP BY 1, 2)
SELECT a.conv_id, a.turn, coalesce(n, 0) AS entities_checked, coalesce(bad, 0) AS fabricated_entities,
  CASE WHEN coalesce(n, 0) > 0 THEN round(greatest(0, 1.0 - bad / n::DOUBLE), 2) ELSE 1.0 END AS grounding_score
FROM ans a LEFT JOIN p USING (conv_id, turn)
""")
def grounding_strict(spark, folder):
    c = table(spark, folder, "conversations").filter("role = 'assistant'")
    return rank.grounding(c, ["conv_id", "turn"]).select(
        "conv_id", "turn", "entities_checked", "fabricated_entities", "grounding_score")


FINDING = """
f AS (SELECT o_orderkey AS id, o_custkey % 20 AS case_id, 'Finding ' || o_orderkey AS title,
  ['critical', 'high', 'medium', 'low', 'info'][substr(o_orderpriority, 1, 1)::INT] AS severity, floor(o_totalprice)::BIGINT % 101 AS risk_score,
  ['Credential Access', 'Command & Control', 'Defense Evasion'][(o_orderkey % 3 + 1)::INT] AS threat_category FROM orders)
"""


@query("triage_digest", f"""
WITH {FINDING},
t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY risk_score DESC, id) AS rank FROM f WHERE severity IN ('critical', 'high'))
SELECT case_id, count(*) AS n_threats, string_agg(threat_category || ' involving ''' || title || ''' (Risk Score: ' || risk_score || ')', '; ' ORDER BY rank) AS observations
FROM t WHERE rank <= 5 GROUP BY 1
""")
def triage_digest(spark, folder):
    return rank.triage_digest(views.findings(spark, folder), 5, "case_id")


@query("active_model", """
WITH reg AS (SELECT o_orderkey AS model_id, o_orderpriority AS model_type, o_orderdate FROM orders),
act AS (SELECT model_id, model_type, row_number() OVER (PARTITION BY model_type ORDER BY o_orderdate DESC, model_id DESC) AS k FROM reg)
SELECT model_id, model_type, k = 1 AS is_active FROM act
""")
def active_model(spark, folder):
    """orders as registered model versions, each activated at its date."""
    o = table(spark, folder, "orders")
    reg = o.select(F.col("o_orderkey").alias("model_id"), F.col("o_orderpriority").alias("model_type"))
    act = o.select(F.col("o_orderkey").alias("model_id"), F.col("o_orderdate").alias("activated_at"))
    return classify.active_models(reg, act).select("model_id", "model_type", "is_active")
