"""Relationship graph of cases and the flow graph of network rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import similarity as sim, text as tx

# Fixed value: e-mail pattern of the graph (its last class has a bar in it).
GRAPH_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def _edge(df: DataFrame, rank: int, source, target, label, score: float, reason, node_label, node_type) -> DataFrame:
    as_col = lambda v: v if not isinstance(v, str) else F.lit(v)
    return df.select(
        "case_id", source.alias("source"), target.alias("target"), as_col(label).alias("label"), F.lit(score).alias("score"),
        F.lit("Strong").alias("strength_category"), as_col(reason).alias("reason"),
        as_col(node_label).alias("node_label"), as_col(node_type).alias("node_type"), F.lit(rank).alias("rank"))


def case_edges(evidence: DataFrame, extracted: DataFrame | None = None, users: DataFrame | None = None,
               findings: DataFrame | None = None, correlations: DataFrame | None = None) -> DataFrame:
    """Typed edges of all cases; every edge also describes the node it leads to.

    evidence: case_id, evidence_id, filename, sha256, metadata (JSON text)
    extracted: case_id, evidence_id, artifact_type, value; users: case_id, evidence_id, user
    findings: case_id, id, evidence_id (may be NULL), title, severity; correlations: scored pairs.
    """
    text = lambda c: F.col(c).cast("string")
    file_node = F.concat(F.lit("evidence_"), text("evidence_id"))
    case_node = F.concat(F.lit("case_"), text("case_id"))
    short = F.substring("sha256", 1, 8)
    # the four kinds of edges of a file come out of one pass over the evidence
    def of_file(rank, source, target, label, score, reason, node_label, node_type):
        as_col = lambda v: v if not isinstance(v, str) else F.lit(v)
        return F.struct(source.alias("source"), target.alias("target"), F.lit(label).alias("label"), F.lit(score).alias("score"),
                        F.lit("Strong").alias("strength_category"), as_col(reason).alias("reason"),
                        as_col(node_label).alias("node_label"), F.lit(node_type).alias("node_type"), F.lit(rank).alias("rank"))

    found = lambda pattern: F.array_distinct(tx.find_all(F.col("metadata"), pattern))
    of_evidence = F.concat(
        F.array(of_file(0, case_node, file_node, "contains", 1.0, "Case evidence container", F.col("filename"), "evidence"),
                of_file(1, file_node, F.concat(F.lit("hash_"), F.col("sha256")), "hashes_to", 1.0, "SHA256 cryptographic hash",
                        F.concat(F.lit("SHA256: "), short, F.lit("...")), "hash")),
        F.transform(found(tx.IP_V4), lambda v: of_file(
            2, file_node, F.concat(F.lit("ip_"), v), "references_ip", 0.85, F.concat(F.lit("Extracted IP endpoint "), v), v, "ip")),
        F.transform(found(GRAPH_EMAIL), lambda v: of_file(
            3, file_node, F.concat(F.lit("email_"), v), "contains_email", 0.85, F.concat(F.lit("Extracted Email "), v), v, "email")))
    parts = [evidence.select("case_id", F.explode(of_evidence).alias("e")).select("case_id", "e.*")]
    if users is not None:
        parts.append(_edge(users, 4, file_node, F.concat(F.lit("user_"), F.lower("user")), "logs_auth_user", 0.80,
                           F.concat(F.lit("Log auth username "), "user"), F.col("user"), "username"))
    if extracted is not None:
        kind = F.lower("artifact_type")
        parts.append(_edge(extracted, 5, file_node,
                           F.concat(F.lit("art_"), kind, F.lit("_"), F.translate("value", " ", "_")),
                           F.concat(F.lit("extracted_"), kind), 0.75, F.concat(F.lit("Extracted "), "artifact_type"),
                           F.concat(F.col("artifact_type"), F.lit(": "), F.substring("value", 1, 25)), kind))
    if findings is not None:
        node = F.concat(F.lit("finding_"), text("id"))
        owned, loose = findings.filter("evidence_id IS NOT NULL"), findings.filter("evidence_id IS NULL")
        parts.append(_edge(owned, 6, file_node, node, F.concat(F.lit("triggers ("), F.col("severity"), F.lit(")")), 0.90,
                           F.concat(F.lit("AI finding triggered from evidence #"), text("evidence_id")), F.col("title"), "finding"))
        parts.append(_edge(loose, 6, case_node, node, "affects", 0.80, "AI finding affects case", F.col("title"), "finding"))
    if correlations is not None:
        parts.append(correlations.select(
            "case_id", F.concat(F.lit("corr_"), "artifact_a_id").alias("source"),
            F.concat(F.lit("corr_"), "artifact_b_id").alias("target"),
            F.format_string("%s (%.2f)", "correlation_type", "score").alias("label"), F.round("score", 2).alias("score"),
            "strength_category", "reason", F.col("artifact_b_label").alias("node_label"),
            F.lower("artifact_b_type").alias("node_type"), F.lit(7).alias("rank")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair of nodes of a case: the first kind wins, then the smallest.

    Edges may come without their reason, which is longer than all the rest.
    """
    kept = [c for c in ("source", "target", "label", "score", "strength_category", "reason") if c in edges.columns]
    first = F.min(F.struct("rank", *kept)).alias("e")
    return (edges.groupBy("case_id", F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b"))
            .agg(first).select("case_id", *[F.col(f"e.{c}").alias(c) for c in kept])
            .withColumn("color", sim.category_colour(F.col("strength_category"))))


def nodes(edges: DataFrame, correlations: DataFrame | None = None) -> DataFrame:
    """Every node once, with the label of its first mention."""
    ends = edges.select("case_id", F.col("target").alias("id"), F.col("node_label").alias("label"),
                        F.col("node_type").alias("type"), "rank")
    cases = edges.filter("rank = 0").select(
        "case_id", F.col("source").alias("id"), F.concat(F.lit("Case "), F.col("case_id").cast("string")).alias("label"),
        F.lit("case").alias("type"), F.lit(-1).alias("rank"))
    ends = ends.unionByName(cases)
    if correlations is not None:
        ends = ends.unionByName(correlations.select(
            "case_id", F.concat(F.lit("corr_"), "artifact_a_id").alias("id"), F.col("artifact_a_label").alias("label"),
            F.lower("artifact_a_type").alias("type"), F.lit(7).alias("rank")))
    return (ends.groupBy("case_id", "id").agg(F.min(F.struct("rank", "label", "type")).alias("n"))
            .select("case_id", "id", "n.label", "n.type"))


# ---- flows ------------------------------------------------------------------

def flow_edges(flows: DataFrame) -> DataFrame:
    """One edge per (source, destination, label) with the number of rows behind it."""
    source = F.coalesce(F.nullif("source_ip", F.lit("")), "value")
    return (flows.select(source.alias("source"), F.col("destination_ip").alias("target"),
                         F.coalesce("protocol", "artifact_type").alias("label"))
            .filter("source IS NOT NULL AND target IS NOT NULL")
            .groupBy("source", "target", "label").agg(F.count("*").alias("weight")))


def degrees(edges: DataFrame) -> DataFrame:
    """Rows at each node; a loop counts twice, as both of its ends do."""
    return (edges.select(F.explode(F.array("source", "target")).alias("id"), "weight")
            .groupBy("id").agg(F.sum("weight").alias("degree")))


def min_degree(edges: DataFrame, least: int) -> DataFrame:
    """Edges whose two nodes have at least ``least`` connections."""
    busy = degrees(edges).filter(F.col("degree") >= least).select("id")
    return (edges.join(busy.withColumnRenamed("id", "source"), "source", "left_semi")
            .join(busy.withColumnRenamed("id", "target"), "target", "left_semi"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """A node and what it is connected to."""
    at = edges.filter((F.col("source") == node) | (F.col("target") == node))
    return at.select(F.explode(F.array("source", "target")).alias("id")).distinct()
