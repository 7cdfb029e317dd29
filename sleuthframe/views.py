"""The provided tables seen as investigation tables (case, artifact, evidence, finding, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .session import table


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """events as normalised artifacts."""
    e = table(spark, folder, "events")
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return e.select(
        F.lit("Extracted_USERNAME").alias("type"),
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("username: "), user).alias("label"),
        user.alias("entity_value"),
        F.lit("username").alias("entity_type"),
        F.col("ts").alias("timestamp"),
        F.unix_micros("ts").alias("t"),
        F.concat(F.lit("sensor"), (F.col("event_id") % 5).cast("string")).alias("source"),
        F.col("event_type"),
        (F.col("user_id") % 10).alias("case_id"),
        F.col("value").alias("weight"),
        F.col("event_id").alias("seq"),
    )


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """documents as text evidence files; ingest order follows doc_id."""
    d = table(spark, folder, "documents", spread=True)
    return d.select(
        F.col("doc_id").alias("evidence_id"),
        (F.col("doc_id") % 20).alias("case_id"),
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("extension"),
        F.lit("text/plain").alias("detected_mime"),
        F.col("text"),
        F.octet_length("text").cast("long").alias("file_size"),
        F.col("lang"),
        F.col("source"),
    )


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """orders as findings; severity by the leading digit of the priority."""
    o = table(spark, folder, "orders")
    severity = F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]),
                            F.substring("o_orderpriority", 1, 1).cast("int"))
    category = F.element_at(F.array(*[F.lit(s) for s in ("Credential Access", "Command & Control", "Defense Evasion")]),
                            (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 20).alias("case_id"),
        F.col("o_custkey").alias("evidence_id"),
        F.concat(F.lit("Finding "), F.col("o_orderkey").cast("string")).alias("title"),
        severity.alias("severity"),
        (F.floor("o_totalprice") % 101).cast("long").alias("risk_score"),
        category.alias("threat_category"),
        F.col("o_orderdate").alias("created_at"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """labels as review states of documents."""
    label = table(spark, folder, "labels")
    return label.select(
        F.col("doc_id").alias("finding_id"),
        (F.col("doc_id") % 20).alias("case_id"),
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved")
        .otherwise("pending").alias("review_status"),
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """orders as analysis jobs: P is running, F done, O queued."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("evidence_id"),
        (F.col("o_custkey") % 20).alias("case_id"),
        F.when(F.col("o_orderstatus") == "P", "PROCESSING").when(F.col("o_orderstatus") == "F", "COMPLETED")
        .otherwise("QUEUED").alias("status"),
        F.col("o_orderpriority").alias("current_stage"),
        F.col("o_orderdate").alias("started_at"),
    )


# Ports used to dress line items as flows (five of them are watch-listed).
FLOW_PORTS = (80, 443, 53, 22, 3389, 4444, 8080, 1337, 31337, 25)


def _address(key: str, first: str) -> "F.Column":
    c = F.col(key)
    return F.concat_ws(".", F.lit(first), (F.shiftright(c, 16) % 256).cast("string"),
                       (F.shiftright(c, 8) % 256).cast("string"), (c % 256).cast("string"))


def flows(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """lineitem as network flows: supplier talks to part."""
    li = table(spark, folder, "lineitem", spread)
    port = F.element_at(F.array(*[F.lit(p) for p in FLOW_PORTS]), (F.col("l_partkey") % len(FLOW_PORTS) + 1).cast("int"))
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        (F.col("l_orderkey") % 20).alias("case_id"),
        F.lit("flow").alias("artifact_type"),
        F.col("l_shipdate").alias("timestamp"),
        _address("l_suppkey", "10").alias("source_ip"),
        _address("l_partkey", "172").alias("destination_ip"),
        (F.col("l_quantity").cast("int") + 1024).alias("source_port"),
        port.alias("destination_port"),
        F.when(F.col("l_returnflag") == "A", "TCP").when(F.col("l_returnflag") == "N", "UDP")
        .otherwise("ICMP").alias("protocol"),
        F.when(F.col("l_linestatus") == "F", "DENY").otherwise("ALLOW").alias("value"),
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
    )


def browser(spark: SparkSession, folder: str) -> DataFrame:
    """pages as visited URLs."""
    p = table(spark, folder, "pages")
    return p.select(
        F.col("page_id").alias("id"), (F.col("page_id") % 20).alias("case_id"),
        F.lit("chromium").alias("browser"), F.lit("history").alias("artifact_type"),
        F.col("url"), F.lower(F.expr("try_parse_url(url, 'HOST')")).alias("domain"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("target_path"),
    )
