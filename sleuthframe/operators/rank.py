"""Similarity search, grounding of answers, triage digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from . import aggregates

# Patterns and exceptions of the grounding check.
LOOSE_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
LOOSE_DOMAIN = r"\b[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{2,}\b"
HARMLESS_DOMAINS = ("example.com", "localhost")
FILE_TAILS = (".log", ".txt", ".csv", ".json", ".pdf", ".docx", ".exe", ".dll", ".evtx", ".pcap", ".png", ".jpg")
DISCLAIMERS = ("verified by the investigator", "available case data")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def top_similar(queries: DataFrame, vectors: DataFrame, k: int = 20, vector: str = "embedding", query_id: str = "query_id",
                vector_id: str = "vec_id", scope: list[str] | None = None, block: int = 500) -> DataFrame:
    """The k vectors of greatest cosine to each query vector.

    Queries are bundled in blocks of about ``block``.  Each bundle meets every part of
    the vectors once (parts by hash of the vector id, as many as shuffle partitions), by
    an equality join; Spark keeps k per query and task before the last shuffle.
    """
    scope = scope or []
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // block))
    norm = lambda c: F.sqrt(_dot(c, c))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(
        *scope, F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_block"),
        F.struct(F.col(query_id).alias("id"), F.col(vector).alias("v"), norm(F.col(vector)).alias("n")).alias("q"))
    bundle = asked.groupBy(*scope, "_block").agg(F.collect_list("q").alias("qs")).withColumn("_part", every(parts))
    dealt = vectors.withColumn("_part", F.pmod(F.xxhash64(vector_id), F.lit(parts)).cast("int")).withColumn("_block", every(blocks))
    both = dealt.join(bundle, [*scope, "_block", "_part"])
    both = both.withColumn("_n", norm(F.col(vector)))
    scored = both.select(*scope, F.col(vector_id), F.explode(F.transform("qs", lambda q: F.struct(
        q["id"].alias(query_id), (_dot(F.col(vector), q["v"]) / F.nullif(F.col("_n") * q["n"], F.lit(0.0))).alias("cosine")))).alias("s"))
    scored = scored.select(*scope, vector_id, f"s.{query_id}", "s.cosine")
    return aggregates.top_per_group(scored, [*scope, query_id], [F.col("cosine").desc_nulls_last(), F.col(vector_id)], k)


def grounding(answers: DataFrame, keys: list[str], known: DataFrame | None = None, scope: list[str] | None = None,
              text: str = "text") -> DataFrame:
    """Share of the addresses and domains of an answer that the case knows.

    ``known`` holds (scope..., value) of entities found in the evidence.  Without
    it only the exceptions count as known, which is the stricter reference rule.
    """
    scope = scope or []
    body = F.col(text)
    mentioned = answers.select(*keys, *scope, F.explode(F.concat(
        F.transform(F.array_distinct(tx.find_all(body, LOOSE_IP)), lambda v: F.struct(F.lit("ip").alias("kind"), v.alias("value"))),
        F.transform(F.array_distinct(tx.find_all(body, LOOSE_DOMAIN)), lambda v: F.struct(F.lit("domain").alias("kind"), v.alias("value")))
    )).alias("e")).select(*keys, *scope, "e.*")
    tail = reduce(lambda a, b: a | b, [F.endswith("value", F.lit(t)) for t in FILE_TAILS])
    harmless = (F.col("kind") == "domain") & (F.col("value").isin(*HARMLESS_DOMAINS) | tail)
    if known is None:
        checked = mentioned.withColumn("made_up", ~harmless)
    else:
        have = known.select(*scope, F.lower("value").alias("_v")).distinct().withColumn("_known", F.lit(True))
        checked = (mentioned.withColumn("_v", F.lower("value")).join(have, [*scope, "_v"], "left")
                   .withColumn("made_up", ~harmless & F.col("_known").isNull()))
    per = checked.groupBy(*keys).agg(F.count("*").alias("entities_checked"), F.count_if("made_up").alias("fabricated_entities"),
                                     F.array_sort(F.collect_set(F.when(F.col("made_up"), F.col("value")))).alias("unknown"))
    low = F.lower(body)
    flag = reduce(lambda a, b: a | b, [F.contains(low, F.lit(d)) for d in DISCLAIMERS])
    out = answers.select(*keys, flag.alias("has_disclaimer")).join(per, keys, "left")
    n, bad = F.coalesce("entities_checked", F.lit(0)), F.coalesce("fabricated_entities", F.lit(0))
    return out.select(*keys, "has_disclaimer", n.alias("entities_checked"), bad.alias("fabricated_entities"),
                      F.round(F.when(n > 0, F.greatest(F.lit(0.0), 1.0 - bad / n)).otherwise(1.0), 2).alias("grounding_score"),
                      F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))


def triage_digest(findings: DataFrame, k: int = 5, *group: str) -> DataFrame:
    """One line over the k gravest critical and high findings of each group."""
    grave = findings.filter(F.col("severity").isin("critical", "high"))
    order = [F.col("risk_score").desc(), F.col("id")]
    top = (aggregates.top_per_group(grave, list(group), order, k) if group else
           grave.orderBy(*order).limit(k).withColumn("rank", F.struct((-F.col("risk_score")).alias("r"), "id")))
    line = F.concat(F.col("threat_category"), F.lit(" involving '"), F.col("title"), F.lit("' (Risk Score: "),
                    F.col("risk_score").cast("string"), F.lit(")"))
    rows = top.groupBy(*group).agg(F.count("*").alias("n_threats"),
                                   F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select(*group, "n_threats", F.array_join(F.transform("l", lambda e: e["line"]), "; ").alias("observations"))
