"""Pair similarity as Column expressions (time, entity, source, event, weighted score)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from ..config import DEFAULT, Settings, Weights
from . import text

# Event names that count as authentication and as execution.
AUTH_EVENTS = ("successful_login", "failed_login", "4624", "4625", "logon")
EXEC_EVENTS = ("program_execution", "4688", "1", "execution", "process")


def clean(value: Column) -> Column:
    return F.lower(text.strip(value))


def missing(value: Column) -> Column:
    return value.isNull() | (value == "")


def time_similarity(micros_a: Column, micros_b: Column, window_seconds: int = 3600) -> Column:
    delta = F.abs(micros_a - micros_b) / F.lit(1_000_000.0)
    near = F.round(F.greatest(F.lit(0.0), 1.0 - delta / F.lit(float(window_seconds))), 4)
    return F.when(delta < window_seconds, near).otherwise(0.0)


def entity_similarity(a: Column, b: Column) -> Column:
    """1.0 equal, 0.75 contained, else 0.  The length test applies to the lexicographic minimum."""
    ca, cb = clean(a), clean(b)
    contained = (ca.contains(cb) | cb.contains(ca)) & (F.length(F.least(ca, cb)) >= 4)
    return (F.when(missing(ca) | missing(cb), 0.0)
            .when(ca == cb, 1.0).when(contained, 0.75).otherwise(0.0))


def entity_description(a: Column, type_a: Column, b: Column, type_b: Column) -> Column:
    s = entity_similarity(a, b)
    label = F.when(type_a == type_b, F.upper(type_a)).otherwise(F.concat(F.upper(type_a), F.lit("/"), F.upper(type_b)))
    return (F.when(s == 1.0, F.concat(F.lit("Exact "), label, F.lit(" match ("), a, F.lit(")")))
            .when(s == 0.75, F.concat(F.lit("Sub-string entity match ("), a, F.lit(" ~ "), b, F.lit(")")))
            .otherwise(""))


def source_similarity(a: Column, b: Column) -> Column:
    ca, cb = clean(a), clean(b)
    return (F.when(missing(a) | missing(b), 0.1).when(ca == cb, 1.0)
            .when(ca.contains(cb) | cb.contains(ca), 0.6).otherwise(0.2))


def event_similarity(a: Column, b: Column) -> Column:
    ca, cb = clean(a), clean(b)
    auth_exec = (ca.isin(*AUTH_EVENTS) & cb.isin(*EXEC_EVENTS)) | (ca.isin(*EXEC_EVENTS) & cb.isin(*AUTH_EVENTS))
    return (F.when(missing(a) | missing(b), 0.2).when(ca == cb, 1.0)
            .when(auth_exec, 0.7).otherwise(0.3))


def raw_score(s_time: Column, s_entity: Column, s_source: Column, s_event: Column,
              weights: Weights = DEFAULT.weights) -> Column:
    """The score before it is rounded."""
    return (F.lit(weights.time) * s_time + F.lit(weights.entity) * s_entity
            + F.lit(weights.source) * s_source + F.lit(weights.event) * s_event) / F.lit(weights.total)


def weighted_score(s_time: Column, s_entity: Column, s_source: Column, s_event: Column,
                   weights: Weights = DEFAULT.weights) -> Column:
    raw = raw_score(s_time, s_entity, s_source, s_event, weights)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4)


def strength(score: Column) -> Column:
    return F.when(score >= 0.70, "Strong").when(score >= 0.40, "Moderate").otherwise("Weak")


def correlation_type(s_time: Column, s_entity: Column, s_source: Column) -> Column:
    return (F.when(s_entity > 0.8, "ENTITY_MATCH").when(s_time > 0.7, "TIME_PROXIMITY")
            .when(s_source > 0.8, "COMMON_SOURCE").otherwise("MULTI_FACTOR"))


def category_colour(category: Column) -> Column:
    return F.when(category == "Strong", "#06b6d4").when(category == "Moderate", "#f59e0b").otherwise("#64748b")


def register_sql_functions(spark: SparkSession, settings: Settings = DEFAULT) -> None:
    """SQL names for the similarities; SQL UDFs are inlined by Catalyst."""
    w = settings.weights
    texts = ", ".join(f"'{e}'" for e in AUTH_EVENTS), ", ".join(f"'{e}'" for e in EXEC_EVENTS)
    for ddl in (
        f"""time_similarity(a BIGINT, b BIGINT) RETURNS DOUBLE RETURN
            CASE WHEN abs(a - b) < {settings.window_micros}
                 THEN round(greatest(0D, 1D - (abs(a - b) / 1000000D) / {float(settings.window_seconds)}D), 4)
                 ELSE 0D END""",
        """entity_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN
            CASE WHEN coalesce(trim(a), '') = '' OR coalesce(trim(b), '') = '' THEN 0D
                 WHEN lower(trim(a)) = lower(trim(b)) THEN 1D
                 WHEN (contains(lower(trim(a)), lower(trim(b))) OR contains(lower(trim(b)), lower(trim(a))))
                      AND length(least(lower(trim(a)), lower(trim(b)))) >= 4 THEN 0.75D
                 ELSE 0D END""",
        """source_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN
            CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0.1D
                 WHEN lower(trim(a)) = lower(trim(b)) THEN 1D
                 WHEN contains(lower(trim(a)), lower(trim(b))) OR contains(lower(trim(b)), lower(trim(a))) THEN 0.6D
                 ELSE 0.2D END""",
        f"""event_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN
            CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0.2D
                 WHEN lower(trim(a)) = lower(trim(b)) THEN 1D
                 WHEN (lower(trim(a)) IN ({texts[0]}) AND lower(trim(b)) IN ({texts[1]}))
                   OR (lower(trim(a)) IN ({texts[1]}) AND lower(trim(b)) IN ({texts[0]})) THEN 0.7D
                 ELSE 0.3D END""",
        f"""correlation_score(t DOUBLE, e DOUBLE, s DOUBLE, v DOUBLE) RETURNS DOUBLE RETURN
            round(least(1D, greatest(0D, ({w.time}D * t + {w.entity}D * e + {w.source}D * s + {w.event}D * v)
                  / {w.total}D)), 4)""",
    ):
        for side in "ab":  # white space of all kinds goes, as in ``clean``
            ddl = ddl.replace(f"trim({side})", rf"regexp_replace({side}, r'(?U)^\s+|\s+$', '')")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {ddl}")
