"""Correlation: focus pairs, partner counts, summaries, buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..config import Settings
from ..operators import correlate, scan
from . import query

IN_CASE = Settings(cross_case=False)

ARTIFACT = """
artifact AS (
  SELECT 'ev_' || event_id AS id, user_id % 10 AS case_id, 'user' || user_id AS entity_value,
         'sensor' || (event_id % 5) AS source, event_type, epoch_us(ts) AS t, value AS weight, event_id AS seq
  FROM events)
"""
def rounded(expr: str, places: int = 4) -> str:
    """Half-up rounding of the decimal text of a double, as Spark rounds."""
    return f"round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(30, 18)), {places})::DOUBLE"


SIMILARITY = f"""
  CASE WHEN abs(a.t - b.t) / 1000000.0 < 3600
       THEN {rounded("greatest(0.0::DOUBLE, 1.0::DOUBLE - (abs(a.t - b.t) / 1000000.0::DOUBLE) / 3600.0::DOUBLE)")}
       ELSE 0.0::DOUBLE END AS s_time,
  CASE WHEN a.entity_value = b.entity_value THEN 1.0::DOUBLE
       WHEN (contains(a.entity_value, b.entity_value) OR contains(b.entity_value, a.entity_value))
            AND length(least(a.entity_value, b.entity_value)) >= 4 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS s_entity,
  CASE WHEN a.source = b.source THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS s_source,
  CASE WHEN a.event_type = b.event_type THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS s_event
"""
SCORE = rounded("0.30::DOUBLE * s_time + 0.35::DOUBLE * s_entity + 0.15::DOUBLE * s_source + 0.20::DOUBLE * s_event")


def focus(artifacts):
    """The 25 artifacts of greatest value: what an analyst opens first."""
    return artifacts.orderBy(F.col("weight").desc(), F.col("seq")).limit(25)


FOCUS_SQL = f"""
WITH {ARTIFACT},
focus AS (SELECT * FROM artifact ORDER BY weight DESC, seq LIMIT 25),
pairs AS (
  SELECT a.id AS artifact_a_id, b.id AS artifact_b_id, a.case_id, a.entity_value AS ea, b.entity_value AS eb,
         a.source AS sa, {SIMILARITY}
  FROM focus a JOIN artifact b ON a.id <> b.id
   AND (a.entity_value = b.entity_value OR abs(a.t - b.t) < 3600000000) {{scope}}
  WHERE NOT (b.id IN (SELECT id FROM focus) AND a.id > b.id)),
scored AS (SELECT *, {SCORE} AS score FROM pairs)
SELECT case_id, artifact_a_id, artifact_b_id, correlation_type, score, strength_category,
  strength_category || ' correlation (' || correlation_type || '): ' ||
  CASE correlation_type
    WHEN 'ENTITY_MATCH' THEN 'Exact USERNAME match (' || ea || ')'
    WHEN 'TIME_PROXIMITY' THEN 'High temporal closeness (time sim: ' || CAST(round(CAST(s_time AS DECIMAL(10, 4)), 2) AS DECIMAL(10, 2))::VARCHAR || ')'
    WHEN 'COMMON_SOURCE' THEN 'Shared evidence source (' || sa || ')'
    ELSE 'Multi-factor heuristic correlation' END AS reason_head
FROM (SELECT *, CASE WHEN score >= 0.70 THEN 'Strong' WHEN score >= 0.40 THEN 'Moderate' ELSE 'Weak' END AS strength_category,
        CASE WHEN s_entity > 0.8 THEN 'ENTITY_MATCH' WHEN s_time > 0.7 THEN 'TIME_PROXIMITY'
             WHEN s_source > 0.8 THEN 'COMMON_SOURCE' ELSE 'MULTI_FACTOR' END AS correlation_type
      FROM scored WHERE score >= 0.15)
"""


def _focus_rows(spark, folder, settings):
    a = views.artifacts(spark, folder)
    out = correlate.focus_pairs(a, focus(a), settings)
    return out.select("case_id", "artifact_a_id", "artifact_b_id", "correlation_type", "score", "strength_category",
                      F.regexp_extract("reason", r"^(.*?)\. Breakdown", 1).alias("reason_head"))


@query("correlate_focus", FOCUS_SQL.format(scope="AND a.case_id = b.case_id"))
def correlate_focus(spark, folder):
    return _focus_rows(spark, folder, IN_CASE)


@query("correlate_focus_cross_case", FOCUS_SQL.format(scope=""))
def correlate_focus_cross_case(spark, folder):
    return _focus_rows(spark, folder, Settings(cross_case=True))


@query("correlate_undated", f"""
WITH {ARTIFACT},
und AS (SELECT * REPLACE (CASE WHEN event_type = 'error' THEN NULL ELSE t END AS t) FROM artifact),
focus AS (SELECT * FROM und ORDER BY weight DESC, seq LIMIT 25),
pairs AS (
  SELECT a.id AS artifact_a_id, b.id AS artifact_b_id, a.case_id,
         CASE WHEN a.entity_value = b.entity_value THEN 'same' ELSE 'other' END AS entity_relation, {SIMILARITY}
  FROM focus a JOIN und b ON a.id <> b.id AND a.case_id = b.case_id
   AND (a.entity_value = b.entity_value OR a.t IS NULL OR b.t IS NULL OR abs(a.t - b.t) < 3600000000)
  WHERE NOT (b.id IN (SELECT id FROM focus) AND a.id > b.id)),
scored AS (SELECT *, {SCORE} AS score FROM pairs)
SELECT case_id, artifact_a_id, artifact_b_id, score FROM scored WHERE score >= 0.15
""")
def correlate_undated(spark, folder):
    """Rows without a timestamp pair with everything in their case (here: all 'error' events lose theirs)."""
    a = views.artifacts(spark, folder)
    dated = F.col("event_type") != "error"
    a = a.withColumns({"t": F.when(dated, F.col("t")), "timestamp": F.when(dated, F.col("timestamp"))})
    return correlate.focus_pairs(a, focus(a), IN_CASE).select("case_id", "artifact_a_id", "artifact_b_id", "score")


@query("entity_groups", f"""
WITH {ARTIFACT}
SELECT case_id, lower(trim(entity_value)) AS entity_key, count(*) AS n_artifacts,
       min(t) AS first_t, max(t) AS last_t, count(*) * (count(*) - 1) // 2 AS n_pairs
FROM artifact GROUP BY ALL HAVING count(*) > 1
""")
def entity_groups(spark, folder):
    return correlate.entity_groups(views.artifacts(spark, folder))


@query("partner_counts", f"""
WITH {ARTIFACT}
SELECT a.id, a.case_id, a.entity_value AS entity_key, a.t,
       count(*) FILTER (WHERE a.entity_value = b.entity_value) - 1 AS n_same_entity,
       count(*) FILTER (WHERE abs(a.t - b.t) < 3600000000) - 1 AS n_in_window,
       count(*) FILTER (WHERE a.entity_value = b.entity_value AND abs(a.t - b.t) < 3600000000) - 1 AS n_both
FROM artifact a JOIN artifact b ON a.case_id = b.case_id GROUP BY ALL
""")
def partner_counts(spark, folder):
    return correlate.partner_counts(views.artifacts(spark, folder), IN_CASE)


@query("pair_summary", f"""
WITH {ARTIFACT},
pairs AS (
  SELECT a.case_id,
    CASE WHEN abs(a.t - b.t) / 1000000.0 < 3600
         THEN {rounded("greatest(0.0::DOUBLE, 1.0::DOUBLE - (abs(a.t - b.t) / 1000000.0::DOUBLE) / 3600.0::DOUBLE)")}
         ELSE 0.0::DOUBLE END AS s_time,
    CASE WHEN a.entity_value = b.entity_value THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_entity,
    CASE WHEN a.source = b.source THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS s_source,
    CASE WHEN a.event_type = b.event_type THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS s_event
  FROM artifact a JOIN artifact b ON a.case_id = b.case_id AND a.seq < b.seq
   AND (a.entity_value = b.entity_value OR abs(a.t - b.t) < 3600000000)),
scored AS (SELECT *, {SCORE} AS score FROM pairs)
SELECT case_id,
  CASE WHEN s_entity > 0.8 THEN 'ENTITY_MATCH' WHEN s_time > 0.7 THEN 'TIME_PROXIMITY'
       WHEN s_source > 0.8 THEN 'COMMON_SOURCE' ELSE 'MULTI_FACTOR' END AS correlation_type,
  CASE WHEN score >= 0.70 THEN 'Strong' WHEN score >= 0.40 THEN 'Moderate' ELSE 'Weak' END AS strength_category,
  count(*) AS n_pairs
FROM scored WHERE score >= 0.15 GROUP BY ALL
""")
def pair_summary(spark, folder):
    return correlate.pair_summary(views.artifacts(spark, folder), IN_CASE)


BEST_SQL = f"""
WITH {ARTIFACT},
art AS (SELECT * REPLACE (CASE WHEN event_type = 'error' AND seq % 3 = 0 THEN NULL ELSE t END AS t) FROM artifact),
pairs AS (
  SELECT a.id AS artifact_a_id, b.id AS artifact_b_id, abs(a.t - b.t) AS apart, {SIMILARITY}
  FROM art a JOIN art b ON {{scope}}a.id <> b.id
   AND (a.entity_value = b.entity_value OR a.t IS NULL OR b.t IS NULL OR abs(a.t - b.t) < 3600000000)),
scored AS (SELECT *, {SCORE} AS score FROM pairs)
SELECT artifact_a_id, artifact_b_id, score,
  CASE WHEN score >= 0.70 THEN 'Strong' WHEN score >= 0.40 THEN 'Moderate' ELSE 'Weak' END AS strength_category,
  CASE WHEN s_entity > 0.8 THEN 'ENTITY_MATCH' WHEN s_time > 0.7 THEN 'TIME_PROXIMITY'
       WHEN s_source > 0.8 THEN 'COMMON_SOURCE' ELSE 'MULTI_FACTOR' END AS correlation_type
FROM scored WHERE score >= 0.15
QUALIFY row_number() OVER (PARTITION BY artifact_a_id ORDER BY score DESC, apart ASC NULLS LAST, artifact_b_id) = 1
"""


def _some_undated(spark, folder):
    a = views.artifacts(spark, folder)
    return a.withColumn("t", F.when((F.col("event_type") != "error") | (F.col("seq") % 3 != 0), F.col("t")))


def _best_rows(spark, folder, settings):
    return correlate.best_partner(_some_undated(spark, folder), settings).select("artifact_a_id", "artifact_b_id", "score", "strength_category", "correlation_type")


@query("best_partner", BEST_SQL.format(scope="a.case_id = b.case_id AND "))
def best_partner(spark, folder):
    """The best correlation of every event in its case; a third of the 'error' events lose their time."""
    return _best_rows(spark, folder, IN_CASE)


@query("best_partner_cross_case", BEST_SQL.format(scope=""))
def best_partner_cross_case(spark, folder):
    """The best correlation of every event over all cases; a third of the 'error' events lose their time."""
    return _best_rows(spark, folder, Settings(cross_case=True))


# Buckets of a case: each begins at the first event more than an hour after the last bucket's beginning.
PLACED = f"""
WITH RECURSIVE {ARTIFACT},
art AS (SELECT * REPLACE (CASE WHEN event_type = 'error' AND seq % 3 = 0 THEN NULL ELSE t END AS t) FROM artifact),
ts AS (SELECT DISTINCT case_id, t FROM art WHERE t IS NOT NULL),
anchors AS (
  SELECT case_id, min(t) AS a FROM ts GROUP BY 1
  UNION ALL
  SELECT n.case_id, (SELECT min(t) FROM ts WHERE ts.case_id = n.case_id AND ts.t > n.a + 3600000000) AS a
  FROM anchors n WHERE n.a IS NOT NULL),
starts AS (SELECT ts.case_id, ts.t, max(a) AS bucket FROM ts JOIN anchors ON anchors.case_id = ts.case_id AND a <= ts.t GROUP BY ALL),
placed AS (SELECT art.*, bucket FROM art LEFT JOIN starts ON art.case_id = starts.case_id AND art.t = starts.t),
"""


@query("best_partner_anchored", PLACED + f"""
pairs AS (
  SELECT a.id AS artifact_a_id, b.id AS artifact_b_id, abs(a.t - b.t) AS apart, {SIMILARITY}
  FROM placed a JOIN placed b ON a.case_id = b.case_id AND a.id <> b.id
   AND (a.entity_value = b.entity_value OR a.t IS NULL OR b.t IS NULL OR a.bucket = b.bucket)),
scored AS (SELECT *, {SCORE} AS score FROM pairs)
SELECT artifact_a_id, artifact_b_id, score,
  CASE WHEN score >= 0.70 THEN 'Strong' WHEN score >= 0.40 THEN 'Moderate' ELSE 'Weak' END AS strength_category,
  CASE WHEN s_entity > 0.8 THEN 'ENTITY_MATCH' WHEN s_time > 0.7 THEN 'TIME_PROXIMITY'
       WHEN s_source > 0.8 THEN 'COMMON_SOURCE' ELSE 'MULTI_FACTOR' END AS correlation_type
FROM scored WHERE score >= 0.15
QUALIFY row_number() OVER (PARTITION BY artifact_a_id ORDER BY score DESC, apart ASC NULLS LAST, artifact_b_id) = 1
""")
def best_partner_anchored(spark, folder):
    """The best correlation of every event among those of its entity, of its anchored bucket and without a time."""
    return _best_rows(spark, folder, Settings(cross_case=False, anchored=True))


@query("bucket_partner_counts", PLACED + """
counted AS (
  SELECT a.id, a.case_id, a.entity_value AS entity_key, a.t, a.bucket AS bucket_start,
    count(*) FILTER (WHERE a.entity_value = b.entity_value) - 1 AS n_same_entity,
    count(*) FILTER (WHERE a.t IS NULL OR b.t IS NULL OR a.bucket = b.bucket) - 1 AS n_in_bucket,
    count(*) FILTER (WHERE a.entity_value = b.entity_value AND (a.t IS NULL OR b.t IS NULL OR a.bucket = b.bucket)) - 1 AS n_both
  FROM placed a JOIN placed b ON a.case_id = b.case_id GROUP BY ALL)
SELECT *, n_same_entity + n_in_bucket - n_both AS n_partners FROM counted
""")
def bucket_partner_counts(spark, folder):
    """Candidates of every event by entity and by anchored bucket; a third of the 'error' events lose their time."""
    return correlate.bucket_partner_counts(_some_undated(spark, folder), Settings(cross_case=False, anchored=True))


# Events of one user are dealt over seven cases, so that an entity is seen in several.
SEVERAL = f"""
WITH {ARTIFACT},
art AS (SELECT * REPLACE (seq % 7 AS case_id) FROM artifact),
"""


def _several(spark, folder):
    return views.artifacts(spark, folder).withColumn("case_id", F.col("seq") % 7)


@query("other_case_sightings", SEVERAL + """
near AS (
  SELECT a.id, a.case_id, a.entity_value AS entity_key, a.t, max(b.t) FILTER (WHERE b.t <= a.t) AS before_t, min(b.t) FILTER (WHERE b.t >= a.t) AS after_t
  FROM art a LEFT JOIN art b ON a.entity_value = b.entity_value AND a.case_id <> b.case_id GROUP BY ALL)
SELECT n.id, n.case_id, n.entity_key, n.t, before_t, after_t, min(b.id) FILTER (WHERE b.t = before_t) AS before_id, min(b.id) FILTER (WHERE b.t = after_t) AS after_id
FROM near n LEFT JOIN art b ON n.entity_key = b.entity_value AND n.case_id <> b.case_id AND b.t IN (before_t, after_t) GROUP BY ALL
""")
def other_case_sightings(spark, folder):
    """The latest and the next sighting of every event's user in another case."""
    return correlate.other_case_sightings(_several(spark, folder))


@query("correlate_target_case", SEVERAL + f"""
near AS (
  SELECT a.id, a.case_id, a.entity_value AS entity_key, max(b.t) FILTER (WHERE b.t <= a.t) AS before_t, min(b.t) FILTER (WHERE b.t >= a.t) AS after_t
  FROM art a JOIN art b ON a.entity_value = b.entity_value AND (a.case_id = 3) <> (b.case_id = 3) GROUP BY ALL),
seen AS (
  SELECT n.id, min(b.id) AS other FROM near n JOIN art b ON n.entity_key = b.entity_value AND (n.case_id = 3) <> (b.case_id = 3) AND b.t = before_t GROUP BY 1
  UNION ALL
  SELECT n.id, min(b.id) FROM near n JOIN art b ON n.entity_key = b.entity_value AND (n.case_id = 3) <> (b.case_id = 3) AND b.t = after_t GROUP BY 1),
pairs AS (SELECT DISTINCT least(id, other) AS artifact_a_id, greatest(id, other) AS artifact_b_id FROM seen),
scored AS (
  SELECT *, {SCORE} AS score FROM (
    SELECT artifact_a_id, artifact_b_id, a.case_id, {SIMILARITY} FROM pairs JOIN art a ON a.id = artifact_a_id JOIN art b ON b.id = artifact_b_id))
SELECT case_id, artifact_a_id, artifact_b_id, score,
  CASE WHEN score >= 0.70 THEN 'Strong' WHEN score >= 0.40 THEN 'Moderate' ELSE 'Weak' END AS strength_category
FROM scored WHERE score >= 0.15
""")
def correlate_target_case(spark, folder):
    """Case 3 against all others: every event of either side with its nearest sightings on the other one."""
    rows = correlate.target_case_pairs(_several(spark, folder), 3, Settings(cross_case=True))
    return rows.select("case_id", "artifact_a_id", "artifact_b_id", "score", "strength_category")


@query("containing_values", f"""
WITH {ARTIFACT},
v AS (SELECT DISTINCT case_id, lower(trim(entity_value)) AS value FROM artifact)
SELECT a.case_id, a.value AS outer_value, b.value AS inner_value
FROM v a JOIN v b ON a.case_id = b.case_id AND a.value <> b.value
 AND contains(a.value, b.value) AND length(least(a.value, b.value)) >= 4
""")
def containing_values(spark, folder):
    return correlate.containing_values(views.artifacts(spark, folder))


@query("anchored_buckets", f"""
WITH RECURSIVE {ARTIFACT},
ts AS (SELECT DISTINCT case_id, t FROM artifact),
anchors AS (
  SELECT case_id, min(t) AS a FROM ts GROUP BY 1
  UNION ALL
  SELECT n.case_id, (SELECT min(t) FROM ts WHERE ts.case_id = n.case_id AND ts.t > n.a + 3600000000) AS a
  FROM anchors n WHERE n.a IS NOT NULL)
SELECT s.case_id, s.bucket_start, count(*) AS n_times
FROM (SELECT t.case_id, t.t, max(a.a) AS bucket_start
      FROM ts t JOIN anchors a ON a.case_id = t.case_id AND a.a <= t.t GROUP BY ALL) s
GROUP BY ALL
""")
def anchored_buckets(spark, folder):
    b = correlate.anchored_buckets(views.artifacts(spark, folder), IN_CASE)
    return b.groupBy("case_id", "bucket_start").agg(F.count("*").alias("n_times"))


@query("time_gaps", f"""
WITH {ARTIFACT}, ts AS (SELECT DISTINCT case_id, entity_value AS entity_key, t FROM artifact)
SELECT case_id, entity_key, t, lead(t) OVER (PARTITION BY case_id, entity_key ORDER BY t) AS next_t FROM ts
""")
def time_gaps(spark, folder):
    """Next sighting of the same entity."""
    a = views.artifacts(spark, folder).withColumnRenamed("entity_value", "entity_key")
    return scan.next_after(a, ["case_id", "entity_key"], "t", 0, "next_t")
