"""Entities, event lines, indicators, software, names and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import text as tx
from ..operators import dedup, filters, rules
from ..sources import readers
from ..session import table
from . import query
from .aggregates import EVIDENCE


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pattern(pattern: str) -> str:
    return sql_text(pattern)


def _hits_sql(source: str, key: str) -> str:
    parts = []
    for n, (kind, pattern, confidence) in enumerate(tx.ENTITY_PATTERNS):
        whole = f"regexp_extract_all({source}.text, {sql_pattern(pattern)}, 0)"
        value = "m"
        zipped = f"SELECT {key}, unnest({whole}) AS m, NULL AS g FROM {source}"
        if kind in ("USERNAME", "PERSON"):
            zipped = (f"SELECT {key}, unnest({whole}) AS m, "
                      f"unnest(regexp_extract_all({source}.text, {sql_pattern(pattern)}, 1)) AS g FROM {source}")
            value = "CASE WHEN g <> '' THEN g ELSE m END"
        parts.append(f"SELECT {key}, {n} AS spec, '{kind}' AS artifact_type, trim({value}, E' \\t\\n\\r') AS value, "
                     f"{confidence}::DOUBLE AS confidence FROM ({zipped})")
    words = "|".join(tx.EVENT_WORDS)
    parts.append(f"SELECT {key}, {len(tx.ENTITY_PATTERNS)}, 'EVENT', line, 0.85 FROM ("
                 f"SELECT {key}, trim(unnest(string_split_regex({source}.text, '\\r\\n|[\\n\\r]')), E' \\t') AS line FROM {source}) "
                 f"WHERE regexp_matches(lower(line), '{words}') AND length(line) >= 10")
    hits = " UNION ALL ".join(parts)
    return f"""
hits AS ({hits}),
kept AS (SELECT * FROM hits WHERE length(value) >= CASE WHEN artifact_type IN ('USERNAME', 'HOSTNAME') THEN 5
    WHEN artifact_type = 'PERSON' THEN 3 ELSE 2 END
  AND NOT (artifact_type = 'DOMAIN' AND regexp_matches(value, '^' || {sql_pattern(tx.IP_V4)}))
  AND NOT (artifact_type IN ('HOSTNAME', 'USERNAME', 'PROCESS') AND regexp_full_match(value, '[0-9]+'))),
best AS (SELECT {key}, artifact_type, lower(value) AS entity, max(confidence) AS confidence, count(*) AS n_hits
  FROM kept GROUP BY 1, 2, 3)
"""


# Texts with the shapes the documents lack: paths, hosts, processes, commands, stamps, sessions, people, log lines.
# Each is filled from the columns of an event.
DRESS = """
  'Event ID ' || (4624 + event_id % 2) || ' on SRV-' || upper(substr(md5(user_id::VARCHAR), 1, 6)) || E'\\n' ||
  'user=svc_' || user_id || ' Owner: Jane Doe ran tool' || (event_id % 7) || '.exe from C:\\Temp\\job' || (event_id % 11) || E'\\\\run.txt\\n' ||
  '2024-01-0' || (event_id % 9 + 1) || 'T10:00:0' || (event_id % 10) || 'Z S-1-5-21-' || user_id || '-500 ' || E'\\n' ||
  'sudo kill -9 ' || event_id || E'\\n' || 'see http://host' || (event_id % 5) || '.example.com/a/' || event_id || ' and 10.0.' || (user_id % 256) || '.' || (event_id % 256)
  || E'\\nlogin failed for DOM\\\\user' || user_id
"""


def dressed(spark, folder):
    """events written as log text, so that every pattern has something to find."""
    e = table(spark, folder, "events", spread=True)
    s = lambda c: F.col(c).cast("string")
    m = lambda c, k: (F.col(c) % k).cast("string")
    body = F.concat(
        F.lit("Event ID "), (F.col("event_id") % 2 + 4624).cast("string"), F.lit(" on SRV-"),
        F.upper(F.substring(F.md5(s("user_id").cast("binary")), 1, 6)), F.lit("\n"),
        F.lit("user=svc_"), s("user_id"), F.lit(" Owner: Jane Doe ran tool"), m("event_id", 7),
        F.lit(".exe from C:\\Temp\\job"), m("event_id", 11), F.lit("\\run.txt\n"),
        F.lit("2024-01-0"), (F.col("event_id") % 9 + 1).cast("string"), F.lit("T10:00:0"), m("event_id", 10),
        F.lit("Z S-1-5-21-"), s("user_id"), F.lit("-500 \n"),
        F.lit("sudo kill -9 "), s("event_id"), F.lit("\n"),
        F.lit("see http://host"), m("event_id", 5), F.lit(".example.com/a/"), s("event_id"),
        F.lit(" and 10.0."), m("user_id", 256), F.lit("."), m("event_id", 256),
        F.lit("\nlogin failed for DOM\\user"), s("user_id"))
    return e.select("event_id", body.alias("text"))


def _counted(spark, docs, key):
    return tx.entity_values(docs, [key]).drop("n_hits")


@query("entities", f"""
WITH src AS (SELECT doc_id, text FROM documents), {_hits_sql("src", "doc_id")}
SELECT doc_id, artifact_type, entity, confidence FROM best
""")
def entities(spark, folder):
    return _counted(spark, table(spark, folder, "documents", spread=True), "doc_id")


@query("entities_log", f"""
WITH src AS (SELECT event_id, {DRESS} AS text FROM events), {_hits_sql("src", "event_id")}
SELECT event_id, artifact_type, entity, confidence FROM best
""")
def entities_log(spark, folder):
    return _counted(spark, dressed(spark, folder), "event_id")


def _offsets_sql(source: str, key: str) -> str:
    """Every hit with its offsets: lengths of the gaps and matches before it, summed."""
    parts = []
    for n, (kind, pattern, confidence) in enumerate(tx.ENTITY_PATTERNS):
        p, grouped = sql_pattern(pattern), kind in ("USERNAME", "PERSON")
        group = f"regexp_extract_all(text, {p}, 1)" if grouped else f"regexp_extract_all(text, {p}, 0)"
        rule = "person_prefix" if kind == "PERSON" else pattern.removeprefix("(?i)")[:30]
        extractor = "rule-based" if kind == "PERSON" else "regex-fallback"
        parts.append(
            f"SELECT {key}, text, {n} AS spec, '{kind}' AS artifact_type, {confidence}::DOUBLE AS confidence, '{extractor}' AS extractor, "
            f"{sql_text(rule)} AS rule, generate_subscripts(m, 1) AS i, unnest(m) AS matched, unnest(g) AS grp, unnest(gaps[1:len(m)]) AS gap "
            f"FROM (SELECT {key}, text, regexp_extract_all(text, {p}, 0) AS m, {group} AS g, string_split_regex(text, {p}) AS gaps "
            f"FROM {source}) WHERE len(m) > 0")
    hits = " UNION ALL ".join(parts)
    return f"""
hits AS ({hits}),
placed AS (SELECT *, CASE WHEN grp <> '' THEN grp ELSE matched END AS whole,
  sum(length(gap) + length(matched)) OVER (PARTITION BY {key}, spec ORDER BY i)::BIGINT AS end_char FROM hits),
stripped AS (SELECT *, trim(whole, E' \\t\\n\\r') AS value, end_char - length(whole) AS start_char FROM placed),
kept AS (SELECT * FROM stripped WHERE length(value) >= CASE WHEN artifact_type IN ('USERNAME', 'HOSTNAME') THEN 5
    WHEN artifact_type = 'PERSON' THEN 3 ELSE 2 END
  AND NOT (artifact_type = 'DOMAIN' AND regexp_matches(value, '^' || {sql_pattern(tx.IP_V4)}))
  AND NOT (artifact_type IN ('HOSTNAME', 'USERNAME', 'PROCESS') AND regexp_full_match(value, '[0-9]+'))),
shown AS (SELECT *, translate(substr(text, greatest(start_char - 40, 0) + 1, end_char + 40 - greatest(start_char - 40, 0)), E'\\r\\n', '  ') AS around,
  start_char > 40 OR end_char + 40 < length(text) AS clipped FROM kept)
"""


@query("entity_offsets", f"""
WITH src AS (SELECT doc_id, text FROM documents WHERE length(text) > 0), {_offsets_sql("src", "doc_id")}
SELECT doc_id, spec, artifact_type, value, confidence, extractor, CASE WHEN clipped THEN '...' || around || '...' ELSE around END AS context_snippet,
  start_char, end_char, rule FROM shown
""")
def entity_offsets(spark, folder):
    """Every hit in the documents with offsets and snippet."""
    return tx.entity_hits(table(spark, folder, "documents", spread=True), ["doc_id"])


@query("entities_pages", f"""
WITH src AS (SELECT page_id, coalesce(url, '') || E'\\n' || coalesce(html, '') AS text FROM pages), {_hits_sql("src", "page_id")}
SELECT page_id, artifact_type, entity, confidence FROM best
""")
def entities_pages(spark, folder):
    whole = F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit(""))).alias("text")
    return _counted(spark, table(spark, folder, "pages", spread=True).select("page_id", whole), "page_id")


@query("event_lines", f"""
WITH src AS (SELECT event_id, {DRESS} AS text FROM events),
lines AS (SELECT event_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r]')) AS line,
  unnest(range(1, len(string_split_regex(text, '\\r\\n|[\\n\\r]')) + 1)) AS line_number FROM src)
SELECT event_id, line_number, trim(line) AS value FROM lines
WHERE regexp_matches(lower(line), '{"|".join(tx.EVENT_WORDS)}') AND length(trim(line)) >= 10
""")
def event_lines(spark, folder):
    return tx.event_lines(dressed(spark, folder), ["event_id"]).select("event_id", "line_number", "value")


@query("text_assembled", """
SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars, sample FROM (
  SELECT doc_id, 'Filename: ' || source || '_' || doc_id || '.txt Extension: txt MIME: text/plain' || E'\\n' ||
    '{"kind":"text","lang":"' || lang || '"}' || E'\\n' || text AS t, substr(text, 1, 40) AS sample FROM documents)
""")
def text_assembled(spark, folder):
    ev = views.evidence(spark, folder)
    meta = F.to_json(F.struct(F.lit("text").alias("kind"), "lang"))
    t = tx.assembled_text(F.col("filename"), F.col("extension"), F.col("detected_mime"), meta, F.col("text"))
    return ev.select(F.col("evidence_id").alias("doc_id"), F.md5(t.cast("binary")).alias("text_md5"),
                     F.length(t).alias("n_chars"), readers.text_sample(F.col("text"), F.col("extension"), 40).alias("sample"))


LOG_TEXT = """
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' FW SRC 10.1.' || (user_id % 256) || '.7 to 192.168.' || (event_id % 256) || '.9 DPT=' ||
  (event_id % 6000) || ' ' || ['allow', 'DENY', 'drop', 'none'][(event_id % 4 + 1)::INT]
"""


def log_text(spark, folder):
    """One firewall log per user: its events as lines (a log is as long as its user is busy)."""
    e = table(spark, folder, "events", spread=True)
    action = F.element_at(F.array(*[F.lit(a) for a in ("allow", "DENY", "drop", "none")]), (F.col("event_id") % 4 + 1).cast("int"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" FW SRC 10.1."), (F.col("user_id") % 256).cast("string"),
                    F.lit(".7 to 192.168."), (F.col("event_id") % 256).cast("string"), F.lit(".9 DPT="),
                    (F.col("event_id") % 6000).cast("string"), F.lit(" "), action)
    return e.select("event_id", line.alias("text"))


@query("log_lines", f"""
WITH l AS (SELECT event_id, {LOG_TEXT} AS text FROM events)
SELECT event_id, 0::BIGINT AS line_no, regexp_extract_all(text, {sql_pattern(tx.IP_V4)})[1] AS source_ip,
  regexp_extract_all(text, {sql_pattern(tx.IP_V4)})[2] AS destination_ip, (event_id % 6000)::INT AS destination_port,
  nullif(upper(regexp_extract(text, '(?i)\\b(ALLOW|ACCEPT|DENY|DROP|BLOCK)\\b', 1)), '') AS value FROM l
""")
def log_lines(spark, folder):
    return readers.log_lines(log_text(spark, folder), ["event_id"]).select(
        "event_id", "line_no", "source_ip", "destination_ip", "destination_port", "value")


@query("log_users", """
SELECT event_id, unnest(list_filter([
   CASE WHEN event_type = 'click' THEN 'SYSTEM' ELSE 'user' || user_id END,
   CASE WHEN event_type = 'view' THEN '-' ELSE 'svc' || (user_id % 7) END], lambda x: x NOT IN ('SYSTEM', '-'))) AS "user"
FROM events
""")
def log_users(spark, folder):
    e = table(spark, folder, "events")
    data = F.create_map(
        F.lit("TargetUserName"), F.when(F.col("event_type") == "click", "SYSTEM").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))),
        F.lit("SubjectUserName"), F.when(F.col("event_type") == "view", "-").otherwise(F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string"))))
    return filters.log_users(e.select("event_id", data.alias("data"))).select("event_id", "user")


@query("iocs", f"""
WITH t AS (SELECT doc_id, replace(replace(source || '_' || doc_id || '.txt', '_', ' '), '-', ' ') || ' text/plain txt ' || text AS body,
  sha256(text) AS digest FROM documents)
SELECT doc_id, 'ip' AS indicator_type, unnest(list_distinct(regexp_extract_all(body, {sql_pattern(tx.IP_V4)}))) AS value FROM t
UNION ALL SELECT doc_id, 'url', regexp_replace(unnest(list_distinct(regexp_extract_all(body, {sql_pattern(tx.IOC_URL)}))), '[.,;)]+$', '') FROM t
UNION ALL SELECT doc_id, 'sha256', digest FROM t
""")
def iocs(spark, folder):
    ev = views.evidence(spark, folder)
    body = tx.searchable_text(F.col("filename"), F.col("detected_mime"), F.col("extension"), F.col("text"))
    return ev.select(F.col("evidence_id").alias("doc_id"),
                     F.inline(tx.indicators(body, F.sha2(F.col("text").cast("binary"), 256))))


@query("iocs_pages", f"""
WITH t AS (SELECT page_id, 'visit ' || coalesce(url, '') || ', then (' || coalesce(url, '') || E').\\n' || coalesce(html, '') AS body, md5(url) AS digest FROM pages)
SELECT page_id, 'ip' AS indicator_type, unnest(list_distinct(regexp_extract_all(body, {sql_pattern(tx.IP_V4)}))) AS value FROM t
UNION ALL SELECT page_id, 'url', regexp_replace(unnest(list_distinct(regexp_extract_all(body, {sql_pattern(tx.IOC_URL)}))), '[.,;)]+$', '') FROM t
UNION ALL SELECT page_id, 'sha256', digest FROM t
""")
def iocs_pages(spark, folder):
    """Indicators of the url, written as a log would, and of the whole page."""
    p = table(spark, folder, "pages", spread=True)
    url, html = (F.coalesce(c, F.lit("")) for c in ("url", "html"))
    body = F.concat(F.lit("visit "), url, F.lit(", then ("), url, F.lit(").\n"), html)
    return p.select("page_id", F.inline(tx.indicators(body, F.md5(F.col("url").cast("binary")))))


# Spellings of products used to write the parts table as software inventory lines.
PRODUCTS = ("Google  Chrome", "firefox", "Adobe Reader", "OpenSSL", "apache", "Tomcat", "java", "VLC", "7-Zip", "PuTTY", "notepad")


def inventory(spark, folder):
    """parts as inventory lines: 'Installed <product> version <size>.<key>'."""
    p = table(spark, folder, "part")
    name = F.element_at(F.array(*[F.lit(x) for x in PRODUCTS]), (F.col("p_partkey") % len(PRODUCTS) + 1).cast("int"))
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string"))
    text = F.concat(F.lit("Installed "), name, F.lit(" version "), version, F.lit("; again "), F.upper(name), F.lit("_v"), version)
    return p.select("p_partkey", text.alias("text"))


INVENTORY = f"""
inv AS (SELECT p_partkey, [{", ".join(sql_text(x) for x in PRODUCTS)}][(p_partkey % {len(PRODUCTS)} + 1)::INT] AS name,
  p_size || '.' || (p_partkey % 4) AS version FROM part),
software AS (SELECT p_partkey, regexp_replace(lower(name), '\\s+', ' ', 'g') AS product, version FROM inv WHERE name <> 'notepad')
"""


@query("software_versions", f"WITH {INVENTORY} SELECT p_partkey, product, version FROM software")
def software_versions(spark, folder):
    return inventory(spark, folder).select("p_partkey", F.inline(tx.software(F.col("text"))))


@query("hash_tokens", """
WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\\b[a-fA-F0-9]+\\b'), lambda w: lower(w)))) AS hash FROM documents)
SELECT doc_id, hash, CASE length(hash) WHEN 32 THEN 'MD5' WHEN 40 THEN 'SHA-1' ELSE 'SHA-256' END AS type, length(hash) AS length
FROM t WHERE length(hash) IN (32, 40, 64)
""")
def hash_tokens(spark, folder):
    return table(spark, folder, "documents", spread=True).select("doc_id", F.inline(tx.hash_tokens(F.col("text"))))


@query("hash_lookup", f"""
WITH {EVIDENCE},
long AS (SELECT evidence_id, 'MD5' AS algorithm, md5 AS digest FROM evidence UNION ALL
  SELECT evidence_id, 'SHA1', sha1 FROM evidence UNION ALL SELECT evidence_id, 'SHA256', sha256 FROM evidence),
asked AS (SELECT evidence_id % 50 AS question, unnest([md5, sha1, sha256, md5(sha1)]) AS hash FROM evidence)
SELECT a.question, a.hash, count(l.evidence_id) AS n_files, min(l.evidence_id) AS first_evidence_id
FROM (SELECT DISTINCT question, hash FROM asked) a LEFT JOIN long l ON l.digest = a.hash GROUP BY 1, 2
""")
def hash_lookup(spark, folder):
    """Questions that quote digests (of files and of nothing): which evidence do they name?"""
    ev = dedup.with_digests(views.evidence(spark, folder), F.col("text"))
    asked = ev.select((F.col("evidence_id") % 50).alias("question"),
                      F.concat_ws(", ", F.upper("md5"), "sha1", "sha256", F.md5(F.col("sha1").cast("binary"))).alias("text"))
    tokens = asked.select("question", F.inline(tx.hash_tokens(F.col("text")))).distinct()
    return dedup.known_digests(tokens, dedup.digests_long(ev)).select("question", "hash", "n_files", "first_evidence_id")


@query("url_host", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def url_host(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.url_host(F.col("url")).alias("host"))


@query("suffixes", """
WITH n AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || CASE page_id % 3 WHEN 0 THEN '.pdf.EXE' WHEN 1 THEN '.tar.gz' ELSE '' END AS name FROM pages),
s AS (SELECT page_id, name, regexp_extract_all(ltrim(name, '.'), '\\.[^.]*') AS suffixes FROM n)
SELECT page_id, name, list_aggregate(suffixes, 'string_agg', '') AS joined, len(suffixes) AS n_suffixes,
  len(suffixes) >= 2 AND lower(suffixes[-1]) IN ('.exe','.dll','.sys','.scr','.bat','.cmd','.ps1','.vbs') AS deceptive FROM s
""")
def suffixes(spark, folder):
    p = table(spark, folder, "pages")
    tail = F.when(F.col("page_id") % 3 == 0, ".pdf.EXE").when(F.col("page_id") % 3 == 1, ".tar.gz").otherwise("")
    name = F.concat(F.regexp_extract("url", "([^/]*)$", 1), tail)
    n = p.select("page_id", name.alias("name")).withColumn("s", tx.suffixes(F.col("name")))
    last = F.lower(F.ltrim(F.element_at("s", -1), F.lit(".")))
    deceptive = F.coalesce((F.size("s") >= 2) & last.isin(*rules.EXECUTABLE_SUFFIXES), F.lit(False))
    return n.select("page_id", "name", F.when(F.size("s") > 0, F.array_join("s", "")).alias("joined"),
                    F.size("s").cast("long").alias("n_suffixes"), deceptive.alias("deceptive"))


@query("uuid_valid", """
WITH u AS (SELECT doc_id, md5(text) AS h FROM documents),
v AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN substr(h, 2) WHEN doc_id % 3 = 0 THEN h WHEN doc_id % 3 = 1 THEN '{' || upper(h) || '}' ELSE 'urn:uuid:' || substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21) END AS id FROM u)
SELECT doc_id, id, doc_id % 7 <> 0 AS valid FROM v
""")
def uuid_valid(spark, folder):
    h = F.md5(F.col("text").cast("binary"))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    d = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.expr("substring(md5(cast(text as binary)), 2)")).when(F.col("doc_id") % 3 == 0, h)
                                                    .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("{"), F.upper(h), F.lit("}")))
                                                    .otherwise(F.concat(F.lit("urn:uuid:"), dashed)).alias("id"))
    return d.withColumn("valid", tx.is_uuid(F.col("id")))


@query("gps_decimal", """
SELECT o_orderkey, round(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * ((o_custkey % 180)::DOUBLE + (o_orderkey % 60)::DOUBLE / 60.0::DOUBLE
  + floor(o_totalprice)::BIGINT % 60 / 3600.0::DOUBLE), 6) AS degrees FROM orders
""")
def gps_decimal(spark, folder):
    o = table(spark, folder, "orders")
    parts = F.array((F.col("o_custkey") % 180).cast("double"), (F.col("o_orderkey") % 60).cast("double"),
                    (F.floor("o_totalprice") % 60).cast("double"))
    side = F.when(F.col("o_orderkey") % 2 == 0, "s").otherwise("N")
    return o.select("o_orderkey", F.round(tx.gps_decimal(parts, side), 6).alias("degrees"))


@query("json_text", """
SELECT event_id, '{"k":' || (props->>'$.k') || ',"type":"' || event_type || '"}' AS body FROM events
""")
def json_text(spark, folder):
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("body"))


@query("filename_rules", """
WITH n AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN source || '/' || doc_id || '.txt' WHEN 1 THEN 'r' || chr(233) || 'sum' || doc_id || '.PDF'
   WHEN 2 THEN 'Bookmarks' WHEN 3 THEN 'History' WHEN 4 THEN '..' WHEN 5 THEN 'x' || doc_id || '.xyz' WHEN 6 THEN ' report ' || doc_id || '.csv. '
   ELSE 'C:\\Temp\\' || doc_id || '.log' END AS name FROM documents)
SELECT doc_id,
  CASE doc_id % 8 WHEN 1 THEN 'r_sum' || doc_id || '.PDF' WHEN 2 THEN 'Bookmarks' WHEN 3 THEN 'History' WHEN 6 THEN 'report ' || doc_id || '.csv' END AS safe_name,
  CASE doc_id % 8 WHEN 1 THEN 'pdf' WHEN 2 THEN 'json' WHEN 3 THEN 'db' WHEN 6 THEN 'csv' END AS extension,
  CASE doc_id % 8 WHEN 0 THEN 'INVALID_FILENAME' WHEN 4 THEN 'INVALID_FILENAME' WHEN 7 THEN 'INVALID_FILENAME' WHEN 5 THEN 'UNSUPPORTED_FORMAT' END AS fault
FROM n
""")
def filename_rules(spark, folder):
    i = F.col("doc_id").cast("string")
    name = F.element_at(F.array(
        F.concat("source", F.lit("/"), i, F.lit(".txt")), F.concat(F.lit("r\u00e9sum"), i, F.lit(".PDF")), F.lit("Bookmarks"),
        F.lit("History"), F.lit(".."), F.concat(F.lit("x"), i, F.lit(".xyz")), F.concat(F.lit(" report "), i, F.lit(".csv. ")),
        F.concat(F.lit("C:\\Temp\\"), i, F.lit(".log"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", rules.clean_name(name).alias("c")).select("doc_id", "c.*")


@query("content_rules", """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/json'
  WHEN 4 THEN 'application/json' WHEN 5 THEN 'text/xml' WHEN 6 THEN 'application/pdf' ELSE 'text/plain' END AS detected_mime,
  doc_id % 8 = 1 AS mime_mismatch,
  CASE doc_id % 8 WHEN 1 THEN 'CONTENT_TYPE_MISMATCH' WHEN 2 THEN 'MALFORMED_FILE' WHEN 4 THEN 'MALFORMED_FILE' WHEN 6 THEN 'MALFORMED_FILE' END AS fault
FROM documents
""")
def content_rules(spark, folder):
    """documents as file contents: PNG, PNG under a wrong name, text with NUL, JSON, broken JSON, XML, PDF without magic, text."""
    body = F.col("text").cast("binary")
    raw = lambda h: F.unhex(F.lit(h))
    content = F.element_at(F.array(
        F.concat(raw("89504E470D0A1A0A"), body), F.concat(raw("89504E470D0A1A0A"), body), F.concat(body, raw("00")),
        F.to_json(F.struct("doc_id", "text")).cast("binary"), F.concat(F.lit("{").cast("binary"), body),
        F.concat(F.lit("<a>"), F.col("doc_id").cast("string"), F.lit("</a>")).cast("binary"), body, body),
        (F.col("doc_id") % 8 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(e) for e in ("png", "jpg", "txt", "json", "json", "xml", "pdf", "log")]), (F.col("doc_id") % 8 + 1).cast("int"))
    ext = F.when(ext == "log", "txt").otherwise(ext)
    d = table(spark, folder, "documents").select("doc_id", content.alias("content"), ext.alias("extension"))
    return d.select("doc_id", rules.file_type(F.col("content"), F.col("extension")).alias("k"),
                    rules.content_fault(F.col("content"), F.col("extension")).alias("fault")).select("doc_id", "k.*", "fault")
