"""Decoders of packets, event XML, browser tables, bookmark trees and logins, fed from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..sources import readers
from ..session import table
from . import query


# ---- packets ------------------------------------------------------------------

def packets(spark, folder):
    """lineitem as captured frames.

    Returnflag A is TCP with an HTTP request, N is UDP (a DNS question when the port
    is 53), R is ICMP.  Every eighth frame carries a VLAN tag, every 31st is cut short.
    """
    f = views.flows(spark, folder, spread=True)
    raw = lambda h: F.unhex(F.lit(h))
    num = lambda c, size: F.unhex(F.lpad(F.hex(c.cast("long")), size * 2, "0"))
    addr = lambda c: F.concat(*[num(F.split(c, r"\.")[i].cast("int"), 1) for i in range(4)])
    k, line = F.col("order_key"), F.col("line_no")
    tag = F.when(k % 8 == 0, raw("81000064")).otherwise(raw(""))
    proto = F.when(F.col("protocol") == "TCP", 6).when(F.col("protocol") == "UDP", 17).otherwise(1)
    ports = F.concat(num(F.col("source_port"), 2), num(F.col("destination_port"), 2))
    host = F.concat(F.lit("h"), (k % 1000).cast("string"), F.lit(".example.com"))
    label = F.concat(F.lit("q"), F.lpad((k % 1000).cast("string"), 3, "0"))
    http = F.concat(F.lit("GET /"), line.cast("string"), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")).cast("binary")
    dns = F.concat(raw("000101000001000000000000"), raw("04"), label.cast("binary"), raw("07"), F.lit("example").cast("binary"),
                   raw("03"), F.lit("com").cast("binary"), raw("0000010001"))
    body = (F.when(F.col("protocol") == "TCP", F.concat(ports, raw("0000000000000000"), raw("5018"), raw("000000000000"), http))
            .when(F.col("protocol") == "UDP", F.concat(ports, raw("00000000"), dns)).otherwise(raw("0800")))
    frame = F.concat(raw("020000000001020000000002"), tag, raw("0800"), raw("4500000000000000"), raw("40"), num(proto, 1),
                     raw("0000"), addr(F.col("source_ip")), addr(F.col("destination_ip")), body)
    frame = F.when(k % 31 == 0, F.substring(frame, 1, 20)).otherwise(frame)
    return f.select(k.alias("order_key"), line.alias("line_no"), F.col("source_port").alias("sent_port"), frame.alias("packet"))


@query("packets", """
WITH f AS (SELECT l_orderkey AS order_key, l_linenumber AS line_no,
  '10.' || ((l_suppkey >> 16) % 256) || '.' || ((l_suppkey >> 8) % 256) || '.' || (l_suppkey % 256) AS source_ip,
  '172.' || ((l_partkey >> 16) % 256) || '.' || ((l_partkey >> 8) % 256) || '.' || (l_partkey % 256) AS destination_ip,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity::INT + 1024 END AS source_port,
  CASE WHEN l_returnflag <> 'R' THEN [80, 443, 53, 22, 3389, 4444, 8080, 1337, 31337, 25][(l_partkey % 10 + 1)::INT] END AS destination_port,
  CASE l_returnflag WHEN 'A' THEN 'TCP' WHEN 'N' THEN 'UDP' ELSE 'ICMP' END AS protocol FROM lineitem WHERE l_orderkey % 31 <> 0)
SELECT order_key, line_no, 'flow' AS artifact_type, source_ip, destination_ip, source_port, destination_port, protocol, NULL AS value FROM f
UNION ALL SELECT order_key, line_no, 'http_host', source_ip, destination_ip, source_port, destination_port, protocol, 'h' || (order_key % 1000) || '.example.com' FROM f WHERE protocol = 'TCP'
UNION ALL SELECT order_key, line_no, 'dns_query', source_ip, destination_ip, source_port, destination_port, protocol, 'q' || lpad((order_key % 1000)::VARCHAR, 3, '0') || '.example.com' FROM f WHERE protocol = 'UDP' AND destination_port = 53
""")
def packet_rows(spark, folder):
    return readers.packet_rows(packets(spark, folder), ["order_key", "line_no"])


# ---- event XML ----------------------------------------------------------------

def event_xml(spark, folder):
    """events as Windows event XML; every 50th is broken off, every 7th has a number that is none."""
    e = table(spark, folder, "events", spread=True)
    i = lambda c: F.col(c).cast("string")
    code = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("event_id") % 4 + 4624).cast("string"))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="'), "event_type",
        F.lit('"/><EventID>'), code, F.lit('</EventID><TimeCreated SystemTime="'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"/></System><EventData><Data Name="TargetUserName">user'),
        i("user_id"), F.lit("</Data><Data>"), F.col("value").cast("decimal(10,2)").cast("string"), F.lit("</Data></EventData></Event>"))
    xml = F.when(F.col("event_id") % 50 == 0, F.substring(xml, 1, 90)).otherwise(xml)
    return e.select("event_id", xml.alias("xml"))


@query("event_records", """
SELECT event_id AS record, event_id % 50 = 0 AS malformed,
  CASE WHEN event_id % 50 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 4 + 4624)::INT END END AS event_id,
  CASE WHEN event_id % 50 <> 0 THEN event_type END AS provider, CASE WHEN event_id % 50 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS timestamp,
  CASE WHEN event_id % 50 <> 0 THEN 'user' || user_id END AS target_user, CASE WHEN event_id % 50 <> 0 THEN value::DECIMAL(10, 2)::VARCHAR END AS second_field
FROM events
""")
def event_records(spark, folder):
    x = event_xml(spark, folder).withColumnRenamed("event_id", "record")
    r = readers.event_records(x, ["record"])
    return r.select("record", "malformed", "event_id", "provider", "timestamp", F.col("data")["TargetUserName"].alias("target_user"),
                    F.col("data")["field_1"].alias("second_field"))


# ---- browser tables -----------------------------------------------------------

@query("chromium", """
WITH p AS (SELECT page_id % 20 AS profile, * FROM pages),
n AS (SELECT event_id, user_id % 20 AS profile, ts, value, event_type FROM events)
SELECT profile, 'history' AS artifact_type, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain, epoch_us(make_timestamp(1704067200000000 + page_id * 1000000)) AS t, NULL AS target_path FROM p
UNION ALL SELECT profile, 'download', 'https://dl.example.com/' || event_id, 'dl.example.com', epoch_us(date_trunc('second', ts)), 'C:\\dl\\' || event_id || '.exe' FROM n WHERE event_type = 'purchase'
UNION ALL SELECT profile, 'cookie_metadata', 'https://shop' || (event_id % 50) || '.example.com', 'shop' || (event_id % 50) || '.example.com', epoch_us(date_trunc('second', ts)), NULL FROM n WHERE event_type = 'view'
""")
def chromium(spark, folder):
    p, e = table(spark, folder, "pages"), table(spark, folder, "events")
    since_1601 = lambda seconds: ((seconds + 11_644_473_600) * 1_000_000).cast("string")
    urls = p.select((F.col("page_id") % 20).alias("profile"), "url", F.lit(None).cast("string").alias("title"),
                    since_1601(F.col("page_id") + 1_704_067_200).alias("last_visit_time"), F.lit(1).alias("visit_count"))
    e = e.withColumns({"profile": F.col("user_id") % 20, "at": since_1601(F.unix_seconds("ts")), "i": F.col("event_id").cast("string")})
    downloads = e.filter("event_type = 'purchase'").select(
        "profile", F.concat(F.lit("C:\\dl\\"), "i", F.lit(".exe")).alias("target_path"),
        F.concat(F.lit("https://dl.example.com/"), "i").alias("tab_url"), F.col("at").alias("start_time"),
        F.lit(1).alias("total_bytes"), F.lit(0).alias("danger_type"))
    cookies = e.filter("event_type = 'view'").select(
        "profile", F.concat(F.lit("shop"), (F.col("event_id") % 50).cast("string"), F.lit(".example.com")).alias("host_key"),
        F.lit("sid").alias("name"), F.lit("/").alias("path"), F.col("at").alias("expires_utc"), F.lit(1).alias("is_secure"))
    return readers.chromium(urls, downloads, cookies, ["profile"]).select(
        "profile", "artifact_type", "url", "domain", F.unix_micros("timestamp").alias("t"), "target_path")


@query("firefox", """
WITH p AS (SELECT page_id % 20 AS profile, * FROM pages)
SELECT profile, 'history' AS artifact_type, url, epoch_us(make_timestamp(1704067200000000 + page_id * 1000)) AS t FROM p
UNION ALL SELECT p.profile, 'bookmark', p.url, epoch_us(ts) FROM events JOIN p ON user_id % 20 = p.profile AND p.page_id = event_id % 250 WHERE event_type = 'click'
UNION ALL SELECT user_id % 20, 'cookie_metadata', 'https://c' || (event_id % 9) || '.example.org', epoch_us(date_trunc('second', ts)) FROM events WHERE event_type = 'view'
""")
def firefox(spark, folder):
    """Bookmarks point at places of their own profile; dangling ones fall away in the join."""
    p, e = table(spark, folder, "pages"), table(spark, folder, "events")
    places = p.select((F.col("page_id") % 20).alias("profile"), F.col("page_id").alias("id"), "url", F.lit(None).cast("string").alias("title"),
                      (F.col("page_id") * 1000 + 1_704_067_200_000_000).alias("last_visit_date"), F.lit(1).alias("visit_count"))
    e = e.withColumn("profile", F.col("user_id") % 20)
    marks = e.filter("event_type = 'click'").select("profile", (F.col("event_id") % 250).alias("fk"), F.lit("b").alias("title"),
                                                    F.unix_micros("ts").alias("dateAdded"))
    cookies = e.filter("event_type = 'view'").select(
        "profile", F.concat(F.lit("c"), (F.col("event_id") % 9).cast("string"), F.lit(".example.org")).alias("host"),
        F.lit("sid").alias("name"), F.lit("/").alias("path"), F.unix_seconds("ts").alias("expiry"), F.lit(0).alias("isSecure"))
    return readers.firefox(places, marks, cookies, ["profile"]).select(
        "profile", "artifact_type", "url", F.unix_micros("timestamp").alias("t"))


@query("bookmarks", """
SELECT page_id, url, epoch_us(make_timestamp(1704067200000000 + page_id * 1000000)) AS t FROM pages
UNION ALL SELECT page_id, url || '/deep', NULL FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'https://other.example.com/' || page_id, NULL FROM pages
""")
def bookmarks(spark, folder):
    """Each page as a bookmark file: one link at the top, one in a folder, one four folders down in every second file."""
    p = table(spark, folder, "pages")
    q = lambda c: F.to_json(F.struct(c.alias("v")))
    text = lambda c: F.substring(q(c), F.lit(6), F.length(q(c)) - 6)        # the JSON string alone
    i = F.col("page_id").cast("string")
    leaf = lambda url, more: F.concat(F.lit('{"type":"url","name":"x","url":'), text(url), more, F.lit("}"))
    top = leaf(F.col("url"), F.concat(F.lit(',"date_added":"'), ((F.col("page_id") + 1_704_067_200 + 11_644_473_600) * 1_000_000).cast("string"), F.lit('"')))
    other = leaf(F.concat(F.lit("https://other.example.com/"), i), F.lit(""))
    deep = leaf(F.concat("url", F.lit("/deep")), F.lit(""))
    nested = F.when(F.col("page_id") % 2 == 0, F.concat(
        F.lit('{"type":"folder","children":[{"type":"folder","children":[{"type":"folder","children":['), deep, F.lit("]}]}]}"))).otherwise(F.lit('{"type":"folder","children":[]}'))
    doc = F.concat(F.lit('{"roots":{"bar":{"type":"folder","children":['), top, F.lit(","), nested, F.lit(']},"other":{"type":"folder","children":['), other, F.lit("]}}}"))
    out = readers.bookmark_tree(p.select("page_id", doc.alias("json")), ["page_id"])
    return out.select("page_id", "url", F.unix_micros("timestamp").alias("t"))


@query("saved_logins", """
SELECT conv_id, 'https://login' || turn || '.example.com' AS url, 'login' || turn || '.example.com' AS domain, 1704067200000000 + turn * 1000000 AS t, turn AS times_used FROM conversations
""")
def saved_logins(spark, folder):
    """Each conversation as a login file, each turn as one saved login."""
    c = table(spark, folder, "conversations")
    n = F.col("turn").cast("string")
    one = F.struct(F.concat(F.lit("https://login"), n, F.lit(".example.com")).alias("hostname"),
                   ((F.col("turn") + 1_704_067_200) * 1000).alias("timeLastUsed"), F.lit("u").alias("usernameField"),
                   F.lit("p").alias("passwordField"), F.col("turn").alias("timesUsed"))
    docs = c.select("conv_id", F.to_json(F.struct(F.array(one).alias("logins"))).alias("json"))
    return readers.saved_logins(docs, ["conv_id"]).select("conv_id", "url", "domain", F.unix_micros("timestamp").alias("t"), "times_used")
