"""Readers: evidence files, logs, event records, browser tables, bookmarks, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text as tx, timeparse
from ..functions.timeparse import let

# Words of firewall lines.
PORT_WORD = r"(?i)\b(?:DPT|DST|DESTINATION_PORT|dst_port)[=:\s]+(\d{1,5})\b"
ACTION_WORD = r"(?i)\b(ALLOW|ACCEPT|DENY|DROP|BLOCK)\b"
SAMPLED = ("txt", "csv", "log", "json", "xml", "md", "markdown")
FIREWALL_HEADER = "timestamp,source_ip,destination_ip,protocol,action,port"
FIREWALL_SCHEMA = ("timestamp string, source_ip string, destination_ip string, protocol string, action string, "
                   "port int, _corrupt_record string")


# ---- files ------------------------------------------------------------------

def evidence_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: name, extension, size, content.  Spark's file listing leaves out files of no bytes."""
    f = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return f.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"),
                    F.col("length").alias("file_size"), F.col("modificationTime").alias("ingested_at"), "content")


def decoded(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def text_sample(text: Column, extension: Column, size: int = 5000) -> Column:
    """Preview of a text file.  For display only: extraction and scoring read the whole text."""
    return F.when(F.lower(extension).isin(*SAMPLED), F.substring(text, 1, size))


# ---- firewall logs ------------------------------------------------------------

def log_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines with an address: the first is the source, the second the destination."""
    line = docs.select(*keys, F.posexplode(F.split(text, r"\r\n|[\n\r]", -1)).alias("line_no", "line"))
    line = line.withColumn("_ips", tx.find_all(F.col("line"), tx.IP_V4)).filter(F.size("_ips") > 0)
    empty = lambda c: F.nullif(c, F.lit(""))
    return line.select(
        *keys, F.col("line_no").cast("long").alias("line_no"), F.lit("firewall_log").alias("artifact_type"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.get("_ips", F.lit(0)).alias("source_ip"), F.get("_ips", F.lit(1)).alias("destination_ip"),
        F.lit(None).cast("int").alias("source_port"),
        empty(F.regexp_extract("line", tx.UNICODE + PORT_WORD, 1)).cast("int").alias("destination_port"),
        F.lit(None).cast("string").alias("protocol"),
        empty(F.upper(F.regexp_extract("line", tx.UNICODE + ACTION_WORD, 1))).alias("value"),
        F.col("line"))


def firewall_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed firewall rows, and the lines that do not fit the schema."""
    lines = spark.read.text(path).filter(F.col("value") != FIREWALL_HEADER)
    raw = lines.select("value", F.from_csv("value", F.lit(FIREWALL_SCHEMA), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("value", "r.*")
    good = raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record", "value")
    rows = timeparse.with_utc(good, "timestamp").select(
        F.lit("firewall_log").alias("artifact_type"), F.col("utc").alias("timestamp"), "original_timestamp",
        "original_timezone", "source_ip", "destination_ip", "protocol", F.col("port").alias("destination_port"),
        F.upper("action").alias("value"))
    return rows, raw.filter(F.col("_corrupt_record").isNotNull()).select(F.col("value").alias("line"))


# ---- Windows event records ----------------------------------------------------

EVENT_XML = """
System struct<Provider:struct<_Name:string>,EventID:string,TimeCreated:struct<_SystemTime:string>>,
EventData struct<Data:array<struct<_VALUE:string,_Name:string>>>, _corrupt_record string
"""


def event_records(rows: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """Event XML to event_id, provider, timestamp and a data map; ``malformed`` rows carry nothing else."""
    parsed = rows.withColumn("_e", F.from_xml(F.col(xml), EVENT_XML.replace("\n", " ").strip(),
                                              {"columnNameOfCorruptRecord": "_corrupt_record"}))
    data = F.coalesce(F.col("_e.EventData.Data"), F.array().cast("array<struct<_VALUE:string,_Name:string>>"))
    entries = F.transform(data, lambda d, i: F.struct(
        F.coalesce(F.nullif(d["_Name"], F.lit("")), F.concat(F.lit("field_"), i.cast("string"))).alias("key"),
        d["_VALUE"].alias("value")))
    last = F.filter(entries, lambda e: e.isNotNull())
    # a repeated field name keeps its last value
    unique = F.transform(F.array_distinct(F.transform(last, lambda e: e["key"])), lambda k: F.struct(
        k.alias("key"), F.element_at(F.filter(last, lambda e: e["key"] == k), -1)["value"].alias("value")))
    number = F.col("_e.System.EventID")
    bad = F.col("_e._corrupt_record").isNotNull() | F.col("_e").isNull()
    return parsed.select(
        *keys, bad.alias("malformed"),
        F.when(~bad, F.coalesce(F.when(number.rlike(r"^\d+$"), number.try_cast("int")), F.lit(0))).alias("event_id"),
        F.col("_e.System.Provider._Name").alias("provider"),
        F.col("_e.System.TimeCreated._SystemTime").alias("timestamp"),
        F.when(~bad, F.map_from_entries(unique)).alias("data"))


# ---- browser tables -----------------------------------------------------------

def _browser_row(browser: str, kind: str, url: Column, title: Column | None = None, stamp: Column | None = None,
                 **details: Column) -> list[Column]:
    null = F.lit(None).cast("string")
    names = ("visit_count", "target_path", "total_bytes", "danger_type", "name", "path", "secure")
    return [F.lit(browser).alias("browser"), F.lit(kind).alias("artifact_type"), url.alias("url"),
            tx.url_host(url).alias("domain"), (title if title is not None else null).alias("title"),
            (stamp if stamp is not None else null).cast("string").alias("_stamp"),
            *[(details[n].cast("string") if n in details else null).alias(n) for n in names]]


def _dated(rows: DataFrame) -> DataFrame:
    return timeparse.with_utc(rows, "_stamp", utc="timestamp").drop("_stamp", "original_timestamp", "original_timezone")


def chromium(urls: DataFrame, downloads: DataFrame, cookies: DataFrame, keys: list[str]) -> DataFrame:
    """Exported history, download and cookie tables as browser artifacts."""
    c = F.col
    return _dated(urls.select(*keys, *_browser_row("chromium", "history", c("url"), c("title"), c("last_visit_time"),
                                             visit_count=F.coalesce("visit_count", F.lit(0))))
            .unionByName(downloads.select(*keys, *_browser_row(
                "chromium", "download", c("tab_url"), None, c("start_time"), target_path=c("target_path"),
                total_bytes=c("total_bytes"), danger_type=c("danger_type"))))
            .unionByName(cookies.select(*keys, *_browser_row(
                "chromium", "cookie_metadata", F.concat(F.lit("https://"), c("host_key")), None, c("expires_utc"),
                name=c("name"), path=c("path"), secure=c("is_secure").cast("boolean")))))


def firefox(places: DataFrame, bookmarks: DataFrame, cookies: DataFrame, keys: list[str]) -> DataFrame:
    """Exported places, bookmarks (joined to their place) and cookies as browser artifacts."""
    c = F.col
    marked = bookmarks.filter("fk IS NOT NULL").join(
        places.select(*keys, F.col("id").alias("fk"), F.col("url").alias("_url")), [*keys, "fk"])
    return _dated(places.select(*keys, *_browser_row("firefox", "history", c("url"), c("title"), c("last_visit_date"),
                                               visit_count=F.coalesce("visit_count", F.lit(0))))
            .unionByName(marked.select(*keys, *_browser_row("firefox", "bookmark", c("_url"), c("title"), c("dateAdded"))))
            .unionByName(cookies.select(*keys, *_browser_row(
                "firefox", "cookie_metadata", F.concat(F.lit("https://"), c("host")), None, c("expiry"),
                name=c("name"), path=c("path"), secure=c("isSecure").cast("boolean")))))


def bookmark_tree(docs: DataFrame, keys: list[str], body: str = "json") -> DataFrame:
    """Every url node of a bookmark JSON at any depth.

    Each step opens all objects and arrays of the current level, so the number of
    steps is the depth of the deepest tree, not the number of nodes.
    """
    from ..session import durable
    level = durable(docs.select(*keys, F.expr(f"try_variant_get(try_parse_json({body}), '$.roots', 'variant')").alias("node"))
                    .filter("node IS NOT NULL"))
    def urls(nodes):
        text = lambda f: F.expr(f"try_variant_get(node, '$.{f}', 'string')")
        return nodes.select(*keys, text("type").alias("t"), text("url").alias("url"), text("name").alias("title"),
                            text("date_added").alias("stamp")).filter("t = 'url' AND url <> ''").drop("t")

    found = urls(level)
    while not level.isEmpty():
        level = docs.sparkSession.sql(
            f"SELECT {', '.join(keys)}, e.value AS node FROM {{nodes}}, LATERAL variant_explode_outer(node) AS e "
            "WHERE e.value IS NOT NULL AND schema_of_variant(e.value) RLIKE '^(OBJECT|ARRAY)'", nodes=level)
        level = durable(level)
        found = found.unionByName(urls(level))
    return _dated(found.select(*keys, *_browser_row("chromium", "bookmark", F.col("url"), F.col("title"), F.col("stamp"))))


def saved_logins(docs: DataFrame, keys: list[str], body: str = "json") -> DataFrame:
    """Saved-login metadata (field names and use counts, never secrets)."""
    schema = ("logins array<struct<hostname:string,timeLastUsed:bigint,usernameField:string,passwordField:string,"
              "timesUsed:bigint>>")
    one = docs.select(*keys, F.explode(F.from_json(body, schema)["logins"]).alias("l")).select(*keys, "l.*")
    return _dated(one.select(*keys, *_browser_row("firefox", "saved_password_metadata", F.col("hostname"), None,
                                           F.col("timeLastUsed")),
                      F.col("usernameField").alias("username_field"), F.col("passwordField").alias("password_field"),
                      F.coalesce("timesUsed", F.lit(0)).alias("times_used")))


# ---- packets ------------------------------------------------------------------

HTTP_VERBS = ("GET ", "POST ", "HEAD ", "PUT ", "CONNECT ", "DELETE ")


def _int(packet: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(packet.substr(at + 1, F.lit(size))), 16, 10).cast("int")


def decode_packet(packet: Column) -> Column:
    """Rows of one Ethernet/IPv4 frame as an array of structs; NULL for anything else."""
    size = F.octet_length(packet)
    byte = lambda at: _int(packet, at, 1)
    address = lambda at: F.concat_ws(".", *[byte(at + i).cast("string") for i in range(4)])
    rest = lambda at: packet.substr(at + 1, F.greatest(size - at, F.lit(0)))

    def ip_header(o):
        return F.when((_int(packet, o - 2, 2) == 0x0800) & (size >= o + 20), let(byte(o), lambda first: let(
            (first % 16) * 4, lambda length: F.when(
                (F.floor(first / 16) == 4) & (length >= 20) & (size >= o + length),
                let(F.struct(byte(o + 9).alias("proto"), address(o + 12).alias("source_ip"),
                             address(o + 16).alias("destination_ip"), (o + length).alias("at")), transport)))))

    def transport(h):
        ported = h["proto"].isin(6, 17) & (size >= h["at"] + 4)
        protocol = (F.when(ported & (h["proto"] == 6), "TCP").when(ported, "UDP").when(h["proto"] == 1, "ICMP")
                    .otherwise(F.concat(F.lit("IP-"), h["proto"].cast("string"))))
        return let(F.struct(h["source_ip"].alias("source_ip"), h["destination_ip"].alias("destination_ip"),
                            F.when(ported, _int(packet, h["at"], 2)).alias("source_port"),
                            F.when(ported, _int(packet, h["at"] + 2, 2)).alias("destination_port"),
                            protocol.alias("protocol"), h["at"].alias("at")), payload)

    def payload(t):
        at = t["at"]
        dns = (t["protocol"] == "UDP") & (size >= at + 8) & ((t["source_port"] == 53) | (t["destination_port"] == 53))
        tcp = (t["protocol"] == "TCP") & (size >= at + 20)
        head = F.when(tcp, F.floor(byte(at + 12) / 16).cast("int") * 4)
        name = F.when(dns, let(F.hex(rest(at + 8)), _dns_name))
        host = let(head, lambda n: F.when(n >= 20, _http_host(rest(at + n))))
        row = lambda kind, value: F.struct(
            F.lit(kind).alias("artifact_type"),
            *[t[c].alias(c) for c in ("source_ip", "destination_ip", "source_port", "destination_port", "protocol")],
            value.cast("string").alias("value"))
        return let(F.struct(name.alias("name"), host.alias("host")), lambda v: F.array_compact(F.array(
            row("flow", F.lit(None)), F.when(v["name"].isNotNull(), row("dns_query", v["name"])),
            F.when(v["host"].isNotNull(), row("http_host", v["host"])))))

    tagged = (_int(packet, F.lit(12), 2) == 0x8100) & (size >= 18)
    return F.when(size >= 14, let(F.when(tagged, 18).otherwise(14), ip_header))


def packet_rows(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Ethernet/IPv4/TCP/UDP packets (column ``packet``) to flow, dns_query and http_host rows."""
    return packets.select(*keys, F.explode(decode_packet(F.col("packet"))).alias("r")).select(*keys, "r.*")


def _dns_name(payload_hex: Column) -> Column:
    """Labels of the first question: length byte, label, ..., zero.  A name has at most 127 labels."""
    labels = payload_hex.substr(25, 600)
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(128)),
        F.struct(labels.alias("rest"), F.lit("").alias("name"), F.lit(None).cast("boolean").alias("done")),
        lambda acc, _: F.when(acc["done"].isNotNull(), acc).otherwise(_dns_step(acc)))
    return F.when(F.length(payload_hex) >= 26, F.when(state["done"] & (state["name"] != ""), state["name"]))


def _dns_step(acc: Column) -> Column:
    n = F.conv(acc["rest"].substr(1, 2), 16, 10).cast("int")
    whole = F.length(acc["rest"]) >= (n + 1) * 2 + 2
    label = F.unhex(acc["rest"].substr(F.lit(3), n * 2)).cast("string")
    name = F.when(acc["name"] == "", label).otherwise(F.concat(acc["name"], F.lit("."), label))
    ended = F.length(acc["rest"]) < 2
    return (F.when(ended, F.struct(acc["rest"].alias("rest"), acc["name"].alias("name"), F.lit(False).alias("done")))
            .when(n == 0, F.struct(acc["rest"].alias("rest"), acc["name"].alias("name"), F.lit(True).alias("done")))
            .when((n > 63) | ~whole, F.struct(acc["rest"].alias("rest"), F.lit("").alias("name"), F.lit(False).alias("done")))
            .otherwise(F.struct(acc["rest"].substr((n + 1) * 2 + 1, F.length(acc["rest"])).alias("rest"), name.alias("name"),
                                F.lit(None).cast("boolean").alias("done"))))


def _http_host(payload: Column) -> Column:
    text = F.make_valid_utf8(payload.cast("string"))
    verb = F.lit(False)
    for v in HTTP_VERBS:
        verb = verb | F.startswith(text, F.lit(v))
    host = F.regexp_extract(text, r"(?i)\r?\nHost:\s*([^\r\n]+)", 1)
    return F.when(verb, F.nullif(F.trim(host), F.lit("")))
