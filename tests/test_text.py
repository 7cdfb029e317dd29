import re

import pytest
from pyspark.sql import functions as F

from sleuthframe.functions import text as tx, timeparse
from sleuthframe.session import table

PARAGRAPH = """User: John Smith logged in.
username=alice_admin from 192.168.1.100 visited http://malicious-c2.com/login and mail bob@corp.example.com
File C:\\Windows\\Temp\\evil.exe on DESKTOP-ABC1234 host evil-domain.com
2026-08-18T10:30:00Z S-1-5-21-1004336348-1177238915-682003330-512
powershell.exe -enc ZQBj
login failed for the account \u00e410.0.0.1"""


def py_hits(text):
    """The extraction rules on Python's own regex engine."""
    out = []
    for n, (kind, pattern, conf) in enumerate(tx.ENTITY_PATTERNS):
        for m in re.finditer(pattern, text):
            g = m.lastindex or 0
            value = m.group(g).strip()
            if kind == "PERSON":
                if len(value) < 3:
                    continue
            elif len(value) < 2 or (kind in ("USERNAME", "HOSTNAME") and len(value) < 5):
                continue
            if kind == "DOMAIN" and (re.match(tx.IP_V4, value) or "/" in value or "\\" in value):
                continue
            if kind in ("HOSTNAME", "USERNAME", "PROCESS") and value.isdigit():
                continue
            s, e = max(0, m.start(g) - 40), min(len(text), m.end(g) + 40)
            snippet = text[s:e].replace("\r", " ").replace("\n", " ")
            out.append((n, kind, value, m.start(g), m.end(g), f"...{snippet}..." if s > 0 or e < len(text) else snippet))
    return sorted(out)


def hits(df):
    return sorted((r.spec, r.artifact_type, r.value, r.start_char, r.end_char, r.context_snippet) for r in df.collect())


def test_hits_equal_python_re(spark):
    texts = [PARAGRAPH, "10.0.0.1 " * 700, "a/var/log/auth.log and /var/log/auth.log", "\u00e410.0.0.1 x", "", "sh x  \r\nsh y ",
             "user:" + "z" * 50 + " User:  Jane  Doe\n" * 3, "\\\\srv\\share\\f.txt DOM\\jack.b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = tx.entity_hits(df, ["id"])
    for i, t in enumerate(texts):
        assert hits(got.filter(F.col("id") == i)) == py_hits(t), t[:40]


def test_whole_documents_equal_python_re(spark):
    """All documents of a table, multilingual, with offsets and snippets."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    want = sorted((r.doc_id, *h) for r in docs.collect() for h in py_hits(r.text))
    got = sorted((r.doc_id, r.spec, r.artifact_type, r.value, r.start_char, r.end_char, r.context_snippet)
                 for r in tx.entity_hits(docs, ["doc_id"]).collect())
    assert got == want


def test_every_type_is_found(spark):
    df = spark.createDataFrame([(1, PARAGRAPH)], "id long, text string")
    kinds = {r.artifact_type for r in tx.extract_entities(df, ["id"]).collect()}
    assert kinds == {"PERSON", "USERNAME", "IP_ADDRESS", "DOMAIN", "URL", "EMAIL", "FILE_PATH", "PROCESS", "HOSTNAME",
                     "TIMESTAMP", "SESSION_ID", "COMMAND", "EVENT"}


def test_best_entity_keeps_first_of_equal_confidence(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.com then A.B@c.com")], "id long, text string")
    rows = {(r.artifact_type, r.value): r.start_char for r in tx.extract_entities(df, ["id"]).collect()}
    assert rows["EMAIL", "a.b@c.com"] == 5 and ("EMAIL", "A.B@c.com") not in rows


def test_values_are_those_of_the_full_entities(spark):
    texts = [PARAGRAPH, "", None, "mail a.b@c.com then A.B@c.com", "\u2003login failed here\u3000\nsudo ls \u00a0", "User: Jane Doe user=\u00e4b ip 10.0.0.1, 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    full = {(r.id, r.artifact_type, r.value.lower(), r.confidence) for r in tx.extract_entities(df, ["id"]).collect()}
    brief = [(r.id, r.artifact_type, r.entity, r.confidence) for r in tx.entity_values(df, ["id"]).collect()]
    assert set(brief) == full and len(brief) == len(full)


def test_strip_takes_unicode_white_space(spark):
    df = spark.createDataFrame([("\u3000\t a b\u2028\xa0\r\n",), ("",), (None,), ("\u00e4",)], "v string")
    assert [r[0] for r in df.select(tx.strip(F.col("v"))).collect()] == ["a b", "", None, "\u00e4"]


def test_scorer_comes_first(spark):
    df = spark.createDataFrame([(1, "User: Jane Doe")], "id long, text string")
    ner = lambda docs: docs.select("id", F.lit("PERSON").alias("artifact_type"), F.lit("jane doe").alias("value"), F.lit(0.88).alias("confidence"),
                                   F.lit("ner").alias("extractor"), F.lit("").alias("context_snippet"), F.lit(6).cast("long").alias("start_char"),
                                   F.lit(14).cast("long").alias("end_char"), F.lit("model").alias("rule"))
    person = [r for r in tx.extract_entities(df, ["id"], scorer=ner).collect() if r.artifact_type == "PERSON"]
    assert [r.extractor for r in person] == ["ner"]


def test_long_event_texts_have_no_line_cap(spark):
    df = spark.createDataFrame([(1, "\n".join(f"login failed number {i}" for i in range(500)))], "id long, text string")
    assert tx.event_lines(df, ["id"]).count() == 500


@pytest.mark.parametrize("name, want", [("invoice.pdf.exe", [".pdf", ".exe"]), (".bashrc", []), ("a.tar.gz", [".tar", ".gz"]), ("plain", [])])
def test_suffixes(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(tx.suffixes(F.col("n"))).first()[0] == want


def test_gps_and_uuid(spark):
    df = spark.createDataFrame([([40.0, 26.0, 46.0], "N"), ([40.0, 26.0, 46.0], "w"), ([1.0], "N")], "p array<double>, r string")
    got = [r[0] for r in df.select(tx.gps_decimal(F.col("p"), F.col("r"))).collect()]
    assert got[0] == pytest.approx(40.446111, abs=1e-6) and got[1] == -got[0] and got[2] is None


STAMPS = [
    ("2026-08-18T08:30:00Z", "UTC", "2026-08-18 08:30:00", "+00:00"), ("2026-08-18T14:00:00+05:30", "UTC", "2026-08-18 08:30:00", "+05:30"),
    ("2026-08-18 14:00:00", "UTC", "2026-08-18 14:00:00", "+00:00"), ("2026-08-18 14:00:00", "Asia/Kolkata", "2026-08-18 08:30:00", "+05:30"),
    ("malformed_text_input", "UTC", None, None), ("", "UTC", None, None), ("0", "UTC", None, None), ("1", "UTC", "1970-01-01 00:00:01", "+00:00"),
    ("1776500000", "UTC", "2026-04-18 08:13:20", "+00:00"), ("1776500000123", "UTC", "2026-04-18 08:13:20.123", "+00:00"),
    ("1776500000123456", "UTC", "2026-04-18 08:13:20.123456", "+00:00"), ("13365000000000000", "UTC", "2024-07-09 12:00:00", "+00:00"),
    ("20260818T103000", "UTC", "2026-08-18 10:30:00", "+00:00"), ("D:20240102030405-05'00'", "UTC", "2024-01-02 08:04:05", "-05:00"),
    ("2024:01:02 03:04:05", "IST", "2024-01-01 21:34:05", "+05:30"), ("05/Jan/2024:03:04:05", "UTC", "2024-01-05 03:04:05", "+00:00"),
    ("Jan  5 03:04:05", "UTC", "2024-01-05 03:04:05", "+00:00"), ("2024-02-30 00:00:00", "UTC", None, None), ("-5", "UTC", None, None),
]


@pytest.mark.parametrize("raw, zone, want, offset", STAMPS)
def test_timestamps(spark, raw, zone, want, offset):
    df = spark.createDataFrame([(raw,)], "raw string")
    r = timeparse.with_utc(df, "raw", zone, default_year=2024).select(F.col("utc").cast("string"), "original_timezone").first()
    assert tuple(r) == (want, offset)


def test_display(spark):
    df = spark.createDataFrame([("2026-08-18 08:30:00",), ("2026-01-18 08:30:00",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    show = lambda z: [tuple(r) for r in timeparse.with_display(df, "t", z).select("display_timestamp", "timezone_badge").collect()]
    assert show("Asia/Kolkata")[0] == ("2026-08-18 14:00:00 IST (+05:30)", "IST (+05:30)")
    assert [b for _, b in show("America/New_York")] == ["EDT (-04:00)", "EST (-05:00)", "MISSING"]
    assert show("+05:30")[0][1] == "UTC+05:30 (+05:30)" and show("nowhere")[0][1] == "UTC (+00:00)"
