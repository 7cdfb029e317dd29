import csv
import json

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators import classify, dedup, integrity, rules
from sleuthframe.sources import readers, sinks


def frame(payload=b"GET / HTTP/1.1\r\nHost: example.com\r\n\r\n", ether=b"\x08\x00", proto=6):
    head = b"\x00" * 12 + ether + b"\x45" + b"\x00" * 8 + bytes([proto]) + b"\x00\x00" + bytes([192, 168, 1, 1, 192, 168, 1, 100])
    tcp = (1234).to_bytes(2, "big") + (80).to_bytes(2, "big") + b"\x00" * 8 + b"\x50" + b"\x00" * 7
    return head + tcp + payload


def test_packets(spark):
    rows = [(0, frame()), (1, frame(ether=b"\x86\xdd")), (2, b"short"), (3, frame()[:40]), (4, frame(proto=47)), (5, frame(b"\x16\x03"))]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in rows], "seq long, packet binary")
    got = {(r.seq, r.artifact_type): r for r in readers.packet_rows(df, ["seq"]).collect()}
    assert set(got) == {(0, "flow"), (0, "http_host"), (3, "flow"), (4, "flow"), (5, "flow")}
    assert got[0, "http_host"].value == "example.com" and got[0, "flow"].destination_port == 80
    assert got[4, "flow"].protocol == "IP-47" and got[4, "flow"].source_port is None


def test_dns_with_broken_labels(spark):
    def dns(name):
        head = b"\x00" * 12 + b"\x08\x00\x45" + b"\x00" * 8 + b"\x11\x00\x00" + bytes([10, 0, 0, 1, 10, 0, 0, 2])
        return bytearray(head + (5000).to_bytes(2, "big") + (53).to_bytes(2, "big") + b"\x00" * 4 + b"\x00" * 12 + name)
    names = [b"\x03www\x02ab\x00\x00\x01", b"\x50" + b"a" * 80 + b"\x00", b"\x05ab", b"\x00\x00"]
    df = spark.createDataFrame([(i, dns(n)) for i, n in enumerate(names)], "seq long, packet binary")
    got = [(r.seq, r.value) for r in readers.packet_rows(df, ["seq"]).filter("artifact_type = 'dns_query'").collect()]
    assert got == [(0, "www.ab")]


def test_firewall_csv_and_quarantine(spark, tmp_path):
    f = tmp_path / "fw.csv"
    f.write_text("timestamp,source_ip,destination_ip,protocol,action,port\n2026-10-04T08:12:01Z,10.0.0.1,10.0.0.2,TCP,deny,22\nx,y,z,t,ALLOW,notaport\n")
    good, bad = readers.firewall_csv(spark, str(f))
    r = good.collect()
    assert len(r) == 1 and r[0].value == "DENY" and str(r[0].timestamp) == "2026-10-04 08:12:01" and r[0].destination_port == 22
    assert [r.line for r in bad.collect()] == ["x,y,z,t,ALLOW,notaport"]


def test_evidence_files_and_content_rules(spark, tmp_path):
    cases = {"ok.png": (b"\x89PNG\r\n\x1a\n123", None), "fake.jpg": (b"\x89PNG\r\n\x1a\n123", "CONTENT_TYPE_MISMATCH"), "empty.txt": (b"", "EMPTY_FILE"),
             "nul.txt": (b"a\x00b", "MALFORMED_FILE"), "bad.pdf": (b"no pdf", "MALFORMED_FILE"), "good.json": (b'{"a": 1}', None),
             "broken.json": (b"{", "MALFORMED_FILE"), "latin.log": ("\u00e4".encode("latin-1"), "MALFORMED_FILE"), "ok.xml": (b"<a><b/></a>", None),
             "broken.xml": (b"<a><b></a>", "MALFORMED_FILE")}
    for name, (body, _) in cases.items():
        (tmp_path / name).write_bytes(body)
    empty = spark.createDataFrame([("empty.txt", "txt", bytearray())], "filename string, extension string, content binary")
    files = readers.evidence_files(spark, str(tmp_path)).select("filename", "extension", "content").unionByName(empty)
    got = {r.filename: r.fault for r in files.select("filename", rules.content_fault(F.col("content"), F.col("extension")).alias("fault")).collect()}
    assert got == {n: f for n, (_, f) in cases.items()}
    kept, put_aside = sinks.split_faulty(files.withColumn("fault", rules.content_fault(F.col("content"), F.col("extension"))))
    assert kept.count() == 3 and put_aside.count() == 7


@pytest.mark.parametrize("name, fault, ext", [("report.txt", None, "txt"), ("../x.txt", "INVALID_FILENAME", None), ("a\\b.txt", "INVALID_FILENAME", None),
                                              ("History", None, "db"), ("x.unknown", "UNSUPPORTED_FORMAT", None), ("", "INVALID_FILENAME", None),
                                              ("n" * 260 + ".txt", "INVALID_FILENAME", None)])
def test_names(spark, name, fault, ext):
    r = spark.createDataFrame([(name,)], "n string").select(rules.clean_name(F.col("n")).alias("c")).select("c.*").first()
    assert (r.fault, r.extension) == (fault, ext)


def test_bookmarks_and_logins(spark):
    tree = {"roots": {"bar": {"type": "folder", "children": [{"type": "url", "url": "https://a.example/x", "name": "A", "date_added": "13365000000000000"},
                                                              {"type": "folder", "children": [{"type": "url", "url": "https://b.example/"}]}]}, "v": 1}}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, "not json")], "id long, json string")
    got = sorted((r.id, r.url, r.domain, str(r.timestamp)) for r in readers.bookmark_tree(df, ["id"]).collect())
    assert got == [(1, "https://a.example/x", "a.example", "2024-07-09 12:00:00"), (1, "https://b.example/", "b.example", "None")]


def test_replace_touches_only_its_own_partitions(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = lambda *r: spark.createDataFrame(list(r), "case_id long, source string, title string")
    sinks.replace_source(rows((1, "net", "a"), (1, "risk", "b"), (2, "net", "c")), path)
    sinks.replace_source(rows((1, "net", "new")), path)
    got = sorted((r.case_id, r.source, r.title) for r in spark.read.parquet(path).collect())
    assert got == [(1, "net", "new"), (1, "risk", "b"), (2, "net", "c")]


def test_append_only_and_csv(spark, tmp_path):
    base = spark.createDataFrame([(1, 'say "hi", all', None), (2, "two\nlines", "x")], "case_id long, title string, note string")
    for _ in range(2):
        sinks.append_records(sinks.audit(base, "SEEN", F.col("title"), F.lit("2024-01-01").cast("timestamp")), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4
    sinks.csv_export(base.coalesce(1), str(tmp_path / "csv"))
    with open(next((tmp_path / "csv").glob("*.csv")), newline="") as f:
        rows = list(csv.reader(f))
    assert rows == [["case_id", "title", "note"], ["1", 'say "hi", all', ""], ["2", "two\nlines", "x"]]


def test_classifier_layouts(spark):
    texts = ["port", "dropbox", "hidden", "administrator", "sftp", "nothing at all"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.threat_category for r in classify.classify(df, F.col("text")).collect()}
    assert got == {"port": "Data Exfiltration", "dropbox": "Defense Evasion", "hidden": "Privilege Escalation", "administrator": "Clean / General",
                   "sftp": "Data Exfiltration", "nothing at all": "Clean / General"}
    by_topic = {r.text: r.threat_category for r in classify.classify(df, F.col("text"), layout="by_topic").collect()}
    assert by_topic["port"] == "Command & Control" and by_topic["administrator"] == "Privilege Escalation"


def test_digests_and_duplicates(spark):
    import hashlib
    df = dedup.with_digests(spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 2, "a")], "evidence_id long, case_id long, text string"), F.col("text"))
    assert df.first().sha256 == hashlib.sha256(b"a").hexdigest() and df.first().md5 == hashlib.md5(b"a").hexdigest()
    got = {r.evidence_id: (r.first_id, r.is_duplicate) for r in dedup.flag_duplicates(df, ["case_id", "sha256"], "evidence_id").collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False)}


def test_vulnerability_risk(spark):
    df = spark.createDataFrame([(9.8, 0.9, True), (5.0, None, False), (None, None, True)], "c double, e double, k boolean")
    assert [r[0] for r in df.select(rules.vulnerability_risk(F.col("c"), F.col("e"), F.col("k"))).collect()] == [100, 40, 20]


def test_reviews_do_not_cross_cases(spark):
    from sleuthframe.plans import analysis
    f = spark.createDataFrame([(1, 1), (2, 2)], "id long, case_id long")
    d = analysis.bulk_review(f, 1, "approved", F.lit("2024-01-01").cast("timestamp"), F.lit(1).cast("long"), spark.createDataFrame([(1,), (2,)], "id long"))
    assert [(r.id, r.review_status) for r in integrity.current_reviews(f, d).orderBy("id").collect()] == [(1, "approved"), (2, "pending")]
