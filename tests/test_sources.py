import gzip
import json
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from trafficjobs.plans import catalog
from trafficjobs.sources import captures, readers, sinks


def eth(kind, body, vlan=False):
    return b"\0" * 12 + (struct.pack(">HH", 0x8100, 5) if vlan else b"") + struct.pack(">H", kind) + body


def tcp(n, flags=0x18):
    return struct.pack(">HHIIBBHHH", 51000, 443, 1, 1, 5 << 4, flags, 100, 0, 0) + b"x" * n


def ipv4(n):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + n, 1, 0, 64, 6, 0, bytes([10, 0, 0, 2]), bytes([203, 0, 113, 10])) + tcp(n)


def ipv6(n, extension=False):
    more = struct.pack(">BB6x", 6, 0) if extension else b""
    return struct.pack(">IHBB16s16s", 6 << 28, 20 + n + len(more), 0 if extension else 6, 64, b"\0" * 15 + b"\1", b"\0" * 15 + b"\2") + more + tcp(n)


def pcap(frames):
    return b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 5, 250000 + i, len(f), len(f)) + f for i, f in enumerate(frames))


def block(kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def pcapng(frames, received=None, dropped=None):
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for i, f in enumerate(frames):
        out += block(6, struct.pack("<IIIII", 0, 0, 7_000_000 + i, len(f), len(f)) + f)
    if received is not None:
        out += block(5, struct.pack("<III", 0, 0, 0) + struct.pack("<HHQHHQHH", 4, 8, received, 5, 8, dropped, 0, 0))
    return out


def test_captures(spark, tmp_path):
    frames = [eth(0x0800, ipv4(10), vlan=True), eth(0x86DD, ipv6(5)), eth(0x86DD, ipv6(5, True)), eth(0x0806, b"arp"), eth(0x0800, ipv4(3)[:25])]
    for name, data in {"a.pcap": pcap(frames), "b.pcapng": pcapng(frames[:2], 1000, 2), "c.pcap": b"not-a-capture", "d.pcapng": pcapng([])}.items():
        (tmp_path / name).write_bytes(data)
    packets = captures.read_packets(spark, str(tmp_path)).collect()
    by = lambda n: [(p.src_ip, p.src_port, p.ip_length, p.ts_us) for p in packets if p.path.endswith(n)]
    assert by("a.pcap") == [("10.0.0.2", 51000, 64, 5_250_000), ("::1", 51000, 59, 5_250_001), ("::1", 51000, 59, 5_250_002)]
    assert [x[2] for x in by("b.pcapng")] == [64, 59] and by("b.pcapng")[0][3] == 7_000_000
    stats = {r.path.rpartition("/")[2]: r for r in captures.read_stats(spark, str(tmp_path)).collect()}
    assert (stats["a.pcap"].total_packets, stats["a.pcap"].tcp_packets, stats["a.pcap"].skipped_packets, stats["a.pcap"].drop_status) == (5, 3, 1, "unknown")
    assert (stats["b.pcapng"].received, stats["b.pcapng"].dropped, stats["b.pcapng"].drop_status) == (1000, 2, "reported")
    assert stats["c.pcap"].error and stats["d.pcapng"].first_us is None
    assert len({r.signature for r in captures.file_signatures(spark, str(tmp_path)).collect()}) == 4
    closed = readers.closed_captures(spark, str(tmp_path), 5, now_us=0).collect()
    assert len(closed) == 3


def test_flow_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text("#sep\n1.5\tC1\t10.0.0.1\t5\t10.0.0.2\t443\t60,-60\t0.0,0.2\n1\tC2\ta\t1\tb\t2\t-\t(empty)\nshort\trow\n")
    rows = readers.flow_logs(spark, str(tmp_path)).collect()
    assert [(r.uid, r.sizes, r.times, r.source) for r in rows] == [("C1", [60, -60], [0.0, 0.2], "x.log"), ("C2", None, None, "x.log")]


def test_ppi_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_text('PPI,APP,SOURCE\n"[[0.0,0.1],[1,-1],[60,52]]",web,s\nbad,web,s\n')
    rows = readers.ppi(spark, str(tmp_path / "c")).collect()
    assert rows[0].record.sizes == [60.0, 52.0] and rows[1].record is None
    (tmp_path / "j").mkdir()
    with gzip.open(tmp_path / "j/a.jsonl.gz", "wt") as f:
        f.write('{"ppi": [[0.0],[1],[60]], "APP": "x"}\nnot json\n')
    rows = readers.ppi(spark, str(tmp_path / "j"), "jsonl").collect()
    assert len(rows) == 1 and rows[0].record.sizes == [60.0] and rows[0].app == "x"


def test_connection_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("#separator \\x09\n#fields\tts\tuid\tid.orig_h\n1\tC1\t10.0.0.1\n2\tC2\n")
    (tmp_path / "b.log").write_text("3\tC3\t10.0.0.3\n")
    rows = {r.fields["uid"]: r.fields for r in readers.conn_logs(spark, str(tmp_path)).collect()}
    assert rows["C2"] == {"ts": "2", "uid": "C2", "id.orig_h": ""} and rows["C3"]["id.orig_h"] == "10.0.0.3" and len(rows["C3"]) == 21


def test_json_sources(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.json").write_text(json.dumps({"alerts": [{"alert_id": "x"}, 5]}, indent=1))
    (tmp_path / "one/b.jsonl").write_text('{"alert_id": "y"}\nbroken\n\n{"alert_id": "z"}\n')
    found, invalid = readers.alert_records(spark, str(tmp_path / "one"))
    assert sorted(json.loads(r.raw)["alert_id"] for r in found.collect()) == ["x", "y", "z"] and invalid.first().invalid == 1
    (tmp_path / "eve.json").write_text('{"event_type":"alert","src_ip":"1","alert":{"signature":"S"}}\n\nbad\n')
    assert [(r.event_type, r.alert.signature) for r in readers.ids_events(spark, str(tmp_path / "eve.json")).collect()] == [("alert", "S")]
    df = spark.createDataFrame([('{"event_type":"a"}',), ('{"data":{"event_type":"b"}}',), ('{"data":{"sensor":{"event_type":"c"}}}',), ("{}",)], "raw string")
    kinds = [r.k for r in df.select(F.get_json_object(readers.unwrap_sensor_event(F.col("raw")), "$.event_type").alias("k")).collect()]
    assert kinds == ["a", "b", "c", None]
    (tmp_path / "kb.jsonl").write_text('{"title":"T","tags":["a"]}\n')
    r = readers.knowledge(spark, str(tmp_path / "kb.jsonl")).first()
    assert r.title == "T" and r.tags == ["a"] and r.content == "" and r.recommended_queries == []


def test_sinks(spark, tmp_path):
    samples = spark.createDataFrame([([60, -52], [0.0, 0.1], "web", "s1")], "sizes array<int>, times array<double>, app string, source string")
    sinks.write_ppi(samples, str(tmp_path / "ppi"))
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "ppi")).first().PPI == "[[0.0,0.1],[1.0,-1.0],[60.0,52.0]]"
    with pytest.raises(Exception):
        sinks.write_ppi(samples, str(tmp_path / "ppi"))
    events = spark.createDataFrame([("ai_alert", "e1")], "event_type string, event_id string")
    for _ in range(2):
        sinks.write_events(events, str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev")).count() == 2
    status = spark.createDataFrame([("s1", 1, 5), ("s1", 2, 9), ("s2", 3, 1)], "sensor_id string, event_id long, observed_us long")
    sinks.write_status(status, str(tmp_path / "st"))
    assert sorted((r.sensor_id, r.event_id) for r in spark.read.json(str(tmp_path / "st")).collect()) == [("s1", 2), ("s2", 3)]


def test_captured_addresses_of_many_users(spark, tmp_path):
    """Users beyond 65,535 have an address part over 255, which a frame has no byte for."""
    events = spark.range(300).selectExpr("id as event_id", "id * 400 as user_id", "'view' as event_type", "0.5D as value", "'{}' as props", "timestamp_micros(1704067200000000 + id * 7000000) as ts")
    events.coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    cursor = con.execute(catalog.oracle_sql()["read_captures"])
    got = catalog.queries()["read_captures"](spark, str(tmp_path)).select(*(c[0] for c in cursor.description))
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
