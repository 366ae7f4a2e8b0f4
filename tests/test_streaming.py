"""Streams fed from files, in two runs over one checkpoint, against the batch jobs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trafficjobs.operators import flows
from trafficjobs.operators.flows import Limits
from trafficjobs.plans.views import view
from trafficjobs.streaming import jobs

SF = "/root/testdata/sf0.001"
LIMITS = Limits(20, 3, 30_000_000, 120_000_000)


def two_runs(frames, tmp_path, build, schema, mode="append"):
    """Write the frames one after the other, each followed by a run of the stream; the rows of its file sink."""
    spark = frames[0].sparkSession
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = build(stream).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(240)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_flow_stream_equals_batch(spark, tmp_path, rocks):
    packets = view(spark, SF, "packets").where("event_id < 120").cache()
    cut = packets.agg(F.percentile("ts_us", 0.5).cast("long")).first()[0]
    # a last packet far in the future lets the watermark pass every deadline; it stays in an open flow of its own
    last = packets.agg(F.max("ts_us")).first()[0] + 3_600_000_000
    flush = packets.limit(1).withColumns({"ts_us": F.lit(last), "src_ip": F.lit("9.9.9.9"), "dst_ip": F.lit("9.9.9.8")})
    flush2 = flush.withColumn("ts_us", F.col("ts_us") + 1_000_000)
    parts = [packets.where(F.col("ts_us") < cut), packets.where(F.col("ts_us") >= cut), flush, flush2]
    got = two_runs(parts, tmp_path, lambda s: jobs.flow_stream(s, LIMITS, order=("event_id", "i")), packets.schema)
    # at the end of the data a batch flow is cut off; in the stream its deadline comes
    key = lambda df: sorted((r.src_ip, r.src_port, r.dst_ip, r.started_us, r.ended_us, tuple(r.sizes), tuple(r.offsets_us)) for r in df.where("src_ip <> '9.9.9.9'").collect())
    assert key(got) == key(flows.assemble_flows(packets, LIMITS, ("event_id", "i")))
    packets.unpersist()


def test_flow_stream_keeps_groups_of_connections(spark, tmp_path, rocks):
    """The state is a row for each group, not for each connection; null endpoints, a null in a text that breaks ties, a flow flushed."""
    rows = []
    for c in range(60):
        a, b = ("10.0.0.%d" % c if c % 7 else None, 50000 + c if c % 5 else None), ("203.0.113.9", 443) if c % 11 else ("10.0.0.%d" % c, 50000 + c)
        for k in range(9):
            flags = 2 if k == 0 else 17 if k == c % 13 else 16
            rows.append((1_000_000 * (1 + c + k // 2 * (c % 9)), *(a if k % 3 else b), *(b if k % 3 else a), "TCP", 60 + k, flags, None if k % 4 == 0 else f"n{k}"))
    packets = spark.createDataFrame(rows, "ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, ip_length int, tcp_flags int, name string").cache()
    parts = [packets.where("ts_us < 40000000"), packets.where("ts_us >= 40000000")]
    got = two_runs(parts, tmp_path, lambda s: jobs.flow_stream(s, LIMITS, order=("name",), groups=3), packets.schema)
    first = spark.read.format("statestore").option("stateVarName", "open").option("batchId", 0).load(str(tmp_path / "ck"))
    assert first.count() == 3
    got = got.unionByName(jobs.flush_flows(spark, str(tmp_path / "ck"), LIMITS))
    key = lambda df: sorted((str(r[:4]), r.started_us, r.ended_us, tuple(r.sizes), tuple(r.offsets_us)) for r in df.collect())
    assert key(got) == key(flows.assemble_flows(packets, LIMITS, ("name",)))
    assert {"idle_timeout", "tcp_close", "shutdown"} <= {r[0] for r in got.select("close_reason").distinct().collect()}
    packets.unpersist()


def test_open_flows_equal_one_connection():
    """Many connections at once against each by itself, over batches with late packets and a mark that passes deadlines."""
    rng, us = random.Random(10), 1_000_000
    for limits in (Limits(4, 1, 3 * us, 5 * us), Limits(6, 2, 5 * us, 6 * us)):
        ends = [("a", k, "b" if k % 3 else "a", k if k % 2 else None) for k in range(12)]
        held, alone, got, want = jobs.OpenFlows(limits), {}, [], []
        for batch in range(12):
            mark, runs = (batch * 4 - 6) * us, []
            for _ in range(14):
                runs.append((rng.choice(ends), [((batch * 4 - rng.randrange(9)) * us + rng.randrange(3), rng.random() < 0.5, rng.randrange(50, 60), rng.choice((2, 16, 16, 16, 18, 17))) for _ in range(rng.randrange(1, 5))]))
            given = [np.array(x) for x in zip(*(p for _, ps in runs for p in ps))]
            ties = [np.arange(len(given[0]))]
            table = pa.table(list(zip(*(e for e, _ in runs))), schema=jobs._ENDS)
            got += held.step(mark, table, np.array([len(ps) for _, ps in runs]), given, ties).to_pylist()
            held = jobs.OpenFlows(limits, held.saved())
            for e in ends:
                w, fresh = jobs.OpenFlow(limits, (*e, "tcp"), alone.get(e)), sorted((p for x, ps in runs if x == e for p in ps if p[0] > mark), key=lambda p: p[0])
                want += w.add(fresh) if fresh else []
                if w.due() and -(-w.due()[0] // 1000) * 1000 <= mark:
                    want += w.end(w.due()[1])
                alone[e] = w.saved()
        assert {r["close_reason"] for r in got} >= {"idle_timeout", "active_timeout", "tcp_close", "max_packets"}
        want += [f for e in ends for f in jobs.OpenFlow(limits, (*e, "tcp"), alone[e]).end("shutdown")]
        got += held.flush("shutdown").to_pylist()
        assert sorted(map(str, ((*r.values(),) for r in got))) == sorted(map(str, want))


def test_sensor_transitions(spark, tmp_path, rocks):
    """First sign, exact limit, silence inside a batch and over batches, a late and a repeated sign, one without a sensor."""
    us = 1_000_000
    schema = "sensor_id string, observed_us long"
    frames = [[("a", 0), ("a", 45 * us), ("a", 45 * us), ("b", 0), ("b", 46 * us), (None, 5)], [("a", 100 * us), ("b", 60 * us), ("b", 46 * us), ("b", None)], [("c", 400 * us), ("b", 1 * us)], [("a", 410 * us), ("c", 401 * us)]]
    got = two_runs([spark.createDataFrame([(s, None if t is None else t + 1000 * us) for s, t in f], schema) for f in frames], tmp_path, jobs.sensor_transitions, spark.createDataFrame([], schema).schema)
    want = [("a", "healthy", 0), ("a", "stale", 90), ("a", "healthy", 100), ("a", "stale", 145), ("a", "healthy", 410), ("b", "healthy", 0), ("b", "stale", 45), ("b", "healthy", 46), ("b", "stale", 105), ("c", "healthy", 400)]
    found = sorted((r.sensor_id, r.state, r.at_us // us - 1000) for r in got.collect())
    assert found == sorted(want), found


def test_distinct_events_and_windows(spark, tmp_path):
    alerts = view(spark, SF, "alerts").where("event_id < 200")
    got = two_runs([alerts, alerts], tmp_path, lambda s: jobs.distinct_events(s, id_="alert_id", delay="40 days"), alerts.schema)
    assert got.count() == alerts.count() == got.select("alert_id").distinct().count()


def test_status_and_case_sync(spark, tmp_path):
    beats = view(spark, SF, "beats").coalesce(1)
    write = jobs.keep_status(str(tmp_path / "status"))
    write(beats.where("event_id % 2 = 0"), 0)
    write(beats.where("event_id % 2 = 1"), 1)
    got = {(r.sensor_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "status/1")).collect()}
    want = {(r.sensor_id, r.e) for r in beats.groupBy("sensor_id").agg(F.max_by("event_id", F.struct("observed_us", "event_id")).alias("e")).collect()}
    assert got == want
    write(beats.where("event_id % 2 = 1"), 1)  # a batch that is repeated after a failure
    assert {(r.sensor_id, r.event_id) for r in jobs.newest_status(spark, str(tmp_path / "status")).collect()} == want and jobs.newest_status(spark, str(tmp_path / "none")) is None
    alerts = spark.createDataFrame([("k1", 1, "a"), ("k1", 2, "b"), ("k2", 3, "c"), (None, 4, "d")], "alert_key string, start_us long, alert_id string")
    sync = jobs.sync_cases(str(tmp_path / "cases"))
    sync(alerts, 0)
    sync(alerts, 0)
    assert sorted((r.alert_key, r.alert_id) for r in spark.read.parquet(str(tmp_path / "cases")).collect()) == [("k1", "a"), ("k2", "c")]


def test_evidence_stream(spark, tmp_path):
    alerts, conn = view(spark, SF, "alerts"), view(spark, SF, "conn")
    alerts.coalesce(1).write.parquet(str(tmp_path / "a"))
    conn.coalesce(1).write.parquet(str(tmp_path / "c"))
    read = lambda p, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / p))
    q = jobs.evidence_stream(read("a", alerts), read("c", conn), 6 * 3600).writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {(r.alert_id, r.conn_uid) for r in spark.table("pairs").where("conn_uid is not null").collect()}
    margin = 6 * 3600 * 1_000_000
    want = alerts.join(conn, (alerts.src_ip == conn.orig_h) & F.abs(alerts.start_us - conn.ts_us).__le__(margin))
    assert got == {(r[0], r[1]) for r in want.select("alert_id", conn.uid).collect()}
