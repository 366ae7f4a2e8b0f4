"""The literal cases of flow assembly, and the automaton against a plain simulation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trafficjobs.functions import features
from trafficjobs.operators import flows
from trafficjobs.streaming.jobs import OpenFlow
from trafficjobs.streaming import jobs
from trafficjobs.operators.flows import Limits

C, S = ("10.0.0.2", 51000), ("203.0.113.10", 443)
US = 1_000_000


def packet(t, src, dst, length, flags):
    return (round(t * US), *src, *dst, length, flags)


def walk(packets, most, least, idle, active, end=None):
    """The packets of one connection one by one through the state that streams keep; rows of the flows, and the state."""
    lo, hi = sorted([packets[0][1:3], packets[0][3:5]])
    w = OpenFlow(Limits(most, least, round(idle * US), round(active * US)), (*lo, *hi, "tcp"))
    out = []
    for p in packets:
        w = OpenFlow(w.limits, w.key, w.saved())
        out.append(w.add([(p[0], p[1:3] == lo, p[5], p[6])]))
    if end and w.due() and w.due()[0] <= round(end * US):
        out.append(w.end(w.due()[1]))
    return [f for found in out for f in found], w


CASES = {
    "syn": ([(10.0, C, S, 60, 2), (10.2, S, C, 60, 18), (10.5, C, S, 52, 16)], (3, 3, 30, 120), None, C, [60, -60, 52], "max_packets"),
    "no syn": ([(1.0, ("192.0.2.5", 443), ("10.0.0.8", 53000), 120, 16), (1.4, ("10.0.0.8", 53000), ("192.0.2.5", 443), 64, 16)], (4, 2, 5, 120), 7.0, ("192.0.2.5", 443), [120, -64], "idle_timeout"),
    "fin": ([(1.0, C, S, 60, 2), (1.1, S, C, 60, 18), (1.2, C, S, 52, 17)], (20, 3, 30, 120), None, C, [60, -60, 52], "tcp_close"),
    "syn ack first": ([(1.0, S, C, 60, 18), (1.1, C, S, 52, 17)], (20, 2, 30, 120), None, C, [-60, 52], "tcp_close"),
    "late syn": ([(1.0, S, C, 60, 16), (1.1, C, S, 60, 2), (1.2, C, S, 52, 17)], (20, 3, 30, 120), None, C, [-60, 60, 52], "tcp_close"),
    "retransmit": ([(1.0, C, S, 60, 2), (1.0, C, S, 60, 2), (1.1, S, C, 60, 18), (1.2, C, S, 52, 17)], (4, 3, 30, 120), None, C, [60, 60, -60, 52], "max_packets"),
    "tail": ([(1.0, C, S, 60, 2), (1.1, S, C, 60, 18), (1.2, C, S, 52, 16), (1.3, C, S, 9, 16), (1.4, S, C, 9, 16), (1.5, C, S, 9, 17)], (3, 3, 30, 120), None, C, [60, -60, 52], "max_packets"),
}


@pytest.mark.parametrize("name", CASES)
def test_literal_cases(name):
    packets, limits, end, src, sizes, reason = CASES[name]
    out, _ = walk([packet(*p) for p in packets], *limits, end)
    assert [(f[0:2], f[7], f[9]) for f in out] == [(src, sizes, reason)]


def test_key_reuse_and_restore():
    _, w = walk([packet(*p) for p in [*CASES["tail"][0][:3], (1.3, C, S, 9, 17), (2.0, C, S, 60, 2)]], 3, 3, 30, 120)
    assert w.open and w.rows[0][0] == 2 * US
    _, w = walk([packet(*p) for p in CASES["fin"][0][:2]], 20, 3, 30, 120)
    again = OpenFlow(w.limits, w.key, w.saved())
    out = again.add([(round(1.2 * US), True, 52, 17)])
    assert out[0][7] == [60, -60, 52] and again.due() is None and again.saved() is None


class Plain:
    """The rules packet by packet: idle, open and quiet, each with its two deadlines."""

    def __init__(self, limits):
        self.limits, self.flow, self.quiet, self.out = limits, None, None, []

    def stop(self, reason):
        f, self.flow = self.flow, None
        if len(f["sizes"]) >= self.limits.min_packets:
            self.out.append((*f["a"], *f["b"], "tcp", f["start"], f["last"], f["sizes"], f["offsets"], reason))

    def add(self, ts, src_ip, src_port, dst_ip, dst_port, length, flags):
        held = self.flow or self.quiet
        if held and ts >= min(held["last"] + self.limits.idle_us, held["start"] + self.limits.active_us):
            if self.flow:
                self.stop("idle_timeout" if held["last"] + self.limits.idle_us <= held["start"] + self.limits.active_us else "active_timeout")
            self.quiet = None
        src, dst, syn, ack, close = (src_ip, src_port), (dst_ip, dst_port), flags & 2, flags & 16, flags & 5
        if self.quiet and not (syn and not ack):
            self.quiet = None if close else self.quiet | {"last": ts}
            return
        self.quiet = None
        if not self.flow:
            a, b = (dst, src) if syn and ack else (src, dst)
            self.flow = {"a": a, "b": b, "start": ts, "sizes": [], "offsets": [], "sure": syn}
        f = self.flow
        if syn and not ack and not f["sure"]:
            if src != f["a"]:
                f |= {"a": f["b"], "b": f["a"], "sizes": [-x for x in f["sizes"]]}
            f["sure"] = True
        f["sizes"].append(length if src == f["a"] else -length)
        f["offsets"].append(ts - f["start"])
        f["last"] = ts
        if len(f["sizes"]) == self.limits.max_packets:
            self.quiet = None if close else {"start": f["start"], "last": ts}
            self.stop("max_packets")
        elif close:
            self.stop("tcp_close")


def test_offsets_and_limits():
    out, _ = walk([packet(*p) for p in CASES["syn"][0]], 3, 3, 30, 120)
    assert out[0][8] == [0, 200_000, 500_000]
    with pytest.raises(ValueError):
        Limits(2, 3)


def _rows(seed, n=3000):
    rng, rows, t = random.Random(seed), [], 0
    ends = [("10.0.0.%d" % i, 1000 + i) for i in range(3)] + [("9.9.9.9", 443)]
    for i in range(n):
        t += rng.choice([1000, 500_000, 3 * US, 12 * US])
        a, b = rng.sample(ends, 2)
        rows.append((i, t, *a, *b, rng.choice(["tcp", "TCP", "udp"]), rng.randint(40, 1500), rng.choice([2, 18, 16, 16, 16, 16, 17, 4])))
    return rows


def test_assembly_is_the_walk_of_each_key_under_any_partitioning(spark):
    rows = _rows(4)
    frame = spark.createDataFrame(rows, "i int, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, ip_length int, tcp_flags int")
    limits = Limits(5, 2, 30 * US, 60 * US)
    keys = {}
    for r in rows:
        if r[6].lower() == "tcp":
            keys.setdefault(tuple(sorted([r[2:4], r[4:6]])), []).append((r[1], *r[2:6], *r[7:9]))
    want = []
    for packets in keys.values():
        w = Plain(limits)
        for p in packets:
            w.add(*p)
        if w.flow:
            w.stop("replay_end")
        want += w.out
    want = sorted(map(str, want))
    for df in (frame, frame.repartition(7).orderBy(F.rand(1))):
        assert sorted(str(tuple(r)) for r in flows.assemble_flows(df, limits, ("i",)).collect()) == want
    assert {r[9] for r in [eval(x) for x in want]} == {"max_packets", "tcp_close", "idle_timeout", "active_timeout", "replay_end"}
    # small batches cut segments anywhere
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(str(tuple(r)) for r in flows.assemble_flows(frame, limits, ("i",)).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


SCHEMA = "i int, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, ip_length int, tcp_flags int"


@pytest.mark.parametrize("silent", [True, False])
def test_one_busy_key_goes_to_many_tasks(spark, silent):
    """Also where it is never silent: closing packets let each slice of time begin by itself."""
    step = 40 * US if silent else 10 * US
    rows = [(i, (i // 5) * step + i, *C, *S, "tcp", 60, 17 if not silent and i % 5 == 4 else 16) for i in range(2000)]
    limits = Limits(20 if not silent else 5, 2, 30 * US, 120 * US)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert flows.assemble_flows(frame, limits, ("i",)).count() == 400
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = flows.assemble_slices(frame, limits, ("i",)).withColumn("task", F.spark_partition_id()).where("kind < 2").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert r.n > 380 and r.tasks >= 4


def test_segments_over_slices_of_time(spark):
    """Numbers of segments of keys that are silent, never silent, or quiet at edges of slices, with nulls; with and without a shuffle of carried rows."""
    rng, rows = random.Random(11), []
    width = flows.SLICE * 30 * US
    for key in range(6):
        t = -3 * width + rng.randint(0, width)
        for _ in range(500):
            t += rng.choice([1, US, 29 * US + 999_999, 30 * US, 31 * US] if key % 3 == 0 else [US, 20 * US] if key % 3 == 1 else [US, width, width - 30 * US])
            rows.append((len(rows), t - t % width if rng.random() < 0.05 else t, None if key == 4 else f"10.0.0.{key}", 5, "9.9.9.9", 443, "tcp", 60, 16))
    rows += [(len(rows) + k, None, *C, *S, "tcp", 60, 2) for k in range(2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want, last = {}, {}
    for i, t, ip, *_ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        if t is not None:
            held = last.get(ip)
            last[ip] = (t, held[1] + (t - held[0] >= 30 * US) if held else 0)
            want[i] = (ip, last[ip][1], t)
    got = flows.idle_segments(flows.with_key(frame))
    assert {r.i: r.segment for r in got.collect()} == {i: s for i, (_, s, _) in want.items()} and got.columns == [*flows.with_key(frame).columns, "segment"]
    runs = {(r.lo_ip, r.segment): (r.packets, r.first_us, r.last_us, [p.i for p in r.ps]) for r in flows.idle_runs(flows.with_key(frame), 7, ("i",)).collect()}
    parts = {}
    for i, (ip, s, t) in want.items():
        parts.setdefault((ip and min(ip, "9.9.9.9"), s), []).append((t, i))
    assert runs == {k: (len(v), min(v)[0], max(v)[0], [i for _, i in sorted(v)[:7]]) for k, v in parts.items()}
    assert flows.idle_segments(flows.with_key(frame.limit(0))).count() == 0 and flows.assemble_flows(frame.limit(0)).count() == 0


def test_encoding(spark):
    df = spark.createDataFrame([([54, -64, 2501], [0.0, 0.2, 11.0])], "s array<int>, t array<double>")
    r = df.select(features.padded(features.tokens(F.col("s"), F.col("t"), 5), 5).alias("p")).first().p
    assert (r.sizes, r.dirs, r.times, r.mask) == ([55, 65, 2001, 0, 0], [1, 2, 1, 0, 0], [0, 0.2, 10, 0, 0], [True] * 3 + [False] * 2)


def test_vectors_and_ppi(spark):
    texts = ["60,-60,52", "-", "(empty)", "", "1,x", None, "1,,2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(flows.parse_vector(F.col("t"), "int").alias("v")).collect()] == [[60, -60, 52], None, None, None, None, None, None]
    assert df.select(flows.parse_vector(F.col("t"), "int", True).alias("v")).collect()[6].v == [1, 2]
    ppi = ["[[0.0,0.1],[1,-1],[60,52]]", "([0.0, 0.1], (1.0, -1.0), [60, 52])", '{"iats":[0,0.1],"dir":[1,-1],"sizes":[60,52]}', "[[0.  0.1]\n [1. -1.]\n [60. 52.]]", "nothing", None, "[[1],[2]]"]
    out = [r.p for r in spark.createDataFrame([(p,) for p in ppi], "t string").select(features.parse_ppi(F.col("t")).alias("p")).collect()]
    assert [tuple(map(list, p)) if p else None for p in out] == [([0.0, 0.1], [1.0, -1.0], [60.0, 52.0])] * 4 + [None] * 3
    sample = spark.createDataFrame([(ppi[0],)], "t string").select(features.ppi_sample(features.parse_ppi(F.col("t"))).alias("s")).first().s
    assert (sample.sizes, sample.dirs) == ([61, 53], [1, 2])


def test_augmented_copies_repeat(spark):
    df = spark.createDataFrame([(i, [60] * 50, [0.5] * 50) for i in range(40)], "id long, s array<int>, t array<double>")
    a = df.select("id", features.augment(features.tokens(F.col("s"), F.col("t")), F.col("id")).alias("a"))
    x, y = ({r.id: r.a for r in d.collect()} for d in (a, a.repartition(5)))
    assert x == y
    zeros = sum(v == 0 for r in x.values() for v in r.sizes)
    assert 0.1 < zeros / 2000 < 0.2 and all(abs(t - 0.5) < 0.05 for r in x.values() for t in r.times)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_parsed_and_draws_are_made_once(spark):
    texts = spark.createDataFrame([("[[0.0,0.1],[1,-1],[60,52]]",)], "t string")
    r = texts.select(features.parse_ppi(F.col("t")).alias("r"))
    assert _plan(r.select("r.times", "r.dirs", "r.sizes")).count("from_json(ArrayType") == 1
    drawn = spark.createDataFrame([(1, [60] * 5, [0.5] * 5)], "id long, s array<int>, t array<double>").select("id", features.tokens(F.col("s"), F.col("t")).alias("e"))
    a = drawn.select(features.augment(F.col("e"), F.col("id")).alias("a")).select("a.sizes", "a.dirs", "a.times")
    assert _plan(a).count("drop") == 1


def test_spans_add_packets_up_before_the_shuffle(spark):
    """Spans of silent, never silent and edge-hugging keys, nulls among them, equal idle_runs; windows of a table come from them."""
    rng, rows, width = random.Random(12), [], flows.SLICE * 30 * US
    for key in range(6):
        t = -3 * width + rng.randint(0, width)
        for _ in range(400):
            t += rng.choice([1, US, 29 * US + 999_999, 30 * US, 31 * US] if key % 3 == 0 else [US, 20 * US] if key % 3 == 1 else [US, width, width - 30 * US])
            rows.append((len(rows), t - t % width if rng.random() < 0.05 else t, None if key == 4 else f"10.0.0.{key}", 5, "9.9.9.9", 443, "tcp", 60, 16))
    rows += [(len(rows), None, *C, *S, "tcp", 60, 2)] + [(len(rows) + k, k, *C, *S, "tcp", 60, 16) for k in range(20_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    span = lambda df: sorted((str(r.lo_ip), r.segment, r.packets, r.first_us, r.last_us) for r in df.collect())
    assert span(flows.idle_spans(flows.with_key(frame))) == span(flows.idle_runs(flows.with_key(frame), 1, ("i",)))
    windows = jobs.idle_windows(frame)
    assert sum(r.packets for r in windows.collect()) == len(rows) - 1 and "SessionWindow" not in windows._jdf.queryExecution().executedPlan().toString()
    assert flows.idle_spans(flows.with_key(frame.limit(0))).count() == 0


def test_a_packet_carries_its_sender_not_its_addresses(spark):
    """One sort for the places in a run, and no address in the lists of packets."""
    packets = spark.createDataFrame([(k, k, *(C + S if k % 2 else S + C), "tcp", 60 + k, 16) for k in range(5)] + [(9, 99, None, 5, "9.9.9.9", 443, "tcp", 60, 16)] * 3, SCHEMA)
    out = flows.segment_sequences(flows.with_key(packets), order=("i",))
    found = {r.src_ip: r for r in out.collect()}
    assert found[S[0]].sizes == [60, -61, 62, -63, 64] and found[None].sizes == [-60] * 3
    assert "struct(ts_us" in _plan(out) and not re.search(r"struct\(ts_us[^)]*src_ip", _plan(out))
