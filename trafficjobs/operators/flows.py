"""Packets to bidirectional TCP flows.

Packets have ts_us (epoch microseconds), src_ip, src_port, dst_ip, dst_port, protocol, ip_length and tcp_flags; `order`
names further columns that break ties of ts_us.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.operators._flow_kernel import ACK, CLOSING, SYN, Packets, Rest
from trafficjobs.session import materialize, small

FLOW_SCHEMA = (
    "src_ip string, src_port int, dst_ip string, dst_port int, protocol string, started_us long, ended_us long, "
    "sizes array<int>, offsets_us array<long>, close_reason string"
)


@dataclass(frozen=True)
class Limits:
    """When flows end, and how many packets they must have."""

    max_packets: int = 20
    min_packets: int = 3
    idle_us: int = 30_000_000
    active_us: int = 120_000_000

    def __post_init__(self):
        if not 1 <= self.min_packets <= self.max_packets:
            raise ValueError("min_packets must lie between 1 and max_packets")


def tcp_only(packets: DataFrame) -> DataFrame:
    return packets.where(F.lower("protocol") == "tcp")


def is_original_syn(flags: Column) -> Column:
    return (flags.bitwiseAND(F.lit(SYN)) != 0) & (flags.bitwiseAND(F.lit(ACK)) == 0)


def is_closing(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(CLOSING)) != 0


def with_key(packets: DataFrame) -> DataFrame:
    """Adds lo_ip, lo_port, hi_ip, hi_port and proto: the endpoints in order, by text of ip and then by port, whatever the direction."""
    a, b = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return packets.withColumns({"lo_ip": lo["ip"], "lo_port": lo["port"], "hi_ip": hi["ip"], "hi_port": hi["port"], "proto": F.lower("protocol")})


KEY = ("lo_ip", "lo_port", "hi_ip", "hi_port", "proto")


#: Idle timeouts in a slice of time.
SLICE = 20


def _sliced(keyed: DataFrame, idle_us: int) -> DataFrame:
    """Adds slice, the begin of a packet's slice of time. A packet that a later slice may go on from is in that one too, as halo.

    So each slice of a key tells by itself where silences are, and the slices of a busy key are many tasks. Packets without a
    time are left out.
    """
    inside = F.pmod(F.col("ts_us"), F.lit(idle_us * SLICE))
    own = F.col("ts_us") - inside
    both = F.when(inside > idle_us * (SLICE - 1), F.array(own, own + idle_us * SLICE)).otherwise(F.array(own))
    return keyed.where("ts_us is not null").withColumn("slice", F.explode(both))


_HALO = "slice > ts_us"


def _begun(keyed: DataFrame, idle_us: int, order: Sequence[str]) -> DataFrame:
    """Sliced packets without the halo, with begins (a silence or nothing stands before the packet), run, how many of its slice have begun by then, and no, its place in the slice."""
    w = Window.partitionBy(*KEY, "slice").orderBy("ts_us", *order)
    rows = _sliced(keyed, idle_us).withColumn("begins", F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w) >= idle_us, F.lit(True)))
    by_then, own = w.rowsBetween(Window.unboundedPreceding, 0), ~F.expr(_HALO)
    return rows.withColumns({"run": F.count_if(F.col("begins") & own).over(by_then), "no": F.count_if(own).over(by_then)}).where(own)


def idle_segments(keyed: DataFrame, idle_us: int = 30_000_000) -> DataFrame:
    """Adds segment: it grows by one where a key was silent for idle_us or longer. Packets without a time have none and are left out.

    A scan in segments: every slice of time of a key is numbered by itself and written, and what the slices before it have
    begun is added, one small row for each slice of a key.
    """
    local = materialize(_begun(keyed, idle_us, ()), "segments")
    slices = local.groupBy(*KEY, "slice").agg(F.count_if("begins").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = materialize(slices.select(*(F.col(c).alias(f"_{c}") for c in (*KEY, "slice")), before.alias("before")).where("before is not null"), "carried")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*KEY, "slice")]
    out = local.join(small(carried), on, "left").withColumn("segment", F.coalesce("before", F.lit(0)) + F.col("run") - 1)
    return out.select(*keyed.columns, "segment")


def idle_runs(keyed: DataFrame, n: int = 20, order: Sequence[str] = (), idle_us: int = 30_000_000) -> DataFrame:
    """One row for each segment of a key: segment, packets, first_us, last_us, and ps, its first n packets in order.

    Packets are shuffled once, by key and slice of time; only rows of the runs in a slice come together by key, where runs
    that go on from the slice before are joined.
    """
    rest = [c for c in keyed.columns if c not in (*KEY, "ts_us", *order)]
    rows = _begun(keyed, idle_us, order)
    # the order of _begun serves again: a run's places begin with that of its first packet
    by_then = Window.partitionBy(*KEY, "slice").orderBy("ts_us", *order).rowsBetween(Window.unboundedPreceding, 0)
    position = F.col("no") - F.coalesce(F.max(F.when(F.col("begins"), F.col("no"))).over(by_then), F.lit(1)) + 1
    rows = rows.withColumn("position", position).withColumn("p", F.when(F.col("position") <= n, F.struct("ts_us", *order, *rest)))
    runs = rows.groupBy(*KEY, "slice", "run").agg(F.count(F.lit(1)).alias("packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.bool_or("begins").alias("begins"), F.sort_array(F.collect_list("p")).alias("ps"))
    number = F.sum(F.col("begins").cast("long")).over(Window.partitionBy(*KEY).orderBy("first_us").rowsBetween(Window.unboundedPreceding, 0)) - 1
    runs = runs.withColumn("segment", number).groupBy(*KEY, "segment").agg(F.sum("packets").alias("packets"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sort_array(F.collect_list(F.struct("first_us", "ps"))).alias("parts"))
    return runs.withColumn("ps", F.slice(F.flatten("parts.ps"), 1, n)).drop("parts")


def idle_spans(keyed: DataFrame, idle_us: int = 30_000_000, sums: Sequence[str] = ()) -> DataFrame:
    """One row for each segment of a key: segment, packets, first_us, last_us and sums of the columns.

    Packets of a key and cell of time, one idle timeout long, are of one segment, so they are added up where they are and only
    cells are shuffled. Cells are joined in slices of time, then what the slices have by key.
    """
    start = lambda width: F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(width))
    added = [F.sum(c).alias(c) for c in ("packets", *sums)]
    ends = [F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")]
    timed = keyed.where("ts_us is not null").withColumns({"slice": start(idle_us * SLICE), "cell": start(idle_us)})
    spans = timed.groupBy(*KEY, "slice", "cell").agg(F.count(F.lit(1)).alias("packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), *(F.sum(c).alias(c) for c in sums))
    for by in ((*KEY, "slice"), KEY):
        w = Window.partitionBy(*by).orderBy("first_us")
        spans = spans.withColumn("fresh", F.coalesce(F.col("first_us") - F.lag("last_us").over(w) >= idle_us, F.lit(True)))
        spans = spans.withColumn("segment", F.count_if("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        spans = spans.groupBy(*by, "segment").agg(*added, *ends)
    return spans


def first_packets(keyed: DataFrame, n: int = 20, order: Sequence[str] = (), idle_us: int = 30_000_000) -> DataFrame:
    """The first n packets of each segment, numbered from 1 in the column position."""
    found = idle_runs(keyed, n, order, idle_us).select(*KEY, "segment", F.posexplode("ps").alias("position", "p"))
    return found.select(*KEY, "segment", (F.col("position") + 1).alias("position"), "p.*")


def segment_sequences(keyed: DataFrame, n: int = 20, min_packets: int = 3, order: Sequence[str] = (), idle_us: int = 30_000_000) -> DataFrame:
    """Idle-only flows in built-ins: one row for each segment with the signed sizes and offsets of its first n packets.

    The initiator is the sender of the first packet, or its receiver if that is a SYN with ACK.
    """
    by_lo = F.col("src_ip").eqNullSafe(F.col("lo_ip")) & F.col("src_port").eqNullSafe(F.col("lo_port"))
    # the key has both endpoints, so a packet carries but which of them sent it
    flows = idle_runs(keyed.select(*KEY, by_lo.alias("by_lo"), "ts_us", "ip_length", "tcp_flags", *order), n, order, idle_us).where(F.size("ps") >= min_packets)
    first = F.col("ps")[0]
    flip = (first["tcp_flags"].bitwiseAND(F.lit(SYN)) != 0) & (first["tcp_flags"].bitwiseAND(F.lit(ACK)) != 0)
    flows = flows.withColumn("lo_began", first["by_lo"] != F.coalesce(flip, F.lit(False)))
    end = lambda c, by: F.when(by, F.col(f"lo_{c}")).otherwise(F.col(f"hi_{c}")).alias
    began, other = F.col("lo_began"), ~F.col("lo_began")
    out = flows.select("*", end("ip", began)("src_ip"), end("port", began)("src_port"), end("ip", other)("dst_ip"), end("port", other)("dst_port"))
    own = F.col("lo_ip").eqNullSafe(F.col("hi_ip")) & F.col("lo_port").eqNullSafe(F.col("hi_port"))
    forward = lambda p: F.col("src_ip").isNotNull() & F.col("src_port").isNotNull() & (own | (p["by_lo"] == F.col("lo_began")))
    return out.select(
        "src_ip", "src_port", "dst_ip", "dst_port", F.col("proto").alias("protocol"), "segment", first["ts_us"].alias("started_us"), F.element_at("ps", -1)["ts_us"].alias("ended_us"),
        F.transform("ps", lambda p: F.when(forward(p), p["ip_length"]).otherwise(-p["ip_length"])).alias("sizes"),
        F.transform("ps", lambda p: p["ts_us"] - F.col("ps")[0]["ts_us"]).alias("offsets_us"),
    )


ENDS = ("lo_ip", "lo_port", "hi_ip", "hi_port")


def flow_batch(batch: pa.RecordBatch | pa.Table, packets: Packets, found: list[tuple[int, int, str]], of: np.ndarray | None = None) -> pa.RecordBatch:
    """The flows as a batch of FLOW_SCHEMA; batch has the endpoints of each packet's key, or of keys, and of tells which is a packet's."""
    c = packets.columns(found)
    lo, first = pa.array(c["begun_by_lo"].astype(bool)), pa.array(c["first"] if of is None else of[c["first"]])
    end = {k: batch.column(k).take(first) for k in ENDS}
    end = {k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in end.items()}
    lists = [pa.ListArray.from_arrays(pa.array(c["ends"].astype(np.int32)), pa.array(c[k].astype(kind))) for k, kind in (("sizes", np.int32), ("offsets_us", np.int64))]
    return pa.RecordBatch.from_arrays([
        pc.if_else(lo, end["lo_ip"], end["hi_ip"]), pc.if_else(lo, end["lo_port"], end["hi_port"]), pc.if_else(lo, end["hi_ip"], end["lo_ip"]), pc.if_else(lo, end["hi_port"], end["lo_port"]),
        pa.array(["tcp"] * len(first), pa.string()), pa.array(c["started_us"]), pa.array(c["ended_us"]), *lists, pa.array(c["close_reason"], pa.string()),
    ], names=[f.split()[0] for f in FLOW_SCHEMA.split(", ")])


#: Rows that a task of assembly gives: a flow, a flow that was open at the last packet, a packet for the next pass, a key's last time in a slice.
FLOW, OPEN, PACKET, LAST = range(4)
_FLOW_FIELDS = list(zip((f.split()[0] for f in FLOW_SCHEMA.split(", ")), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string())))


class _Assembly:
    """Ordered Arrow batches to flows. With a width the rows are sliced and have a halo, else they are what the slices left.

    A connection starts anew after a closing packet and after a silence. So a slice cuts flows by itself from its first such
    place on; what stands before it, if the halo tells that the connection goes on, and what is open near the slice's end
    are left to the next pass, which reads only that. Of the full flow whose tail goes on only when it began is left.
    """

    def __init__(self, limits: Limits, packet: list[str], width: int | None):
        self.limits, self.packet, self.width = limits, packet, width
        self.held: pa.Table | None = None  # rows of the last group that later batches may go on with
        self._fresh()
        self.met = 0  # how many of the held rows have been dealt with

    def _fresh(self) -> None:
        self.rest, self.before, self.skip = Rest(), None, None if self.width else False

    def _rows(self, kind: int, n: int, given: dict, kinds: pa.Schema) -> pa.RecordBatch:
        fields = [*_FLOW_FIELDS, *((c, kinds.field(c).type) for c in self.packet), ("since", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *(given[c] if c in given else pa.nulls(n, t) for c, t in fields)], names=["kind", *(c for c, _ in fields)])

    def _group(self, p: Packets, at: int, end: int, slice_us: int, halo: np.ndarray, since: dict[int, int], marks: list[int], ended: bool) -> None:
        """One slice of a key, or one key, from the row at on that has not been dealt with."""
        near = self.width is not None and p.times[end - 1] > slice_us + self.width - self.limits.idle_us
        carried = self.skip is not None and self.met  # the row before is of this group
        if self.skip is None:
            own = at + int(np.searchsorted(~halo[at:end], True))
            if own > at:
                self.before = (p.times[own - 1], bool(p.flags[own - 1] & CLOSING))
            if own == end:
                return
            self.skip, at = self.before is not None and p.times[own] - self.before[0] < self.limits.idle_us and not self.before[1], own
        if self.skip:
            closed = p._next(p.closing, at, end)
            stop = min(p._next(p.silence, at + (not carried), end), closed + 1, end)
            self.left += [(k, None) for k in range(at, stop)]
            self.skip, at = stop == end and closed == end, stop
        if not self.skip:
            for k in marks[bisect_left(marks, at) : bisect_left(marks, end)]:
                found, left = p.cut(at, k, self.rest)
                self.found += found
                if left.first is not None:
                    self.found.append((left.first, k, p.due(p.times[left.first], p.times[k - 1])[1]))
                self.rest, at = Rest(since=since[k]), k + 1
            found, self.rest = p.cut(at, end, self.rest)
            self.found += found
        if ended:
            self.last.append(end - 1)
            if self.rest.first is not None:
                if near:
                    self.left += [(k, None) for k in range(self.rest.first, end)]
                else:
                    self.open.append((self.rest.first, end, p.due(p.times[self.rest.first], p.times[end - 1])[1]))
            elif self.rest.since is not None and near:
                self.left.append((end - 1, self.rest.since))

    def step(self, table: pa.Table, done: bool) -> Iterator[pa.RecordBatch]:
        n, self.found, self.open, self.left, self.last = len(table), [], [], [], []
        number = lambda k: table.column(k).to_numpy()
        times, slices = number("ts_us"), number("slice")
        packets = Packets(times, number("by_lo"), number("ip_length").astype(np.int64), number("tcp_flags").astype(np.int64), number("own"), self.limits)
        halo, marked = slices > times if self.width else np.zeros(n, dtype=bool), table.column("since").combine_chunks()
        marks = np.flatnonzero(marked.is_valid().to_numpy(zero_copy_only=False)).tolist()
        since = {k: marked[k].as_py() for k in marks}
        other = slices[1:] != slices[:-1]
        for k in ENDS:
            column = table.column(k).combine_chunks()
            same = pc.equal(column[1:], column[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
            none = column.is_null().to_numpy(zero_copy_only=False)
            other |= ~(same | (none[1:] & none[:-1]))
        starts = np.concatenate(([0], np.flatnonzero(other) + 1)).tolist()
        for k, (at, end) in enumerate(zip(starts, [*starts[1:], n])):
            if k or self.held is None:
                self._fresh()
                self.met = 0
            ended = end < n or done
            if at + self.met < end or (ended and self.skip is not None):
                self._group(packets, at + self.met, end, int(slices[at]), halo, since, marks, ended)
        first = self.rest.first
        self.held, self.rest, self.met = table.slice(n - 1 if first is None else first), Rest(since=self.rest.since), int(first is None)
        for kind, flows in ((FLOW, self.found), (OPEN, self.open)):
            if flows:
                batch = flow_batch(table, packets, flows)
                yield self._rows(kind, len(batch), dict(zip(batch.schema.names, batch.columns)), table.schema)
        if self.left:
            rows = table.take(pa.array([k for k, _ in self.left])).combine_chunks()
            yield self._rows(PACKET, len(rows), {c: rows.column(c).combine_chunks() for c in rows.schema.names if c not in ("since", "slice")} | {"since": pa.array([x for _, x in self.left], pa.int64())}, table.schema)
        if self.last and self.width:
            rows = table.take(pa.array(self.last))
            yield self._rows(LAST, len(rows), {c: rows.column(c).combine_chunks() for c in ENDS} | {"ended_us": rows.column("ts_us").combine_chunks()}, table.schema)


def _assembled(rows: DataFrame, limits: Limits, schema, width: int | None) -> DataFrame:
    packet = [c for c in rows.columns if c not in ("slice", "since")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Assembly(limits, packet, width)
        for batch in batches:
            if len(batch):
                batch = pa.Table.from_batches([batch])
                yield from own.step(batch if own.held is None else pa.concat_tables([own.held, batch]), False)
        if own.held is not None:
            yield from own.step(own.held, True)

    return rows.mapInArrow(run, schema)


def assemble_slices(packets: DataFrame, limits: Limits = Limits(), order: Sequence[str] = ()) -> DataFrame:
    """The first pass of assemble_flows: rows of the kinds FLOW, OPEN, PACKET and LAST. Packets are shuffled once, by key and slice of time."""
    by_lo = F.col("src_ip").eqNullSafe(F.col("lo_ip")) & F.col("src_port").eqNullSafe(F.col("lo_port"))
    own = F.col("lo_ip").eqNullSafe(F.col("hi_ip")) & F.col("lo_port").eqNullSafe(F.col("hi_port"))
    keyed = with_key(tcp_only(packets)).select(*ENDS, by_lo.alias("by_lo"), own.alias("own"), "ts_us", "ip_length", "tcp_flags", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    sliced = _sliced(keyed, limits.idle_us).select(*keyed.columns, "slice", F.lit(None).cast("long").alias("since"))
    sliced = sliced.repartition(*ENDS, "slice").sortWithinPartitions(*ENDS, "slice", "ts_us", *order)
    return _assembled(sliced, limits, f"kind int, {FLOW_SCHEMA}, {kinds}, since long", limits.idle_us * SLICE)


def assemble_flows(packets: DataFrame, limits: Limits = Limits(), order: Sequence[str] = (), end_reason: str = "replay_end") -> DataFrame:
    """Complete flows of TCP packets.

    A flow ends by max_packets, tcp_close, idle_timeout, active_timeout or at the end of the data; flows of fewer than
    min_packets are dropped. Of two deadlines that have passed the earlier counts, idle in a tie. Packets without a time are
    left out, a null address or port is a value of its own.

    The slices of a busy key are many tasks; what goes over an edge of slices is assembled in a second pass by key. Only a key
    that is neither silent nor closed over many slices passes there as a whole.
    """
    names = [name for name, _ in _FLOW_FIELDS]
    first = materialize(assemble_slices(packets, limits, order), "assembled")
    kind = F.col("kind")
    packet = first.columns[first.columns.index("lo_ip") : -1]
    rest = first.where(kind == PACKET).select(*packet, F.lit(0).cast("long").alias("slice"), "since").repartition(*ENDS).sortWithinPartitions(*ENDS, "ts_us", *order)
    late = _assembled(rest, limits, first.schema, None).unionByName(first.where(kind == OPEN)).select("kind", *names)
    # what is open at the last packet of its key ends with the data
    ends = first.where(kind == LAST).groupBy(*(F.col(c).alias(f"_{c}") for c in ENDS)).agg(F.max("ended_us").alias("last_us"))
    late = with_key(late).join(ends, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ENDS], "left")
    reason = F.when((kind == OPEN) & (F.col("ended_us") == F.col("last_us")), F.lit(end_reason)).otherwise(F.col("close_reason"))
    return first.where(kind == FLOW).select(*names).unionByName(late.withColumn("close_reason", reason).select(*names))


def summarize(flows: DataFrame) -> DataFrame:
    """Adds packet_count, absolute_bytes, duration_us and max_abs_size of the columns sizes, started_us and ended_us."""
    sizes = F.transform("sizes", lambda x: F.abs(x).cast("long"))
    return flows.withColumns({
        "packet_count": F.size("sizes"), "absolute_bytes": F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x),
        "duration_us": F.greatest(F.lit(0).cast("long"), F.col("ended_us") - F.col("started_us")), "max_abs_size": F.coalesce(F.array_max(sizes), F.lit(0).cast("long")),
    })


def parse_vector(text: Column, kind: str = "double", drop_empty: bool = False) -> Column:
    """Comma list to numbers; null for `(empty)`, `-`, the empty text and lists with an item that is no number."""
    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    if drop_empty:
        items = F.filter(items, lambda x: x != "")
    numbers = F.transform(items, lambda x: x.try_cast(kind))
    missing = text.isNull() | F.trim(text).isin("(empty)", "-", "")
    return F.when(missing | F.exists(numbers, lambda x: x.isNull()), F.lit(None)).otherwise(numbers)
