"""Streaming jobs: flows, windows, deduplicated events, evidence, sensor states, case sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trafficjobs.operators._flow_kernel import Packets, Rest
from trafficjobs.operators.correlate import new_cases
from trafficjobs.operators.flows import ENDS, FLOW_SCHEMA, KEY, Limits, flow_batch, idle_spans, tcp_only, with_key
from trafficjobs.sources.sinks import latest_status

#: Groups of connections that a flow stream deals its state to. A task holds a batch's packets of one group.
GROUPS = 1024
_HELD = {
    "lo_ip": "array<string>", "lo_port": "array<int>", "hi_ip": "array<string>", "hi_port": "array<int>", "since": "array<long>", "packets": "array<int>",
    "ts_us": "array<long>", "by_lo": "array<boolean>", "ip_length": "array<int>", "tcp_flags": "array<int>",
}
_ENDS, _KINDS = pa.schema(list(zip(ENDS, (pa.string(), pa.int32(), pa.string(), pa.int32())))), (np.int64, bool, np.int64, np.int64)
_STATE = Row("sensor_id", "state", "at_us")


def with_event_time(rows: DataFrame, column: str = "ts_us", delay: str = "5 seconds") -> DataFrame:
    """Adds ts, the event time, with a watermark."""
    return rows.withColumn("ts", F.timestamp_micros(column)).withWatermark("ts", delay)


class OpenFlow:
    """What one key has open: the packets (ts_us, by_lo, ip_length, tcp_flags) of its flow, or the last packet and where a full flow's tail began."""

    def __init__(self, limits: Limits, key: tuple, saved: tuple[list, int | None] | None = None):
        self.limits, self.key = limits, key
        self.rows, self.since = saved or ([], None)
        self.open = bool(self.rows) and self.since is None

    def saved(self) -> tuple[list, int | None] | None:
        return (self.rows, self.since) if self.open or self.since is not None else None

    def _packets(self, rows: list) -> Packets:
        ts, lo, length, flags = (np.array([r[k] for r in rows], dtype=kind) for k, kind in enumerate((np.int64, bool, np.int64, np.int64)))
        return Packets(ts, lo, length, flags, np.full(len(rows), self.key[:2] == self.key[2:4]), self.limits)

    def _out(self, packets: Packets, found: list) -> list[tuple]:
        """Rows of FLOW_SCHEMA."""
        if not found:
            return []
        c = packets.columns(found)
        sizes, offsets, ends = c["sizes"].tolist(), c["offsets_us"].tolist(), c["ends"].tolist()
        lo, hi = tuple(self.key[:2]), tuple(self.key[2:4])
        rows = zip(c["begun_by_lo"].tolist(), c["started_us"].tolist(), c["ended_us"].tolist(), ends, ends[1:], c["close_reason"])
        return [(*((*lo, *hi) if by_lo else (*hi, *lo)), "tcp", start, end, sizes[a:b], offsets[a:b], why) for by_lo, start, end, a, b, why in rows]

    def add(self, rows: list) -> list[tuple]:
        """Flows that ended, after ordered packets."""
        met = 0 if self.open else len(self.rows)
        # late packets take their place among those of the open flow
        rows = self.rows + rows if met else sorted(self.rows + rows, key=lambda r: r[0])
        packets = self._packets(rows)
        found, rest = packets.cut(met, len(rows), Rest(since=self.since))
        self.open, self.since = rest.first is not None, rest.since
        self.rows = rows[rest.first :] if self.open else rows[-1:]
        return self._out(packets, found)

    def due(self) -> tuple[int, str] | None:
        """When the state ends unless a packet comes, and why."""
        if self.open or self.since is not None:
            return Packets.due(self, self.rows[0][0] if self.open else self.since, self.rows[-1][0])
        return None

    def end(self, reason: str) -> list[tuple]:
        """The open flow, if there is one."""
        out = self._out(self._packets(self.rows), [(0, len(self.rows), reason)]) if self.open else []
        self.rows, self.since, self.open = [], None, False
        return out


class OpenFlows:
    """What OpenFlow is to one connection, for many at once: their endpoints, where full flows' tails began, how many packets each has kept, and these, one connection after the other."""

    def __init__(self, limits: Limits, saved: tuple[list, ...] | None = None):
        *ends, since, counts, ts, lo, length, flags = saved or [[]] * len(_HELD)
        self.limits, self.keys, self.since, self.timer = limits, pa.table(ends, schema=_ENDS), since, None
        self.counts = np.array(counts, dtype=np.int64)
        self.packets = [np.array(x, dtype=kind) for x, kind in zip((ts, lo, length, flags), _KINDS)]

    def saved(self) -> tuple[list, ...]:
        return (*(c.to_pylist() for c in self.keys.columns), self.since, self.counts.tolist(), *(x.tolist() for x in self.packets))

    @staticmethod
    def _ends(keys: pa.Table) -> Iterator[tuple]:
        return zip(*(c.to_pylist() for c in keys.columns))

    def step(self, mark_us: int, ends: pa.Table | None = None, counts: np.ndarray | None = None, packets: Sequence[np.ndarray] = (), ties: Sequence[np.ndarray] = ()) -> pa.RecordBatch:
        """Flows that ended, as a batch of FLOW_SCHEMA: by packets that are newer than the mark, and by deadlines up to it.

        ends has a row for each run of packets of one connection, and counts their numbers; ties orders packets of one time. timer is the
        first deadline then, in milliseconds.
        """
        if ends is None:
            ends, counts, packets = self.keys.schema.empty_table(), np.array([], dtype=np.int64), [x[:0] for x in self.packets]
        n, held, known = len(self.counts), len(self.packets[0]), {}
        number = np.array([known.setdefault(k, len(known)) for k in (*self._ends(self.keys), *self._ends(ends))], dtype=np.int64)
        keys, own = pa.table(list(zip(*known)) or [[]] * len(ENDS), schema=_ENDS), np.array([k[:2] == k[2:] for k in known], dtype=bool)
        fresh = packets[0] > mark_us
        of = np.concatenate((np.repeat(number[:n], self.counts), np.repeat(number[n:], counts)[fresh]))
        ts, lo, length, flags = (np.concatenate((a, b[fresh])) for a, b in zip(self.packets, packets))
        # late packets take their place among those of an open flow, and follow the last one of a tail
        tail = np.array([s is not None for s in self.since], dtype=bool)
        place = np.where(np.pad(np.repeat(tail, self.counts), (0, len(ts) - held)), np.iinfo(np.int64).min, ts)
        new = np.arange(len(ts)) >= held
        order = np.lexsort((*(np.concatenate((np.zeros(held, dtype=x.dtype), x[fresh])) for x in reversed(ties)), new, place, of))
        of, ts, lo, length, flags = (x[order] for x in (of, ts, lo, length, flags))
        p, found, kept = Packets(ts, lo, length, flags, own[of], self.limits), [], []
        edges = np.searchsorted(of, np.arange(len(known) + 1)).tolist()
        for k, (at, end) in enumerate(zip(edges, edges[1:])):
            if at == end:
                continue
            begun = self.since[k] if k < n else None
            flows, rest = p.cut(at + (begun is not None), end, Rest(since=begun))
            found += flows
            if rest.first is None and rest.since is None:
                continue
            first = end - 1 if rest.first is None else rest.first
            due, why = p.due(p.times[first] if rest.since is None else rest.since, p.times[end - 1])
            ms = -(-due // 1000)
            if ms * 1000 > mark_us:
                kept.append((k, first, end, rest.since, ms))
            elif rest.first is not None:
                found.append((first, end, why))
        out = flow_batch(keys, p, found, of)
        which, first, end = (np.array([x[k] for x in kept], dtype=np.int64) for k in range(3))
        self.keys, self.since, self.counts = keys.take(pa.array(which)), [x[3] for x in kept], end - first
        at = np.arange(self.counts.sum()) + np.repeat(first - np.cumsum(self.counts) + self.counts, self.counts)
        self.packets = [x[at] for x in (ts, lo, length, flags)]
        self.timer = min((x[4] for x in kept), default=None)
        return out

    def flush(self, reason: str) -> pa.RecordBatch:
        """The open flows, ended for that reason."""
        of, ends = np.repeat(np.arange(len(self.counts)), self.counts), np.cumsum(self.counts)
        own = np.array([k[:2] == k[2:] for k in self._ends(self.keys)], dtype=bool)
        p = Packets(*self.packets, own[of], self.limits)
        return flow_batch(self.keys, p, [(a, b, reason) for a, b, since in zip((ends - self.counts).tolist(), ends.tolist(), self.since) if since is None], of)


class FlowProcessor(StatefulProcessor):
    """The batch job's cut with what it leaves kept for each group of connections; an event-time timer closes flows that go silent.

    A group's state is one typed value: OpenFlows' lists, and the time that its timer is set to, the first deadline of its
    connections. It is read once and written once for a batch, so calls between Python and the state grow with the groups;
    the timer is set anew only where that deadline moves.
    """

    def __init__(self, limits: Limits, ties: int):
        self.limits, self.ties = limits, ties

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", ", ".join(f"{k} {t}" for k, t in (*_HELD.items(), ("timer", "long"))))

    def _step(self, mark_us: int, *given) -> Iterator[pd.DataFrame]:
        *saved, timer = self.state.get() or (None,)
        held = OpenFlows(self.limits, saved or None)
        out = held.step(mark_us, *given)
        if given and timer is not None and held.timer != timer:  # one that has expired goes by itself
            self.handle.deleteTimer(timer)
        if held.timer is not None:
            self.state.update((*held.saved(), held.timer))
            if held.timer != timer:
                self.handle.registerTimer(held.timer)
        elif timer is not None:
            self.state.clear()
        if len(out):
            yield out.to_pandas()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(rows, ignore_index=True)
        column = [found.iloc[:, k] for k in range(found.shape[1])]
        ends = pa.Table.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(column[1:5], _ENDS.types)], schema=_ENDS)
        ts, *ties, lo, length, flags = (np.concatenate(c.to_list()) for c in column[5 : 9 + self.ties])
        packets = [x.astype(kind, casting="safe") for x, kind in zip((ts, lo, length, flags), _KINDS)]
        ties = [x if x.dtype.kind in "iu" else pd.factorize(x, sort=True)[0] for x in ties]
        yield from self._step(timerValues.getCurrentWatermarkInMs() * 1000, ends, np.array([len(x) for x in column[5]]), packets, ties)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def flush_flows(spark: SparkSession, checkpoint: str, limits: Limits = Limits(), reason: str = "shutdown") -> DataFrame:
    """The flows that a stopped flow_stream has left open in its state, ended for that reason. checkpoint is its checkpoint folder."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):  # a group is many connections
                held = OpenFlows(limits, [batch.column(k)[row].as_py() for k in range(len(_HELD))])
                yield held.flush(reason)

    return state.select(*(F.col(f"value.{k}") for k in _HELD)).mapInArrow(run, FLOW_SCHEMA)


def _packed(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each key of an Arrow batch with lists of its packets, since rows cost more than what they hold on their way to a state; last_us is the newest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(list(ENDS), use_threads=False).aggregate([("ts_us", "max"), *((c, "list") for c in columns)])
            yield from found.select([*ENDS, "ts_us_max", *(f"{c}_list" for c in columns)]).rename_columns([*ENDS, "last_us", *columns]).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    return keyed.select(*ENDS, *columns).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in ENDS), "last_us long", *(f"`{c}` array<{kinds[c]}>" for c in columns)]))


def flow_stream(packets: DataFrame, limits: Limits = Limits(), delay: str = "5 seconds", order: tuple[str, ...] = (), groups: int = GROUPS) -> DataFrame:
    """Flows of a packet stream. Needs the RocksDB state store; packets at the watermark or before it, and those without a time, are dropped.

    Connections are dealt to groups by hash, and a group is one state; their number holds for the whole life of a checkpoint.
    """
    by_lo = F.col("src_ip").eqNullSafe(F.col("lo_ip")) & F.col("src_port").eqNullSafe(F.col("lo_port"))
    keyed = with_key(tcp_only(packets)).where("ts_us is not null").withColumn("by_lo", by_lo)
    columns = ["ts_us", *order, "by_lo", "ip_length", "tcp_flags"]
    packed = with_event_time(_packed(keyed, columns), "last_us", delay).select(F.pmod(F.xxhash64(*ENDS), F.lit(groups)).alias("_group"), *ENDS, *columns, "ts")
    return packed.groupBy("_group").transformWithStateInPandas(FlowProcessor(limits, len(order)), FLOW_SCHEMA, "append", "eventTime")


class SensorProcessor(StatefulProcessor):
    """Transitions of a sensor: healthy at its first sign of life, stale when a limit passes without one, healthy again at the next."""

    def __init__(self, sensor: str, time: str, limit_us: int):
        self.sensor, self.time, self.limit_us = sensor, time, limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sensor", "last long, timer long")  # no timer: stale

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, timer = self.state.get() if self.state.exists() else (None, None)
        stale, out = last is not None and timer is None, []
        for t in sorted(r[self.time] for r in rows):
            if last is not None and t <= last:
                continue
            if last is not None and t - last > self.limit_us and not stale:
                out.append(("stale", last + self.limit_us))
                stale = True
            if last is None or stale:
                out.append(("healthy", t))
            last, stale = t, False
        due = -(-(last + self.limit_us + 1) // 1000)
        if not stale and due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.state.update((last, timer))
        yield from (_STATE(key[0], *x) for x in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, timer = self.state.get()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((last, None))
            yield _STATE(key[0], "stale", last + self.limit_us)

    def close(self) -> None:
        pass


def sensor_transitions(beats: DataFrame, sensor: str = "sensor_id", time: str = "observed_us", limit_s: int = 45, delay: str = "5 seconds") -> DataFrame:
    """sensor_id, state, at_us: where sensors turn healthy or stale, once each. Needs the RocksDB state store; a sign of life without a time or a sensor is dropped."""
    known = with_event_time(beats.where(F.col(time).isNotNull() & F.col(sensor).isNotNull()), time, delay).select("ts", F.col(sensor).cast("string").alias("sensor_id"), F.col(time).cast("long").alias("at_us"))
    return known.groupBy("sensor_id").transformWithState(SensorProcessor("sensor_id", "at_us", limit_s * 1_000_000), "sensor_id string, state string, at_us long", "append", "eventTime")


def idle_windows(packets: DataFrame, delay: str = "5 seconds", idle_us: int = 30_000_000) -> DataFrame:
    """Session windows of each key, of a table by idle_spans. Spark joins events exactly one gap apart, flows end at it, hence the gap is a microsecond less."""
    if not packets.isStreaming:
        return idle_spans(with_key(packets).withColumn("bytes", F.col("ip_length")), idle_us, ("bytes",)).select(*KEY, "packets", "bytes", "first_us", "last_us")
    keyed = with_event_time(with_key(packets), delay=delay)
    return keyed.groupBy(*KEY, F.session_window("ts", f"{idle_us - 1} microseconds").alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.sum("ip_length").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")).drop("w")


def rotation_windows(packets: DataFrame, width: str = "5 seconds", delay: str = "5 seconds") -> DataFrame:
    return with_event_time(packets, delay=delay).groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.sum("ip_length").alias("bytes")).select(F.unix_micros("w.start").alias("start_us"), "packets", "bytes")


def alert_rate(alerts: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """Alerts of each source in sliding minutes."""
    return with_event_time(alerts, "start_us", delay).groupBy("src_ip", F.window("ts", "60 seconds", "15 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("src_ip", F.unix_micros("w.start").alias("start_us"), "n")


def distinct_events(events: DataFrame, time: str = "start_us", delay: str = "10 minutes", id_: str = "event_id") -> DataFrame:
    """Each event id once within the watermark; with a checkpointed sink the output is exactly once."""
    return with_event_time(events, time, delay).dropDuplicatesWithinWatermark([id_])


def evidence_stream(alerts: DataFrame, conn: DataFrame, margin_s: int = 30, delay: str = "60 seconds") -> DataFrame:
    """Alerts with the connections of their source around them, left outer, of two streams."""
    a = with_event_time(alerts, "start_us", delay).withColumnRenamed("ts", "a_ts").withColumn("a_end", F.timestamp_micros("end_us"))
    c = with_event_time(conn.select("uid", F.col("orig_h").alias("ip"), "ts_us"), "ts_us", delay).withColumnRenamed("ts", "c_ts").withColumnRenamed("uid", "conn_uid")
    near = f"src_ip = ip AND c_ts >= a_ts - INTERVAL {margin_s} SECONDS AND c_ts <= a_ts + INTERVAL {margin_s} SECONDS"
    return a.join(c, F.expr(near), "left_outer").select("alert_id", "src_ip", "start_us", "conn_uid", "ts_us")


def keep_status(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table of one newest row for each sensor, written beside the old one; then its number is added to those that are whole. A repeated batch gives the same table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = newest_status(spark, path, number)
        if held is not None:
            batch = batch.unionByName(held.select(*batch.columns))
        latest_status(batch).write.mode("overwrite").parquet(f"{path}/{number}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(f"{path}/whole")

    return write


def newest_status(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest whole table that keep_status has written there, of the batches before a number if one is given; None if there is none."""
    try:
        whole = spark.read.schema("number long").parquet(f"{path}/whole")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    number = (whole if before is None else whole.where(F.col("number") < before)).agg(F.max("number")).first()[0]
    return None if number is None else spark.read.parquet(f"{path}/{number}")


def sync_cases(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over alerts (alert_key, start_us, alert_id): append a case for each new key. A repeated batch adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "alert_key string, start_us long, alert_id string, status string"
        try:
            cases = spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            cases = spark.createDataFrame([], schema)
        created, _ = new_cases(batch.select("alert_key", "start_us", "alert_id"), cases, ["start_us", "alert_id"])
        created.select("alert_key", "start_us", "alert_id", "status").write.mode("append").parquet(path)

    return write
