"""Queries that run streaming jobs to the end of the given tables (availableNow) and return what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficjobs.plans.catalog import query
from trafficjobs.plans.detect import ASSEMBLED_SQL
from trafficjobs.plans.views import duck, packets, view
from trafficjobs.session import materialize, scratch
from trafficjobs.streaming import jobs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/events.parquet"
    # as a pattern, since a file stream takes folders and patterns but no single file
    return view(spark, d, name, {"events": spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")})


def _ended(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    spark, path = stream.sparkSession, path or scratch(stream.sparkSession, label)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _each_batch(stream: DataFrame, write, path: str) -> None:
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _in_parts(rows: DataFrame, time: str, label: str, late=None) -> str:
    """A folder with the rows in three parts by time; late ones of the first part stand in the last."""
    path, n = scratch(rows.sparkSession, label), 3
    z = rows.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))  # one row
    part = F.least(F.lit(n - 1), F.floor((F.col(time) - F.col("_lo")) * n / (F.col("_hi") - F.col("_lo") + 1)))
    part = part if late is None else F.when((part == 0) & late, F.lit(n - 1)).otherwise(part)
    rows.join(F.broadcast(z)).withColumn("part", part).drop("_lo", "_hi").write.partitionBy("part").parquet(f"{path}/in")
    return path


def _restarted(rows: DataFrame, time: str, label: str, job, late=None) -> tuple[DataFrame, str]:
    """What the sink of a stream holds that ran to the end of each part and was started again from its checkpoint for the next; and the stream's folder."""
    spark, held = rows.sparkSession, rows.sparkSession.conf.get(PROVIDER)
    path = _in_parts(rows, time, label, late)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        for k in range(3):
            out = _ended(job(spark.readStream.schema(rows.schema).parquet(f"{path}/in/part=[{k}]")), label, path)
    finally:
        spark.conf.set(PROVIDER, held)
    return out, path


#: The watermark at the end, in microseconds of whole milliseconds; and the parts that arrive, what comes a part too late being dropped.
ARRIVED_SQL = """z AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM packets), mark AS (SELECT hi // 1000 * 1000 - 5000000 AS mark FROM z),
kept AS (SELECT packets.* FROM packets, z WHERE NOT ((ts_us - lo) * 3 // (hi - lo + 1) = 0 AND (event_id + i) % 13 = 5)),
"""
_HEAD, _TAIL = ASSEMBLED_SQL.split("k AS (SELECT *,", 1)
STREAMED_SQL = _HEAD + ARRIVED_SQL + "k AS (SELECT *," + _TAIL.replace("FROM packets)", "FROM kept)", 1)


@query(STREAMED_SQL + """ SELECT src_ip, src_port, dst_ip, dst_port, started_us, ended_us, array_to_string(sizes, ',') AS sizes, array_to_string(offsets_us, ',') AS offsets,
  CASE WHEN close_reason <> 'replay_end' THEN close_reason WHEN least(ended_us + 30000000, started_us + 120000000) > mark THEN 'shutdown' WHEN ended_us + 30000000 <= started_us + 120000000 THEN 'idle_timeout' ELSE 'active_timeout' END AS close_reason FROM flow, mark""")
def flow_stream(spark, d):
    """Three runs over one checkpoint, then what is open is flushed. A thirteenth of the first run's packets comes with the third, too late."""
    late = (F.col("event_id") + F.col("i")) % 13 == 5
    out, path = _restarted(packets(spark, d), "ts_us", "flows", lambda s: jobs.flow_stream(s, order=("event_id", "i")), late)
    out = out.unionByName(materialize(jobs.flush_flows(spark, f"{path}/checkpoint"), "flushed"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("src_ip", "src_port", "dst_ip", "dst_port", "started_us", "ended_us", text("sizes").alias("sizes"), text("offsets_us").alias("offsets"), "close_reason")


@query(duck("packets") + """z AS (SELECT max(ts_us) AS newest FROM packets), t AS (SELECT *, row_number() OVER (ORDER BY ts_us, event_id, i) AS no FROM packets WHERE i = 0)
SELECT event_id, ts_us FROM t, z WHERE ts_us >= newest - 86400000000 UNION ALL SELECT event_id, ts_us FROM t, z WHERE ts_us < newest - 86400000000 AND event_id % 2 = 0""")
def late_data_stream(spark, d):
    """First packets in two runs of a stream: those of even events, and of odd ones later, when what is a day older than the newest packet is late and dropped."""
    path = scratch(spark, "late")
    first = view(spark, d, "packets").where("i = 0").select("event_id", "ts_us")
    newest = first.join(view(spark, d, "packets").agg(F.max("ts_us").alias("newest")))
    first.where("event_id % 2 = 0").unionByName(newest.select(F.lit(None).cast("long").alias("event_id"), F.col("newest").alias("ts_us")).limit(1)).write.parquet(f"{path}/in/a")
    first.where("event_id % 2 = 1").write.parquet(f"{path}/in/b")
    for part in ("a", "b"):
        rows = spark.readStream.schema(first.schema).parquet(f"{path}/in/[{part}]")
        out = _ended(jobs.distinct_events(rows, "ts_us", "1 day", "event_id"), "late", path)
    return out.where("event_id is not null").select("event_id", "ts_us")


@query(duck("alerts") + "z AS (SELECT 1) SELECT alert_id, src_ip FROM alerts")
def distinct_event_stream(spark, d):
    alerts = _stream(spark, d, "alerts")
    return _ended(jobs.distinct_events(alerts.unionByName(_stream(spark, d, "alerts")), id_="alert_id", delay="60 days").select("alert_id", "src_ip"), "distinct")


@query(duck("alerts", "conn") + "z AS (SELECT 1) SELECT a.alert_id, c.uid AS conn_uid FROM alerts a JOIN conn c ON a.src_ip = c.orig_h AND abs(a.start_us - c.ts_us) <= 21600000000")
def evidence_stream(spark, d):
    pairs = jobs.evidence_stream(_stream(spark, d, "alerts"), _stream(spark, d, "conn"), 6 * 3600)
    return _ended(pairs.select("alert_id", "conn_uid"), "evidence").where("conn_uid is not null")


@query(duck("beats") + "r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY observed_us DESC, event_id DESC) AS no FROM beats) SELECT sensor_id, event_id, observed_us FROM r WHERE no = 1")
def sensor_status_stream(spark, d):
    """The newest table after three batches."""
    beats = view(spark, d, "beats")
    path = _in_parts(beats, "observed_us", "status")
    for k in range(3):
        _each_batch(spark.readStream.schema(beats.schema).parquet(f"{path}/in/part=[{k}]"), jobs.keep_status(f"{path}/table"), path)
    return jobs.newest_status(spark, f"{path}/table").select("sensor_id", "event_id", "observed_us")


@query(duck("beats") + """g AS (SELECT sensor_id, observed_us AS at_us, lag(observed_us) OVER w AS before, lead(observed_us) OVER w AS after FROM (SELECT DISTINCT sensor_id, observed_us FROM beats) b WINDOW w AS (PARTITION BY sensor_id ORDER BY observed_us)),
m AS (SELECT max(observed_us) // 1000 * 1000 - 5000000 AS mark FROM beats)
SELECT sensor_id, 'healthy' AS state, at_us FROM g WHERE before IS NULL OR at_us - before > 45000000
UNION ALL SELECT sensor_id, 'stale' AS state, at_us + 45000000 AS at_us FROM g, m WHERE after - at_us > 45000000 OR (after IS NULL AND at_us + 45000001 <= mark)""")
def sensor_transition_stream(spark, d):
    """Sensors that turn stale or healthy, over three runs of a stream."""
    return _restarted(view(spark, d, "beats"), "observed_us", "transitions", jobs.sensor_transitions)[0]


@query(duck("alerts") + "z AS (SELECT 'k' || (event_id % 300) AS alert_key, min(start_us) AS start_us FROM alerts GROUP BY 1) SELECT * FROM z")
def case_sync_stream(spark, d):
    path = scratch(spark, "cases")
    alerts = _stream(spark, d, "alerts").withColumn("alert_key", F.concat(F.lit("k"), (F.col("event_id") % 300).cast("string")))
    _each_batch(alerts, jobs.sync_cases(f"{path}/table"), path)
    return spark.read.parquet(f"{path}/table").select("alert_key", "start_us")


@query(duck("packets") + "z AS (SELECT 1), w AS (SELECT ts_us // 5000000 * 5000000 AS start_us, count(*) AS packets FROM packets GROUP BY 1) SELECT start_us, packets FROM w WHERE start_us + 5000000 <= (SELECT max(ts_us) // 1000 * 1000 - 5000000 FROM packets)")
def rotation_window_stream(spark, d):
    return _ended(jobs.rotation_windows(_stream(spark, d, "packets")).select("start_us", "packets"), "windows")
