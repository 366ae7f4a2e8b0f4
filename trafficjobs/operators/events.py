"""Alert, evidence and heartbeat events: their identity, and that each counts once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.session import materialize, small

from trafficjobs.functions.scoring import predicted, risk_level

# Keys that evidence must not carry.
SECRET_KEYS = ("packet", "packet_info", "payload", "payload_printable")
# SIEM rule and level by event type and risk.
SIEM_RULES = (
    ("ai_alert", "low", 110101, 5),
    ("ai_alert", "medium", 110102, 8),
    ("ai_alert", "high", 110103, 12),
    ("evidence_snapshot", None, 110104, 3),
    ("sensor_heartbeat", None, 110105, 1),
    (None, None, 110100, 3),
)


def seconds_text(micros: Column) -> Column:
    """Seconds with up to six decimals, at least one: 10.0, 0.25."""
    text = (micros.cast("decimal(26,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(26,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")


def alert_event_id(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column, start_us: Column, sensor: Column, model: Column) -> Column:
    """SHA-256 of the compact JSON, keys sorted, of flow, model and sensor."""
    text = F.concat(
        F.lit('{"flow":["'), src_ip, F.lit('",'), src_port.cast("string"), F.lit(',"'), dst_ip, F.lit('",'), dst_port.cast("string"), F.lit(',"'), protocol, F.lit('",'), seconds_text(start_us),
        F.lit('],"model_sha256":"'), model, F.lit('","sensor_id":"'), sensor, F.lit('"}'),
    )
    return F.sha2(text, 256)


def build_alerts(flows: DataFrame, model: str, sensor: Column, threshold: float = 0.5, score: str = "probability") -> DataFrame:
    """Nested alert events of the scored flows with at least the threshold."""
    kept = flows.where(F.col(score) >= threshold)
    id_ = alert_event_id(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"), F.col("started_us"), sensor, F.lit(model))
    flow = F.struct("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "started_us", "ended_us", "close_reason")
    return kept.select(
        F.lit(1).alias("schema_version"), F.lit("ai_alert").alias("event_type"), id_.alias("event_id"), sensor.alias("sensor_id"), F.timestamp_micros("ended_us").alias("observed_at"), flow.alias("flow"),
        F.struct(F.lit(model).alias("sha256")).alias("model"), predicted(F.col(score), threshold).alias("prediction"), F.col(score).alias("malware_probability"), risk_level(F.col(score)).alias("risk_level"),
        F.struct("packet_count", "absolute_bytes", "duration_us", "max_abs_size").alias("summary"), F.struct("sizes", "offsets_us").alias("features"),
    )


def evidence_id(alert_id: Column) -> Column:
    return F.sha2(F.concat(alert_id, F.lit("|evidence_snapshot|1")), 256)


def build_snapshots(alerts: DataFrame, margin_us: int = 30_000_000) -> DataFrame:
    """Snapshot events of alerts (alert_id, sensor_id, start_us, end_us, conn, ids), whose evidence columns are arrays."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(c)
    return alerts.select(
        F.lit(1).alias("schema_version"), F.lit("evidence_snapshot").alias("event_type"), evidence_id(F.col("alert_id")).alias("event_id"), "sensor_id", F.col("alert_id").alias("alert_event_id"),
        F.struct((F.col("start_us") - margin_us).alias("start_us"), (F.col("end_us") + margin_us).alias("end_us")).alias("window"), F.struct("conn", "ids", F.struct(n("conn"), n("ids")).alias("summary")).alias("evidence"),
    )


def _public(fields: list[tuple]) -> dict:
    return {name: value for name, value in fields if name.lower() not in SECRET_KEYS}


def redact(json_text: Column) -> Column:
    """Free JSON without the secret keys at any depth, whatever their case; what is no JSON becomes null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            try:
                return json.dumps(json.loads(text, object_pairs_hook=_public), ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        for part in parts:
            yield part.map(one)

    return run(json_text)


def heartbeat_id(sensor: Column, observed_us: Column) -> Column:
    """SHA-256 of sensor, type and the time in ISO form, UTC, with microseconds."""
    time = F.date_format(F.timestamp_micros(observed_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.sha2(F.concat(sensor, F.lit("|sensor_heartbeat|"), time), 256)


def drop_rate(received: Column, dropped: Column) -> Column:
    """Null where nothing was received or the drops are unknown."""
    return F.when(received > 0, dropped / received)


def record_once(events: DataFrame, order: Sequence[str], id_: str = "event_id", stored: DataFrame | None = None) -> DataFrame:
    """The first event of each id; none that is stored already."""
    first = events.withColumn("_no", F.row_number().over(Window.partitionBy(id_).orderBy(*order))).where("_no = 1").drop("_no")
    return first if stored is None else first.join(stored.select(id_), id_, "left_anti")


def pending(outbox: DataFrame, emitted: DataFrame, created: str = "created_us") -> DataFrame:
    """Events not emitted yet, oldest first."""
    return outbox.join(emitted.select("event_id"), "event_id", "left_anti").orderBy(created, "event_id")


def unprocessed_files(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Of files (path, content), one of each content whose SHA-256 was not processed: path, signature."""
    signed = files.select("path", F.sha2("content", 256).alias("signature"))
    return signed.groupBy("signature").agg(F.min("path").alias("path")).join(processed.select("signature"), "signature", "left_anti").select("path", "signature")


def allowed(version: Column, event_type: Column, sensor: Column, want: str, sensors: Sequence[str]) -> Column:
    """Schema version 1, the wanted type and a sensor of the list."""
    return F.coalesce((version.try_cast("int") == 1) & (event_type == want) & sensor.isin(*sensors), F.lit(False))


def validate(events: DataFrame, want: str, sensors: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined events (schema_version, event_type, sensor_id)."""
    ok = allowed(F.col("schema_version"), F.col("event_type"), F.col("sensor_id"), want, sensors)
    return events.where(ok), events.where(~ok)


def running_totals(captures: DataFrame, order: Sequence[str], per: Sequence[str] = ("sensor_id",), columns: Sequence[str] = ("flows", "alerts"), bucket_us: int = 86_400_000_000) -> DataFrame:
    """Cumulative sums in each sensor's order of captures, whose first column is a time in microseconds.

    Sums of whole buckets of time are put in order first, and rows only within their bucket, so a long history is no single
    task. Rows without a time come first.
    """
    rows = captures.withColumn("_bucket", F.coalesce(F.floor(F.col(order[0]) / bucket_us), F.lit(-(2**62))))
    w = Window.partitionBy(*per).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*per, "_bucket").agg(*(F.sum(c).alias(f"_sum_{c}") for c in columns))
    sums = materialize(sums.select(*per, "_bucket", *(F.coalesce(F.sum(f"_sum_{c}").over(w), F.lit(0)).alias(f"_before_{c}") for c in columns)), "bucket-sums")
    inner = Window.partitionBy(*per, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = [rows[c].eqNullSafe(F.col(f"_key_{c}")) for c in (*per, "_bucket")]
    both = rows.join(small(sums.select(*(F.col(c).alias(f"_key_{c}") for c in (*per, "_bucket")), *(f"_before_{c}" for c in columns))), on)
    return both.withColumns({f"total_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"_before_{c}") for c in columns}).select(*captures.columns, *(f"total_{c}" for c in columns))


def siem_rules(spark) -> DataFrame:
    return spark.createDataFrame(SIEM_RULES, "rule_type string, rule_risk string, rule_id int, rule_level int")


def with_siem_rule(events: DataFrame) -> DataFrame:
    """events (event_type, risk_level) with rule_id and rule_level of the most specific rule; the rules are six rows."""
    rules = siem_rules(events.sparkSession)
    exact = F.broadcast(rules.where("rule_type is not null"))
    on = (F.col("event_type") == F.col("rule_type")) & (F.col("rule_risk").isNull() | (F.col("rule_risk") == F.col("risk_level")))
    other = next(r for r in SIEM_RULES if r[0] is None)
    joined = events.join(exact, on, "left").drop("rule_type", "rule_risk")
    return joined.withColumns({"rule_id": F.coalesce("rule_id", F.lit(other[2])), "rule_level": F.coalesce("rule_level", F.lit(other[3]))})
