"""Filters and searches over alerts, logs and sensor events."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.operators.events import allowed

# Names under which other products give the same thing.
ALIASES = {
    "score": ("malware_probability", "probability", "risk_score", "score", "confidence", "model_score", "ai_score", "p_malware"),
    "time": ("@timestamp", "timestamp", "ts", "time", "generated_at", "event_time"),
    "uid": ("uid", "zeek_uid", "connection_uid", "flow_uid"),
    "alert_id": ("alert_id", "id", "event_id", "rule_id", "alert_uid"),
    "src_ip": ("src_ip", "srcip", "source.ip", "id.orig_h"),
    "dst_ip": ("dst_ip", "dstip", "dest_ip", "destination.ip", "id.resp_h"),
}
STALE_US = 45_000_000


def _find(value, names: frozenset, empty_goes_on: bool):
    """Depth first; a key of the object itself goes before anything inside it, which then is not looked at. Null counts as nothing found there."""
    pending = [value]
    while pending:
        value = pending.pop()
        if isinstance(value, dict):
            own = [k for k in value if k in names and not (empty_goes_on and value[k] in (None, "", [], {}))][:1]
            if own:
                if value[own[0]] is not None:
                    return value[own[0]]
                continue
        if isinstance(value, (dict, list)):
            pending += reversed(list(value.values()) if isinstance(value, dict) else value)
    return None


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def _as_text(value):
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def find_first_alias(json_text: Column, names: Sequence[str], empty_goes_on: bool = False) -> Column:
    """The value, as text, of the first key in document order that is one of the names, on each level before deeper ones.

    An object whose first such key is null gives nothing, and what is inside it is not searched. With empty_goes_on null and
    empty values count as absent.
    """
    wanted = frozenset(names)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([_as_text(_find(_parsed(t), wanted, empty_goes_on)) for t in part.tolist()], index=part.index)

    return run(json_text)


def find_top_level(json_text: Column, names: Sequence[str]) -> Column:
    """The same for flat records, in built-ins: the first top-level key of the names, in document order."""
    key = F.filter(F.json_object_keys(json_text), lambda k: k.isin(*names))
    return F.when(F.size(key) > 0, F.element_at(F.from_json(json_text, "map<string,string>"), key[0]))


def leaves(json_text: Column) -> Column:
    """All leaf values as texts; store them once for any_value_equals."""

    def walk(value, out):
        if isinstance(value, dict):
            value = list(value.values())
        if isinstance(value, list):
            for v in value:
                walk(v, out)
        elif value is not None:
            out.append(_as_text(value))
        return out

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: walk(_parsed(t), []))

    return run(json_text)


def any_value_equals(leaf_texts: Column, value: str) -> Column:
    return F.array_contains(leaf_texts, value)


def contains_text(raw: Column, text: str) -> Column:
    return F.contains(F.lower(raw), F.lit(text.lower()))


def in_window(time: Column, start=None, end=None) -> Column:
    """Inclusive on both sides; rows without a time pass."""
    inside = F.lit(True)
    if start is not None:
        inside &= time >= start
    if end is not None:
        inside &= time <= end
    return time.isNull() | inside


def parse_time(text: Column) -> Column:
    """Epoch microseconds of an ISO text (UTC where no zone is given) or of epoch seconds; null if it is neither."""
    iso = F.unix_micros(text.try_cast("timestamp"))
    return F.coalesce((text.try_cast("decimal(20,6)") * 1_000_000).cast("long"), iso)


def filter_alerts(alerts: DataFrame, *, ip=None, uid=None, alert_id=None, start=None, end=None, least: float = 0.5, limit: int | None = 20, time: str = "start_us", order: Sequence[str] = ("start_us", "alert_id")) -> DataFrame:
    """Alerts of an ip at either end, uid and id, in the window, with a null score or at least `least`; the first `limit` in order."""
    test = in_window(F.col(time), start, end) & (F.col("prob").isNull() | (F.col("prob") >= least))
    if ip is not None:
        test &= (F.col("src_ip") == ip) | (F.col("dst_ip") == ip)
    if uid is not None:
        test &= F.col("uid") == uid
    if alert_id is not None:
        test &= F.col("alert_id") == alert_id
    found = alerts.where(test)
    return found.orderBy(*order).limit(limit) if limit is not None else found


def match_counts(alerts: DataFrame, **search) -> DataFrame:
    """One row: total and matched."""
    matched = filter_alerts(alerts, limit=None, **search).agg(F.count(F.lit(1)).alias("matched"))
    return alerts.agg(F.count(F.lit(1)).alias("total")).join(F.broadcast(matched))


def central_alerts(events: DataFrame, sensors: Sequence[str], order: Sequence[str], want: str = "ai_alert") -> tuple[DataFrame, DataFrame]:
    """Valid events, the first of each id; and one row with matched, quarantined and duplicates."""
    ok = allowed(F.col("schema_version"), F.col("event_type"), F.col("sensor_id"), want, sensors)
    marked = events.withColumn("_ok", ok).withColumn("_no", F.row_number().over(Window.partitionBy("_ok", "event_id").orderBy(*order)))
    counts = marked.agg(F.count_if(F.col("_ok") & (F.col("_no") == 1)).alias("matched"), F.count_if(~F.col("_ok")).alias("quarantined"), F.count_if(F.col("_ok") & (F.col("_no") > 1)).alias("duplicates"))
    return marked.where("_ok and _no = 1").drop("_ok", "_no"), counts


def connections(conn: DataFrame, ip=None, uid=None, start=None, end=None, limit: int = 50, ends: Sequence[str] = ("orig_h", "resp_h")) -> DataFrame:
    test = in_window(F.col("ts_us"), start, end)
    if ip is not None:
        test &= F.lit(ip).isin(*(F.col(c) for c in ends))
    if uid is not None:
        test &= F.col("uid") == uid
    return conn.where(test).orderBy("ts_us", "uid").limit(limit)


def ids_alerts(ids: DataFrame, ip=None, signature=None, start=None, end=None, limit: int = 50) -> DataFrame:
    test = in_window(F.col("ts_us"), start, end)
    if ip is not None:
        test &= (F.col("src_ip") == ip) | (F.col("dest_ip") == ip)
    if signature is not None:
        test &= contains_text(F.col("signature"), signature)
    return ids.where(test).orderBy("ts_us", "event_id").limit(limit)


def siem_search(alerts: DataFrame, ip=None, text=None, start=None, end=None, limit: int = 50, raw: str = "raw", ips: Sequence[str] = ("src_ip", "dst_ip"), tie: str = "alert_id") -> DataFrame:
    """Newest first."""
    test = in_window(F.col("ts_us"), start, end)
    if text is not None:
        test &= contains_text(F.col(raw), text)
    if ip is not None:
        test &= F.lit(ip).isin(*(F.col(c) for c in ips))
    return alerts.where(test).orderBy(F.desc("ts_us"), tie).limit(limit)


def sensor_events(events: DataFrame, event_type: str, sensors: Sequence[str], start=None, end=None, limit: int = 1000, tie: str = "event_id") -> DataFrame:
    test = (F.col("event_type") == event_type) & F.col("sensor_id").isin(*sensors) & in_window(F.col("ts_us"), start, end)
    return events.where(test).orderBy(F.desc("ts_us"), tie).limit(min(limit, 1000))


def snapshots_for(snapshots: DataFrame, alerts: DataFrame) -> DataFrame:
    """Snapshots of any of the alerts (alert_id)."""
    return snapshots.join(alerts.select(F.col("alert_id").alias("alert_event_id")).distinct(), "alert_event_id", "left_semi")


def sensor_health(beats: DataFrame, sensors: Sequence[str], now_us: int, stale_us: int = STALE_US) -> DataFrame:
    """sensor_id, last_us, age_us, state for every sensor of the list: healthy, stale, unknown (no time) or missing."""
    latest = beats.groupBy("sensor_id").agg(F.max("observed_us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    listed = beats.sparkSession.createDataFrame([(s,) for s in sensors], "sensor_id string")
    age = F.greatest(F.lit(0).cast("long"), F.lit(now_us) - F.col("last_us"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("last_us").isNull(), "unknown").when(age <= stale_us, "healthy").otherwise("stale")
    return F.broadcast(listed).join(latest, "sensor_id", "left").select("sensor_id", "last_us", F.when(F.col("last_us").isNotNull(), age).alias("age_us"), state.alias("state"))


def recent(rows: DataFrame, order: Sequence[Column], limit: int = 20) -> DataFrame:
    """The newest rows; the limit lies between 1 and 100."""
    return rows.orderBy(*order).limit(max(1, min(limit, 100)))


def recent_tasks(tasks: DataFrame, limit: int = 20) -> DataFrame:
    """The tasks created last."""
    return recent(tasks, [F.desc_nulls_last("created_us"), F.col("task_id")], limit)


def recent_reports(tasks: DataFrame, limit: int = 20) -> DataFrame:
    """The tasks with a report, the last finished first, then the last created. A finished task has finished_us."""
    return recent(tasks.where("finished_us is not null"), [F.desc("finished_us"), F.desc_nulls_last("created_us"), F.col("task_id")], limit)
