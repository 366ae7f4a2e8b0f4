"""Joins of alerts with logs, evidence and cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.session import materialize

# Status of a case, and the sources of a bundle.
CASE_STATES = ("new", "in_review", "escalated", "closed")
SOURCES = ("siem", "conn", "ids", "snapshots", "knowledge")


#: Each level of cells is so many times as wide as the one below; with a second at the least the last is beyond any window.
FACTOR, MOST_LEVELS = 8, 17


def interval_join(alerts: DataFrame, logs: DataFrame, margin_us: int, most: int | None = 50, bucket_us: int | None = None, alert_id: str = "alert_id", order: Sequence[str] = ("ts_us",)) -> DataFrame:
    """Log rows (ip, ts_us, ...) of the alert's src_ip from start_us - margin to end_us + margin, at most `most` for each alert, earliest first.

    Time is cut into cells on levels that grow by FACTOR. An alert goes to the lowest level whose cells are no shorter than
    its window, so to one or two cells however long the window is, and meets log rows by equal ip and cell; log rows go to
    the levels that alerts use. A busy host is spread over time, and no pair far outside the window is formed. Where only the
    first `most` by time are wanted, no others are formed, see _first_of. Alerts and log rows without a time or an address
    meet nothing.
    """
    width = bucket_us or max(1_000_000, 4 * margin_us)
    if most is not None and order[0] == "ts_us":
        return _first_of(alerts, logs, margin_us, most, width, alert_id, order)
    widths = F.array(*(F.lit(min(width * FACTOR**k, 2**62)) for k in range(MOST_LEVELS)))
    cell = lambda time, level: F.col(time) - F.pmod(F.col(time), F.element_at(widths, level + 1))
    window = alerts.withColumns({"_from": F.col("start_us") - margin_us, "_to": F.col("end_us") + margin_us})
    window = window.withColumn("_level", F.size(F.filter(widths, lambda w: w < F.col("_to") - F.col("_from"))))
    levels = [r[0] for r in window.select("_level").distinct().collect()]  # MOST_LEVELS at most
    window = window.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("_from", F.col("_level")), cell("_to", F.col("_level")))))).withColumnRenamed("src_ip", "_ip")
    rows = logs.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    rows = rows.withColumn("_cell", cell("ts_us", F.col("_level"))).withColumnRenamed("ip", "_ip")
    pairs = window.join(rows, ["_ip", "_level", "_cell"]).where(F.col("ts_us").between(F.col("_from"), F.col("_to"))).drop("_level", "_cell", "_from", "_to")
    pairs = pairs.withColumnRenamed("_ip", "src_ip")
    if most is not None:
        # Spark limits each alert's rows in the tasks of the join already, before they are shuffled
        pairs = pairs.withColumn("_no", F.row_number().over(Window.partitionBy(alert_id).orderBy(*order))).where(F.col("_no") <= most).drop("_no")
    return pairs


def _first_of(alerts: DataFrame, logs: DataFrame, margin_us: int, most: int, width: int, alert_id: str, order: Sequence[str]) -> DataFrame:
    """interval_join by places: the log rows of an address are numbered by time, and a window takes the `most` after those before its begin.

    Places are counted inside cells of time, to which one small row for each cell adds what stands before it. Log rows are
    gathered by `most`, each also with the ones before, so a window meets one such row, however many log rows it spans.
    """
    window = alerts.withColumns({"_from": F.col("start_us") - margin_us, "_to": F.col("end_us") + margin_us}).where("src_ip is not null and _from <= _to")
    rows = logs.where("ip is not null and ts_us is not null")
    kept, own = [c for c in alerts.columns if c != "src_ip"], [c for c in rows.columns if c != "ip"]
    begins = window.select(F.col("src_ip").alias("_ip"), F.col("_from").alias("_at"), F.struct(*kept, "_to").alias("_w"))
    held = rows.select(F.col("ip").alias("_ip"), F.col("ts_us").alias("_at"), F.struct(*own).alias("_l"))
    both = begins.unionByName(held, allowMissingColumns=True).withColumn("_cell", F.col("_at") - F.pmod("_at", F.lit(width)))
    before = F.sum("_n").over(Window.partitionBy("_ip").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = both.groupBy("_ip", "_cell").agg(F.count("_l").alias("_n")).select("_ip", "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    # a window that begins with a log row takes it
    inside = Window.partitionBy("_ip", "_cell").orderBy("_at", F.col("_l").isNotNull(), *(F.col("_l")[c] for c in order[1:])).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_place", F.count("_l").over(inside)).join(cells, ["_ip", "_cell"]).withColumn("_place", F.col("_place") + F.col("_before"))
    placed = materialize(placed.select("_ip", "_w", "_l", "_place"), "placed")
    of = F.expr(f"(_place - 1) div {most}")
    lists = placed.where("_l is not null").withColumn("_part", F.explode(F.array(of, of - 1))).groupBy("_ip", "_part").agg(F.collect_list(F.struct("_place", "_l")).alias("_ls"))
    asked = placed.where("_w is not null").select("_ip", "_w", F.col("_place").alias("_passed"), F.expr(f"_place div {most}").alias("_part"))
    fits = lambda x: (x["_place"] > F.col("_passed")) & (x["_place"] <= F.col("_passed") + most) & (x["_l"]["ts_us"] <= F.col("_w")["_to"])
    pairs = asked.join(lists, ["_ip", "_part"]).select("_ip", "_w", F.explode(F.transform(F.filter("_ls", fits), lambda x: x["_l"])).alias("_l"))
    pairs = pairs.select(F.col("_ip").alias("src_ip"), *(F.col("_w")[c].alias(c) for c in kept), *(F.col("_l")[c].alias(c) for c in own))
    # an alert's id may have several windows
    return pairs.withColumn("_no", F.row_number().over(Window.partitionBy(alert_id).orderBy(*order))).where(F.col("_no") <= most).drop("_no")


def connections_by_ip(conn: DataFrame) -> DataFrame:
    """A row for either end of each connection, one if both are equal."""
    return conn.withColumn("ip", F.explode(F.array_distinct(F.array("orig_h", "resp_h"))))


def alert_connections(alerts: DataFrame, conn: DataFrame, margin_us: int = 30_000_000, most: int = 50) -> DataFrame:
    return interval_join(alerts, connections_by_ip(conn).withColumnRenamed("uid", "conn_uid"), margin_us, most, order=("ts_us", "conn_uid"))


def alert_ids(alerts: DataFrame, ids: DataFrame, margin_us: int = 30_000_000, most: int = 50) -> DataFrame:
    rows = ids.withColumn("ip", F.explode(F.array_distinct(F.array(F.col("src_ip"), F.col("dest_ip"))))).select("ip", "ts_us", "signature", F.col("event_id").alias("ids_id"))
    return interval_join(alerts, rows, margin_us, most, order=("ts_us", "ids_id"))


def gathered(pairs: DataFrame, name: str, columns: Sequence[str], order: Sequence[str], most: int, alert_id: str = "alert_id") -> DataFrame:
    """alert_id with an array of its first `most` rows in that order."""
    w = Window.partitionBy(alert_id).orderBy(*order)
    kept = pairs.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= most)
    return kept.groupBy(alert_id).agg(F.transform(F.sort_array(F.collect_list(F.struct("_no", F.struct(*columns).alias("r")))), lambda x: x["r"]).alias(name))


def evidence_bundle(alerts: DataFrame, sources: dict[str, tuple[DataFrame, Sequence[str], Sequence[str], int]], snapshots: dict[str, str] | None = None, alert_id: str = "alert_id") -> DataFrame:
    """alerts with an array column for each source.

    A source is (rows that hold the alert's id, columns, order, most rows): pairs of interval_join, or rows joined by id. Each
    is cut before it is gathered, and joined back on the alert alone. snapshots names for a source the array of records in
    the rows of the source `snapshots` that are added to it, each record once.
    """
    out = alerts
    for name, (pairs, columns, order, most) in sources.items():
        own = [c for c in pairs.columns if c != alert_id]
        out = out.join(gathered(pairs.select(alert_id, *own), name, columns, order, most, alert_id), alert_id, "left").withColumn(name, F.coalesce(name, F.array()))
    for name, records in (snapshots or {}).items():
        out = out.withColumn(name, F.array_union(name, F.flatten(F.transform("snapshots", lambda r: r[records]))))
    return out


def merge_unique(left: DataFrame, right: DataFrame, columns: Sequence[str] = ("alert_id", "record")) -> DataFrame:
    """Evidence of both sides, each record once for an alert."""
    return left.select(*columns).unionByName(right.select(*columns)).dropDuplicates(list(columns))


def coverage(bundle: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Adds missing (names of sources without rows), ready and n_sources."""
    empty = lambda s: F.coalesce(F.size(s), F.lit(0)) == 0
    missing = F.array_compact(F.array(*(F.when(empty(s), F.lit(s)) for s in sources)))
    return bundle.withColumn("missing", missing).withColumns({"ready": F.lit(len(sources)) - F.size("missing"), "n_sources": F.lit(len(sources))})


def alert_key(*ids: Column) -> Column:
    """The first id that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.trim(i), F.lit("")) for i in ids))


def new_cases(alerts: DataFrame, cases: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A new case for each alert_key without one; and one row with created, existing and unidentified alerts."""
    keyed = alerts.where("alert_key is not null")
    known = cases.select("alert_key").distinct()
    first = keyed.withColumn("_no", F.row_number().over(Window.partitionBy("alert_key").orderBy(*order))).where("_no = 1").drop("_no")
    marked = first.join(known.withColumn("_known", F.lit(True)), "alert_key", "left")
    created = marked.where("_known is null").drop("_known").withColumn("status", F.lit("new"))
    counts = marked.agg(F.count_if(F.col("_known").isNull()).alias("created"), F.count_if("_known").alias("existing")).join(F.broadcast(alerts.agg(F.count_if(F.col("alert_key").isNull()).alias("unidentified"))))
    return created, counts


def latest_case(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """alerts with the newest case of their alert_key, or null."""
    newest = cases.groupBy("alert_key").agg(F.max_by(F.struct("case_id", "status", "created_us"), F.struct("created_us", "case_id")).alias("case"))
    return alerts.join(newest, "alert_key", "left")


def pending_captures(found: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    return found.join(processed.select(key), key, "left_anti")


def evidence_edges(bundle: DataFrame) -> DataFrame:
    """alert_id, src, dst, active: the fixed graph of an alert's evidence; active where the target has rows."""
    has = lambda s: F.coalesce(F.size(s), F.lit(0)) > 0
    edges = [("src_ip", "alert", F.lit(True)), ("src_ip", "conn", has("conn")), ("src_ip", "ids", has("ids")), ("src_ip", "dst_ip", F.lit(True)), ("alert", "siem", has("siem")), ("alert", "knowledge", has("knowledge"))]
    name = lambda n: F.col(n) if n in ("src_ip", "dst_ip") else F.lit(n)
    return bundle.select("alert_id", F.inline(F.array(*(F.struct(name(a).alias("src"), name(b).alias("dst"), on.alias("active")) for a, b, on in edges))))


def host_graph(edges: DataFrame) -> DataFrame:
    return edges.where("active").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
