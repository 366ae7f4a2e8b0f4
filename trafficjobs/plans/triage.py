"""Queries of the triage workload: searches, joins, cases, reports, retrieval."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.functions.scoring import risk_level
from trafficjobs.operators import cases as case_ops
from trafficjobs.operators import correlate, metrics, retrieval, search, sketches, text_index, vector_index
from trafficjobs.plans.catalog import query
from trafficjobs.plans.views import duck, view
from trafficjobs.session import scratch

TERMS = r"[\p{L}\p{N}_]+"


def _tfidf_sql(asked: str, base: str, k: int) -> str:
    """retrieval.tfidf_top in DuckDB as CTEs up to `answers`, for asked (qid, text) and base (id, text)."""
    return rf"""bt AS (SELECT id, unnest(regexp_extract_all(lower(text), '{TERMS}')) AS term FROM {base}), qt AS (SELECT qid, unnest(regexp_extract_all(lower(text), '{TERMS}')) AS term FROM {asked}),
b AS (SELECT id, term, count(*) AS tf FROM bt GROUP BY ALL), q AS (SELECT qid, term, count(*) AS tf FROM qt GROUP BY ALL), n AS (SELECT count(*) + 1 AS n FROM {base}), f AS (SELECT term, count(*) AS df FROM b GROUP BY 1),
qw AS (SELECT qid, q.term, q.tf * (ln((1.0 + n) / (1 + coalesce(df, 0) + 1)) + 1) AS w FROM q LEFT JOIN f ON q.term = f.term, n), qn AS (SELECT qid, sqrt(sum(w * w)) AS nq FROM qw GROUP BY 1),
bw AS (SELECT id, b.term, b.tf, df FROM b JOIN f ON b.term = f.term), whole AS (SELECT id, sum(pow(tf * (ln((1.0 + n) / (1 + df)) + 1), 2)) AS sq FROM bw, n GROUP BY 1),
x AS (SELECT qid, id, sum(w * tf * (ln((1.0 + n) / (2 + df)) + 1)) AS dot, sum(pow(tf * (ln((1.0 + n) / (2 + df)) + 1), 2) - pow(tf * (ln((1.0 + n) / (1 + df)) + 1), 2)) AS more FROM qw JOIN bw ON qw.term = bw.term, n GROUP BY 1, 2),
sc AS (SELECT x.qid AS query_id, x.id AS base_id, round(dot / (nq * sqrt(sq + more)), 6) AS score FROM x JOIN qn ON x.qid = qn.qid JOIN whole ON x.id = whole.id),
answers AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS INT) AS rank, base_id, CAST(round(score * 1000000) AS BIGINT) AS score FROM sc QUALIFY rank <= {k})"""


HOUR, DAY = 3_600_000_000, 86_400_000_000
T0, T1 = 1_704_067_200_000_000 + 5 * DAY, 1_704_067_200_000_000 + 20 * DAY


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def find_first_alias(spark, d):
    return view(spark, d, "events").select("event_id", search.find_first_alias(F.col("props"), ("k", "kk")).alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def find_top_level_alias(spark, d):
    return view(spark, d, "events").select("event_id", search.find_top_level(F.col("props"), ("k", "kk")).alias("k"))


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS VARCHAR) = '42'")
def any_value_equals(spark, d):
    return view(spark, d, "events").where(search.any_value_equals(search.leaves(F.col("props")), "42")).select("event_id")


@query("""SELECT event_id, event_type FROM events WHERE contains(lower(props), '"k": 1')""")
def contains_indexed(spark, d):
    """The same over a trigram index that two batches of records have been added to."""
    rows, path = view(spark, d, "events").select("event_id", "event_type", "props"), scratch(spark, "trigrams")
    for part in (0, 1):
        text_index.write(rows.where(F.col("event_id") % 2 == part), path, "event_id", "props")
    return text_index.search(rows, path, "event_id", "props", '"K": 1').select("event_id", "event_type")


@query("""SELECT event_id FROM events WHERE contains(lower(props), '"k": 1')""")
def contains_text(spark, d):
    return view(spark, d, "events").where(search.contains_text(F.col("props"), '"K": 1')).select("event_id")


@query(duck("alerts") + f"z AS (SELECT 1) SELECT alert_id, start_us FROM alerts WHERE start_us BETWEEN {T0} AND {T1}")
def time_window(spark, d):
    return view(spark, d, "alerts").where(search.in_window(F.col("start_us"), T0, T1)).select("alert_id", "start_us")


@query("SELECT event_id, epoch_us(ts) AS iso_us, epoch_us(ts) // 1000000 * 1000000 AS epoch_us FROM events")
def parse_time(spark, d):
    e = view(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    iso, number = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.unix_seconds("t").cast("string")
    return e.select("event_id", search.parse_time(iso).alias("iso_us"), search.parse_time(number).alias("epoch_us"))


@query(duck("alerts") + f"z AS (SELECT 1) SELECT alert_id, prob FROM alerts WHERE (src_ip = '10.0.0.7' OR dst_ip = '10.0.0.7') AND prob >= 0.5 AND start_us >= {T0} ORDER BY start_us, alert_id LIMIT 20")
def filter_alerts(spark, d):
    return search.filter_alerts(view(spark, d, "alerts"), ip="10.0.0.7", start=T0).select("alert_id", "prob")


@query(duck("alerts") + "z AS (SELECT 1) SELECT count(*) AS total, count(*) FILTER (dst_ip = '203.0.113.1' AND prob >= 0.7) AS matched FROM alerts")
def alert_match_counts(spark, d):
    return search.match_counts(view(spark, d, "alerts"), ip="203.0.113.1", least=0.7)


@query(duck("conn") + f"z AS (SELECT 1) SELECT uid, ts_us FROM conn WHERE ('10.0.0.9' = orig_h OR '10.0.0.9' = resp_h) AND ts_us <= {T1} ORDER BY ts_us, uid LIMIT 50")
def connection_context(spark, d):
    return search.connections(view(spark, d, "conn"), ip="10.0.0.9", end=T1).select("uid", "ts_us")


@query(duck("ids") + "z AS (SELECT 1) SELECT event_id, ts_us FROM ids WHERE (src_ip = '203.0.113.2' OR dest_ip = '203.0.113.2') AND contains(lower(signature), 'policy') ORDER BY ts_us, event_id LIMIT 50")
def ids_alerts(spark, d):
    return search.ids_alerts(view(spark, d, "ids"), ip="203.0.113.2", signature="POLICY").select("event_id", "ts_us")


@query(duck("alerts") + f"z AS (SELECT 1) SELECT alert_id, start_us AS ts_us FROM alerts WHERE start_us >= {T0} AND contains(lower(alert_id || ' ' || uid), 'c1') AND dst_ip = '203.0.113.0' ORDER BY start_us DESC, alert_id LIMIT 50")
def siem_search(spark, d):
    a = view(spark, d, "alerts").withColumns({"ts_us": F.col("start_us"), "raw": F.concat_ws(" ", "alert_id", "uid")})
    return search.siem_search(a, ip="203.0.113.0", text="C1", start=T0).select("alert_id", "ts_us")


@query(duck("alerts") + "z AS (SELECT 1) SELECT event_id, start_us AS ts_us FROM alerts WHERE sensor_id IN ('s1', 's3') ORDER BY start_us DESC, event_id LIMIT 1000")
def sensor_event_search(spark, d):
    a = view(spark, d, "alerts").withColumns({"event_type": F.lit("ai_alert"), "ts_us": F.col("start_us")})
    return search.sensor_events(a, "ai_alert", ["s1", "s3"], limit=5000).select("event_id", "ts_us")


@query(duck("alerts", "ids") + "z AS (SELECT 1) SELECT event_id FROM ids WHERE EXISTS (SELECT 1 FROM alerts WHERE alerts.event_id = ids.event_id - 1 AND prob >= 0.9)")
def snapshots_for_alert(spark, d):
    s = view(spark, d, "ids").withColumn("alert_event_id", F.concat(F.lit("a"), (F.col("event_id") - 1).cast("string")))
    return search.snapshots_for(s, view(spark, d, "alerts").where("prob >= 0.9")).select("event_id")


NOW = 1_704_067_200_000_000 + 29 * DAY


@query(duck("beats") + f"""l AS (SELECT 's' || range AS sensor_id FROM range(10)), m AS (SELECT sensor_id, max(observed_us) AS last_us FROM beats GROUP BY 1)
SELECT l.sensor_id, last_us, greatest(0, {NOW} - last_us) AS age_us, CASE WHEN last_us IS NULL THEN 'missing' WHEN {NOW} - last_us <= 45000000 THEN 'healthy' ELSE 'stale' END AS state FROM l LEFT JOIN m ON l.sensor_id = m.sensor_id""")
def sensor_health(spark, d):
    out = search.sensor_health(view(spark, d, "beats"), [f"s{i}" for i in range(10)], NOW)
    return out.withColumn("age_us", F.when(F.col("state") == "missing", F.lit(0)).otherwise(F.col("age_us")).cast("long"))


@query(duck("cases") + "z AS (SELECT 1) SELECT case_id, alert_key FROM cases ORDER BY created_us DESC, case_id DESC LIMIT 100")
def recent_cases(spark, d):
    return search.recent(view(spark, d, "cases"), [F.desc("created_us"), F.desc("case_id")], 500).select("case_id", "alert_key")


@query("""WITH t AS (SELECT conv_id AS task_id, count(*) AS n, max(CASE WHEN role = 'assistant' THEN turn END) AS finished, min(turn) AS created FROM conversations GROUP BY 1),
a AS (SELECT task_id, 'task' AS list FROM t ORDER BY n DESC, task_id LIMIT 20), b AS (SELECT task_id, 'report' AS list FROM t WHERE finished IS NOT NULL ORDER BY finished DESC, n DESC, task_id LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b""")
def recent_tasks_and_reports(spark, d):
    t = view(spark, d, "conversations").groupBy(F.col("conv_id").alias("task_id")).agg(F.count(F.lit(1)).alias("created_us"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("finished_us"))
    tasks, reports = search.recent_tasks(t), search.recent_reports(t)
    return tasks.select("task_id", F.lit("task").alias("list")).unionByName(reports.select("task_id", F.lit("report").alias("list")))


def _near(logs, on, extra, margin, most, order):
    return f"j AS (SELECT a.alert_id, {extra}, row_number() OVER (PARTITION BY a.alert_id ORDER BY {order}) AS no FROM alerts a JOIN {logs} l ON {on} AND l.ts_us BETWEEN a.start_us - {margin} AND a.end_us + {margin}) SELECT * EXCLUDE (no) FROM j WHERE no <= {most}"


@query(duck("alerts", "conn") + _near("conn", "(l.orig_h = a.src_ip OR l.resp_h = a.src_ip)", "l.uid AS conn_uid, l.ts_us", 6 * HOUR, 50, "l.ts_us, l.uid"))
def alert_connections(spark, d):
    return correlate.alert_connections(view(spark, d, "alerts"), view(spark, d, "conn"), 6 * HOUR).select("alert_id", "conn_uid", "ts_us")


@query(duck("alerts", "conn") + _near("conn", "(l.orig_h = a.src_ip OR l.resp_h = a.src_ip)", "l.uid AS conn_uid, l.ts_us", 5 * DAY, 2, "l.ts_us, l.uid"))
def alert_connections_capped(spark, d):
    return correlate.alert_connections(view(spark, d, "alerts"), view(spark, d, "conn"), 5 * DAY, 2).select("alert_id", "conn_uid", "ts_us")


_SPANS = (1, 60, 3600, 86_400, 30 * 86_400)


@query(duck("alerts", "conn") + f"""w AS (SELECT alert_id, src_ip, start_us, start_us + [{', '.join(map(str, _SPANS))}][event_id % 5 + 1] * CAST(1000000 AS BIGINT) AS end_us FROM alerts)
SELECT DISTINCT alert_id, c.uid AS conn_uid FROM w JOIN conn c ON (c.orig_h = src_ip OR c.resp_h = src_ip) AND c.ts_us BETWEEN start_us AND end_us""")
def alert_connections_long(spark, d):
    """Windows from a second to 30 days in one join."""
    span = F.element_at(F.array(*map(F.lit, _SPANS)), (F.col("event_id") % 5 + 1).cast("int")).cast("long") * 1_000_000
    a = view(spark, d, "alerts").select("alert_id", "src_ip", "start_us", (F.col("start_us") + span).alias("end_us"))
    return correlate.alert_connections(a, view(spark, d, "conn"), 0, None).select("alert_id", "conn_uid").distinct()


@query(duck("alerts", "ids") + _near("ids", "(l.src_ip = a.src_ip OR l.dest_ip = a.src_ip)", "l.event_id AS ids_id, l.signature", 12 * HOUR, 50, "l.ts_us, l.event_id"))
def alert_ids(spark, d):
    return correlate.alert_ids(view(spark, d, "alerts"), view(spark, d, "ids"), 12 * HOUR).select("alert_id", "ids_id", "signature")


def _bundle(spark, d):
    a = view(spark, d, "alerts")
    conn = correlate.alert_connections(a.select("alert_id", "src_ip", "start_us", "end_us"), view(spark, d, "conn").select("uid", "orig_h", "resp_h", "ts_us"), 6 * HOUR, 50)
    ids = correlate.alert_ids(a.select("alert_id", "src_ip", "start_us", "end_us"), view(spark, d, "ids"), 12 * HOUR, 50)
    of_sensor = a.select("alert_id", F.col("sensor_id").alias("src_ip"), "start_us", F.col("start_us").alias("end_us"))
    siem = correlate.interval_join(of_sensor, view(spark, d, "beats").select(F.col("sensor_id").alias("ip"), F.col("event_id").alias("siem_id"), F.col("observed_us").alias("ts_us")), HOUR, 20, order=("ts_us", "siem_id"))
    # every alert has a snapshot, which holds a connection and, for some, an IDS alert of its own
    uid, number = F.col("uid").alias("conn_uid"), F.col("event_id").alias("ids_id")
    snapshots = a.select("alert_id", F.col("event_id").alias("snapshot_id"), F.array(F.struct(uid, F.col("start_us").alias("ts_us"))).alias("conn"), F.when(F.col("event_id") % 3 == 0, F.array(F.struct(number, F.lit("Policy").alias("signature")))).otherwise(F.array()).alias("ids"))
    known = view(spark, d, "benchmark").select(F.col("item_id").alias("base_id"), F.concat("text", F.lit(" port "), F.element_at(F.array(*(F.lit(p) for p in ("443", "80", "22", "4444"))), (F.col("item_id") % 4 + 1).cast("int"))).alias("text"))
    asked = a.select(F.col("event_id").alias("query_id"), F.concat_ws(" ", F.lit("malware port"), F.col("dst_port").cast("string")).alias("text"))
    knowledge = retrieval.answers(asked, known, 4).join(a.select("alert_id", F.col("event_id").alias("query_id")), "query_id").select("alert_id", "rank", "base_id")
    return correlate.evidence_bundle(a, {
        "conn": (conn, ["conn_uid", "ts_us"], ["ts_us", "conn_uid"], 50),
        "ids": (ids.select("alert_id", "ts_us", "ids_id", "signature"), ["ids_id", "signature"], ["ts_us", "ids_id"], 50),
        "siem": (siem, ["siem_id", "ts_us"], ["ts_us", "siem_id"], 20),
        "snapshots": (snapshots, ["snapshot_id", "conn", "ids"], ["snapshot_id"], 20),
        "knowledge": (knowledge, ["base_id"], ["rank"], 4),
    }, {"conn": "conn", "ids": "ids"})


BUNDLE_SQL = duck("alerts", "conn", "ids", "beats") + """known AS (SELECT item_id AS id, text || ' port ' || CASE item_id % 4 WHEN 0 THEN '443' WHEN 1 THEN '80' WHEN 2 THEN '22' ELSE '4444' END AS text FROM benchmark),
asked AS (SELECT event_id AS qid, 'malware port ' || dst_port AS text FROM alerts),
""" + _tfidf_sql("asked", "known", 4) + f""",
ka AS (SELECT query_id, count(*) AS n, min(base_id) AS least FROM answers GROUP BY 1),
c1 AS (SELECT DISTINCT a.alert_id, c.uid, c.ts_us FROM alerts a JOIN conn c ON (c.orig_h = a.src_ip OR c.resp_h = a.src_ip) AND c.ts_us BETWEEN a.start_us - {6 * HOUR} AND a.end_us + {6 * HOUR}),
i1 AS (SELECT DISTINCT a.alert_id, i.event_id FROM alerts a JOIN ids i ON (i.src_ip = a.src_ip OR i.dest_ip = a.src_ip) AND i.ts_us BETWEEN a.start_us - {12 * HOUR} AND a.end_us + {12 * HOUR}),
nc AS (SELECT alert_id, least(50, count(*)) AS n FROM c1 GROUP BY 1), ni AS (SELECT alert_id, least(50, count(*)) AS n FROM i1 GROUP BY 1),
nh AS (SELECT a.alert_id, least(20, count(*)) AS n FROM alerts a JOIN beats h ON h.sensor_id = a.sensor_id AND h.observed_us BETWEEN a.start_us - {HOUR} AND a.start_us + {HOUR} GROUP BY 1),
bu AS (SELECT a.*, coalesce(nc.n, 0) + 1 AS n_conn, coalesce(ni.n, 0) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n_ids, coalesce(nh.n, 0) AS n_siem, 1 AS n_snapshots, coalesce(ka.n, 0) AS n_knowledge, ka.least AS least_knowledge
  FROM alerts a LEFT JOIN nc USING (alert_id) LEFT JOIN ni USING (alert_id) LEFT JOIN nh USING (alert_id) LEFT JOIN ka ON ka.query_id = a.event_id),
m AS (SELECT *, array_to_string([s.n FOR s IN [{{'n': 'siem', 'c': n_siem}}, {{'n': 'conn', 'c': n_conn}}, {{'n': 'ids', 'c': n_ids}}, {{'n': 'snapshots', 'c': n_snapshots}}, {{'n': 'knowledge', 'c': n_knowledge}}] IF s.c = 0], ',') AS missing FROM bu)
"""


@query(BUNDLE_SQL + "SELECT alert_id, n_siem, n_conn, n_ids, n_snapshots, n_knowledge, least_knowledge, missing, '' AS errors FROM m")
def evidence_bundle(spark, d):
    out = case_ops.bundle_summary(_bundle(spark, d), keep=[F.array_min(F.col("knowledge.base_id")).alias("least_knowledge")])
    return out.select("alert_id", *(F.col(f"n_{s}").cast("long").alias(f"n_{s}") for s in correlate.SOURCES), "least_knowledge", F.array_join("missing", ",").alias("missing"), F.array_join("errors", ",").alias("errors"))


@query(BUNDLE_SQL + "SELECT alert_id, 5 - len([x FOR x IN string_split(missing, ',') IF x <> '']) AS ready FROM m")
def source_coverage(spark, d):
    return correlate.coverage(_bundle(spark, d)).select("alert_id", F.col("ready").cast("long").alias("ready"))


@query(duck("alerts") + "z AS (SELECT alert_id, uid AS record FROM alerts UNION SELECT alert_id, sensor_id FROM alerts UNION SELECT alert_id, uid FROM alerts WHERE event_id % 2 = 0) SELECT alert_id, record FROM z")
def merge_unique(spark, d):
    a = view(spark, d, "alerts")
    left = a.select("alert_id", F.col("uid").alias("record"))
    return correlate.merge_unique(left, a.select("alert_id", F.col("sensor_id").alias("record")).unionByName(left.where("alert_id like '%2'")))


KEYED = "ka AS (SELECT alert_id, start_us, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'k' || (event_id % 3000) END AS alert_key FROM alerts)"


def _keyed_alerts(spark, d):
    key = F.when(F.col("event_id") % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit("k"), (F.col("event_id") % 3000).cast("string")))
    return view(spark, d, "alerts").select("alert_id", "start_us", correlate.alert_key(F.lit(""), key, F.lit(None)).alias("alert_key"))


@query(duck("alerts", "cases") + KEYED + " SELECT alert_key, min(start_us) AS start_us FROM ka WHERE alert_key IS NOT NULL AND alert_key NOT IN (SELECT alert_key FROM cases) GROUP BY 1")
def case_sync(spark, d):
    return correlate.new_cases(_keyed_alerts(spark, d), view(spark, d, "cases"), ["start_us", "alert_id"])[0].select("alert_key", "start_us")


@query(duck("alerts", "cases") + KEYED + ", q AS (SELECT DISTINCT alert_key FROM ka WHERE alert_key IS NOT NULL) SELECT (SELECT count(*) FROM q WHERE alert_key NOT IN (SELECT alert_key FROM cases)) AS created, (SELECT count(*) FROM q WHERE alert_key IN (SELECT alert_key FROM cases)) AS existing, (SELECT count(*) FROM ka WHERE alert_key IS NULL) AS unidentified")
def case_sync_counts(spark, d):
    return correlate.new_cases(_keyed_alerts(spark, d), view(spark, d, "cases"), ["start_us", "alert_id"])[1]


@query(duck("alerts", "cases") + KEYED + ", n AS (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY created_us DESC, case_id DESC) AS no FROM cases) SELECT ka.alert_id, n.case_id, n.status FROM ka LEFT JOIN n ON ka.alert_key = n.alert_key AND no = 1")
def latest_case(spark, d):
    return correlate.latest_case(_keyed_alerts(spark, d), view(spark, d, "cases")).select("alert_id", "case.case_id", "case.status")


@query("SELECT concat('f', event_id) AS path FROM events WHERE event_id % 5 <> 0")
def pending_captures(spark, d):
    files = view(spark, d, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), "event_id")
    return correlate.pending_captures(files, files.where("event_id % 5 = 0")).select("path")


@query(BUNDLE_SQL + """SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM (SELECT src_ip AS src, 'alert' AS dst, true AS active FROM m UNION ALL SELECT src_ip, 'conn', n_conn > 0 FROM m UNION ALL SELECT src_ip, 'ids', n_ids > 0 FROM m
  UNION ALL SELECT src_ip, dst_ip, true FROM m UNION ALL SELECT 'alert', 'siem', n_siem > 0 FROM m UNION ALL SELECT 'alert', 'knowledge', n_knowledge > 0 FROM m) WHERE active GROUP BY 1, 2""")
def evidence_graph(spark, d):
    return correlate.host_graph(correlate.evidence_edges(_bundle(spark, d)))


DECIDED = """v AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY decided_us DESC, seq DESC) AS no FROM decisions WHERE status <> 'bogus'),
dc AS (SELECT c.case_id, c.alert_key, coalesce(v.status, c.status) AS status, v.disposition, v.owner, v.reason, c.created_us, coalesce(v.decided_us, c.created_us) AS updated_us, CASE WHEN v.status = 'closed' THEN v.decided_us END AS closed_us
  FROM cases c LEFT JOIN v ON c.case_id = v.case_id AND v.no = 1)"""


def _decided(spark, d):
    return case_ops.apply_decisions(view(spark, d, "cases"), view(spark, d, "decisions"))


@query(duck("cases", "decisions") + DECIDED + " SELECT case_id, status, disposition, owner, reason, updated_us, closed_us FROM dc")
def apply_decisions(spark, d):
    return _decided(spark, d)[0].select("case_id", "status", "disposition", "owner", "reason", "updated_us", "closed_us")


@query(duck("decisions") + "z AS (SELECT 1) SELECT case_id, seq FROM decisions WHERE status = 'bogus'")
def rejected_decisions(spark, d):
    return _decided(spark, d)[1].select("case_id", "seq")


@query(duck("cases", "decisions") + DECIDED + """ SELECT case_id, 'created' AS step, created_us AS at_us FROM dc UNION ALL SELECT case_id, 'owned', updated_us FROM dc WHERE coalesce(owner, '') <> ''
UNION ALL SELECT case_id, 'decided', updated_us FROM dc WHERE coalesce(disposition, '') <> '' OR coalesce(reason, '') <> '' UNION ALL SELECT case_id, 'closed', closed_us FROM dc WHERE closed_us IS NOT NULL""")
def case_timeline(spark, d):
    return case_ops.timeline(_decided(spark, d)[0])


@query("""WITH e AS (SELECT user_id AS task_id, epoch_us(ts) AS at_us, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, CASE WHEN event_type = 'purchase' THEN 'r' END AS report FROM events)
SELECT task_id, arg_max(status, at_us) AS status, min(CASE WHEN status = 'running' THEN at_us END) - min(CASE WHEN status = 'queued' THEN at_us END) AS queued_us,
  min(CASE WHEN status IN ('succeeded', 'failed') THEN at_us END) - min(CASE WHEN status = 'running' THEN at_us END) AS running_us, bool_or(report IS NOT NULL) AS has_report FROM e GROUP BY 1""")
def task_lifecycle(spark, d):
    e = view(spark, d, "e")
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("queued")
    return case_ops.task_lifecycle(e.select(F.col("user_id").alias("task_id"), F.col("e_us").alias("at_us"), status.alias("status"), F.when(F.col("event_type") == "purchase", "r").alias("report")))


@query(duck("alerts") + """z AS (SELECT sensor_id, alert_id, row_number() OVER (PARTITION BY sensor_id ORDER BY prob DESC, alert_id) AS rank, round(prob, 4) AS probability, src_ip || ':' || src_port AS src, dst_ip || ':' || dst_port AS dst FROM alerts) SELECT * FROM z""")
def compact_events(spark, d):
    return case_ops.compact_events(view(spark, d, "alerts"), ("sensor_id",))


def report_of_sensors(spark, d):
    a = view(spark, d, "alerts").withColumn("risk", risk_level(F.col("prob")))
    c = case_ops.compact_events(a, ("sensor_id",)).join(a.select("alert_id", "risk"), "alert_id")
    return case_ops.rule_report(c.withColumnRenamed("sensor_id", "run_id"))


REPORT_SQL = duck("alerts") + r"""z AS (SELECT sensor_id, row_number() OVER (PARTITION BY sensor_id ORDER BY prob DESC, alert_id) AS rank, round(prob, 4) AS p, src_ip || ':' || src_port AS src, dst_ip || ':' || dst_port AS dst, alert_id, CASE WHEN prob >= 0.9 THEN 'high' WHEN prob >= 0.7 THEN 'medium' WHEN prob >= 0.5 THEN 'low' ELSE 'informational' END AS risk FROM alerts),
b AS (SELECT sensor_id AS run_id, count(*) AS n, count(*) FILTER (risk = 'high') AS n_high, max(p) AS top, string_agg(printf(E'### Event %d: %s -> %s\n\n- Risk: %s\n- Probability: %.4f\n- Alert: %s', rank, src, dst, risk, p, alert_id), E'\n\n' ORDER BY rank) FILTER (rank <= 50) AS blocks FROM z GROUP BY 1)
SELECT run_id, printf(E'# Traffic triage report\n\n%d candidates, %d of high risk, highest probability %.4f.\n\n## Candidates\n\n', n, n_high, top) || blocks || E'\n\n## Knowledge\n\n' ||
E'\n\n## Actions\n\n- Review neighbouring connections of both hosts in the time window.\n- Check who owns the destination.\n\n## Limits\n\nA probability is a lead, no verdict; 误报 need manual review.\n' AS markdown FROM b"""


@query(REPORT_SQL)
def rule_report(spark, d):
    return report_of_sensors(spark, d)


@query("""WITH r AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY 1), l AS (SELECT conv_id, lower(t) AS t, n % 2 AS a, n % 3 AS c FROM r),
k AS (SELECT conv_id, a > 0 AND (contains(t, 'alert') OR contains(t, 'model') OR contains(t, 'ai 告警') OR contains(t, '模型')) AS p1, c > 0 AND (contains(t, 'wazuh') OR contains(t, '告警')) AS p2,
  c > 0 AND (contains(t, 'zeek') OR contains(t, 'suricata') OR contains(t, '连接') OR contains(t, '上下文')) AS p3, a > 0 AND (contains(t, 'rag') OR contains(t, '知识') OR contains(t, 'playbook') OR contains(t, '依据')) AS p4,
  (contains(t, '误报') OR contains(t, '局限') OR contains(t, '风险线索') OR contains(t, '不能直接') OR contains(t, '人工复核')) AS p5 FROM l)
SELECT conv_id, p4 AS rag, (p1 AND p2 AND p3 AND p4 AND p5) AS complete, CAST(NOT p1 AS INT) + CAST(NOT p2 AS INT) + CAST(NOT p3 AS INT) + CAST(NOT p4 AS INT) + CAST(NOT p5 AS INT) AS n_missing FROM k""")
def report_quality(spark, d):
    turns = view(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("ts"), F.count(F.lit(1)).alias("n"))
    r = turns.select("conv_id", F.array_join(F.transform("ts", lambda t: t["text"]), " ").alias("markdown"), (F.col("n") % 2).alias("n_alerts"), (F.col("n") % 3).alias("n_siem"), (F.col("n") % 3).alias("n_conn"), F.lit(0).alias("n_ids"), (F.col("n") % 2).alias("n_knowledge"))
    return case_ops.quality_checks(r).select("conv_id", F.col("passed_rag_basis").alias("rag"), (F.col("status") == "complete").alias("complete"), F.size("missing").alias("n_missing"))


@query("SELECT status, CAST(count(o) AS BIGINT) AS n FROM (SELECT unnest(['new', 'in_review', 'escalated', 'closed']) AS status) s LEFT JOIN (SELECT CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'in_review' ELSE 'escalated' END AS o FROM orders) t ON s.status = t.o GROUP BY 1")
def case_counts(spark, d):
    return metrics.case_counts(view(spark, d, "cases"))


@query("SELECT count(DISTINCT conv_id) AS tasks, count(DISTINCT CASE WHEN role = 'system' THEN conv_id END) AS with_report FROM conversations")
def task_stats(spark, d):
    t = view(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", "r")).alias("report"))
    return metrics.task_stats(t)


@query(duck("alerts") + "z AS (SELECT 1) SELECT alert_id, start_us, (SELECT count(*) FROM alerts) AS matched FROM alerts ORDER BY start_us DESC, alert_id LIMIT 8")
def overview(spark, d):
    return metrics.overview(view(spark, d, "alerts")).select("alert_id", "start_us", "matched")


@query(duck("beats") + "z AS (SELECT 1) SELECT sensor_id, CAST(sum(received) AS BIGINT) AS received, CAST(sum(dropped) AS BIGINT) AS dropped, round(sum(dropped) / CAST(sum(received) AS DOUBLE), 9) AS rate FROM beats GROUP BY 1")
def capture_loss(spark, d):
    return metrics.capture_loss(view(spark, d, "beats")).withColumn("rate", F.round("rate", 9))


@query(duck("cases", "decisions") + DECIDED + """ SELECT count(*) AS n_cases, count(*) FILTER (status = 'closed') AS n_closed, round(count(*) FILTER (status = 'escalated') / CAST(count(*) AS DOUBLE), 9) AS escalation_rate,
  round(count(*) FILTER (status = 'closed' AND disposition = 'false_positive') / CAST(count(*) FILTER (status = 'closed') AS DOUBLE), 9) AS false_positive_rate, round(avg((closed_us - created_us) / 1000000.0), 3) AS mean_s, round(quantile_cont((closed_us - created_us) / 1000000.0, 0.5), 3) AS median_s FROM dc""")
def triage_quality(spark, d):
    q = metrics.triage_quality(_decided(spark, d)[0])
    return q.select("n_cases", "n_closed", F.round("escalation_rate", 9).alias("escalation_rate"), F.round("false_positive_rate", 9).alias("false_positive_rate"), F.round("mean_s", 3).alias("mean_s"), F.round("median_s", 3).alias("median_s"))


@query(duck("alerts") + "z AS (SELECT CAST(least(floor(prob * 10), 9) AS BIGINT) AS bucket, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS fp FROM alerts) SELECT bucket, count(*) AS n, CAST(sum(fp) AS BIGINT) AS n_false FROM z GROUP BY 1")
def verdicts_by_score(spark, d):
    a = view(spark, d, "alerts").withColumn("disposition", F.when(F.col("event_id") % 3 == 0, "false_positive").otherwise(""))
    return metrics.verdicts_by_score(a)


@query(duck("alerts") + "z AS (SELECT end_us - start_us AS delay FROM alerts) SELECT count(*) AS samples, quantile_cont(delay, 0.95) AS p95_us, (count(*) >= 100 AND quantile_cont(delay, 0.95) <= 60000000) AS accepted FROM z")
def latency_p95(spark, d):
    return metrics.latency_p95(view(spark, d, "alerts").select((F.col("end_us") - F.col("start_us")).alias("delay_us")))


@query()
def hash_embeddings(spark, d):
    kb = view(spark, d, "benchmark")
    raw = kb.select("item_id", retrieval.hash_embed(F.col("text")).alias("raw"))
    return raw.select("item_id", F.transform(retrieval.l2_normalize(F.col("raw")), lambda x: F.round(x, 6)).alias("vector"))


@query(r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_:.@/-]+|[一-鿿]')) AS w FROM benchmark),
h AS (SELECT item_id, md5(w) AS m FROM t),
p AS (SELECT item_id, CAST('0x' || m[7:8] || m[5:6] || m[3:4] || m[1:2] AS BIGINT) % 384 AS place, CASE WHEN CAST('0x' || m[9:10] AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM h),
s AS (SELECT item_id, place, CAST(sum(sign) AS BIGINT) AS v FROM p GROUP BY 1, 2)
SELECT b.item_id, coalesce(string_agg(place || ':' || v, ',' ORDER BY place), '') AS places FROM benchmark b LEFT JOIN s ON s.item_id = b.item_id AND v <> 0 GROUP BY 1""")
def hash_embeddings_md5(spark, d):
    """The hashed embedding with a digest that DuckDB has too; the places that are not zero."""
    kb = view(spark, d, "benchmark").select("item_id", retrieval.hash_embed(F.col("text"), partial(retrieval.embed_batch, digest=retrieval.md5)).alias("v"))
    kb = kb.select("item_id", F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.cast("long").alias("x"))), lambda p: p["x"] != 0).alias("p"))
    return kb.select("item_id", F.array_join(F.transform("p", lambda p: F.concat_ws(":", p["i"].cast("string"), p["x"].cast("string"))), ",").alias("places"))


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS norm FROM embeddings)
SELECT vec_id, array_to_string([CAST(round(CAST(CAST(CAST(x AS DOUBLE) / greatest(norm, 1e-12) AS FLOAT) AS DOUBLE) * 1000) AS BIGINT) FOR x IN embedding], ',') AS thousandths FROM n""")
def l2_normalize(spark, d):
    v = view(spark, d, "embeddings").withColumn("n", retrieval.l2_normalize(F.col("embedding")))
    return v.select("vec_id", F.array_join(F.transform("n", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",").alias("thousandths"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, base_id, score FROM r WHERE rank <= 4""")
def top_similar(spark, d):
    v = view(spark, d, "embeddings")
    return retrieval.top_similar(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("base_id"), F.col("embedding").alias("vector")), exclude_own=True)


@query("""WITH s AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, base_id, score FROM r WHERE rank <= 4""")
def index_search(spark, d):
    """top_similar over an index that is written first."""
    v, path = view(spark, d, "embeddings"), scratch(spark, "vector-index")
    vector_index.write(v.select(F.col("vec_id").alias("base_id"), F.col("embedding").alias("vector")), path)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index.search(spark, asked, path, exclude_own=True).drop("n_clusters")


@query(duck("beats") + "z AS (SELECT sensor_id, count(received) AS n FROM beats GROUP BY 1) SELECT sensor_id, n, true AS within FROM z")
def latency_sketches(spark, d):
    """Sketches by sensor and hour in two batches, merged; whether the rank of each quantile is within the stated error."""
    b, path = view(spark, d, "beats"), scratch(spark, "sketches")
    for part in (0, 1):
        sketches.quantile_sketches(b.where(F.col("event_id") % 2 == part), "received", "observed_us").write.mode("append").parquet(path)
    shares = (0.5, 0.95)
    est = sketches.sketched_quantiles(spark.read.parquet(path), shares)
    near = [F.least(F.abs(F.col(f"below{k}") / F.col("n") - s), F.abs(F.col(f"upto{k}") / F.col("n") - s)) <= sketches.RANK_ERROR for k, s in enumerate(shares)]
    between = [(F.col(f"below{k}") / F.col("n") <= s) & (F.col(f"upto{k}") / F.col("n") >= s) for k, s in enumerate(shares)]
    counts = [c for k in range(2) for c in (F.count_if(F.col("received") < F.col(f"q{k}")).alias(f"below{k}"), F.count_if(F.col("received") <= F.col(f"q{k}")).alias(f"upto{k}"))]
    met = b.join(F.broadcast(est), "sensor_id").groupBy("sensor_id", "n").agg(*counts)  # est: a row for each sensor
    return met.select("sensor_id", "n", ((near[0] | between[0]) & (near[1] | between[1])).alias("within"))


@query(duck("alerts") + """z AS (SELECT DISTINCT start_us // 86400000000 AS day, src_ip FROM alerts)
SELECT a.day, count(*) AS n, count(b.src_ip) AS n_again, true AS within FROM z a LEFT JOIN z b ON b.src_ip = a.src_ip AND b.day = a.day - 1 GROUP BY 1""")
def sources_met_again(spark, d):
    """Distinct sources of alerts by day and those of the day before met again, exact, and whether the stored sketches give both within the stated error."""
    a, path = view(spark, d, "alerts").withColumn("day", F.expr("start_us div 86400000000")), scratch(spark, "distinct")
    for part in (0, 1):
        sketches.distinct_sketches(a.where(F.col("event_id") % 2 == part), "src_ip", ["day"]).write.mode("append").parquet(path)
    est = sketches.met_again(spark.read.parquet(path), "day").select("day", F.col("n").alias("about"), F.col("n_again").alias("about_again"))
    z = a.select("day", "src_ip").distinct()
    exact = z.join(z.select((F.col("day") + 1).alias("day"), "src_ip", F.lit(1).alias("again")), ["day", "src_ip"], "left").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count("again").alias("n_again"))
    both = exact.join(est, "day")
    before = F.coalesce(F.lag("n").over(Window.orderBy("day")), F.lit(0))  # a row for each day
    within = (F.abs(F.col("about") - F.col("n")) <= sketches.DISTINCT_ERROR * F.col("n")) & (F.abs(F.col("about_again") - F.col("n_again")) <= sketches.DISTINCT_ERROR * (F.col("n") + before))
    return both.select("day", "n", "n_again", within.alias("within"))


@query("WITH asked AS (SELECT doc_id AS qid, text FROM documents WHERE doc_id % 100 = 0), known AS (SELECT item_id AS id, text FROM benchmark),\n" + _tfidf_sql("asked", "known", 4) + " SELECT * FROM answers")
def tfidf_top(spark, d):
    q = view(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    out = retrieval.tfidf_top(q, view(spark, d, "benchmark").select(F.col("item_id").alias("base_id"), "text"), 4)
    return out.withColumn("score", F.round(F.col("score") * 1_000_000).cast("long"))  # in millionths


@query("WITH asked AS (SELECT doc_id AS qid, text FROM documents WHERE doc_id % 100 = 0), known AS (SELECT doc_id AS id, text FROM documents),\n" + _tfidf_sql("asked", "known", 4) + " SELECT * FROM answers")
def tfidf_search(spark, d):
    """Documents like each hundredth one, itself among them."""
    docs = view(spark, d, "documents")
    out = retrieval.tfidf_search(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"), docs.select(F.col("doc_id").alias("base_id"), "text"), 4)
    return out.withColumn("score", F.round(F.col("score") * 1_000_000).cast("long")).drop("n_scored")


@query(duck("alerts") + f"""z AS (SELECT *, CASE WHEN prob >= 0.9 THEN 'high' WHEN prob >= 0.7 THEN 'medium' WHEN prob >= 0.5 THEN 'low' ELSE 'informational' END AS risk FROM alerts)
SELECT alert_id, 'malware ' || risk || ' port ' || dst_port || ' ' || src_ip || ' ' || dst_ip || ' counts unusual' AS query, '{{"alert_id":"' || alert_id || '","uid":"' || uid || '"}}' AS compact FROM z""")
def query_texts(spark, d):
    a = view(spark, d, "alerts")
    q = retrieval.query_text(F.lit("malware"), risk_level(F.col("prob")), F.col("dst_port"), F.col("src_ip"), F.col("dst_ip"), F.array(F.lit("counts"), F.lit("unusual")))
    return a.select("alert_id", q.alias("query"), retrieval.bundle_query(("alert_id", "uid")).alias("compact"))


@query("SELECT item_id, trim('T' || item_id || ' a b ' || text || ' do it') AS text FROM benchmark")
def knowledge_text(spark, d):
    kb = view(spark, d, "benchmark").select("item_id", F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("title"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.col("text").alias("content"), F.lit("do it").alias("recommendation"))
    return kb.select("item_id", retrieval.knowledge_text(kb).alias("text"))
