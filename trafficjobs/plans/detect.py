"""Queries of the detection workload: packets, flows, features, scores, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficjobs.functions import features, scoring
from trafficjobs.operators import events, flows, id_store, search
from trafficjobs.plans.catalog import query
from trafficjobs.plans.views import duck, packets, portable_hash, view
from trafficjobs.session import scratch

ORDER = ("event_id", "i")
SENSORS = [f"s{i}" for i in range(4)]

KEYED_SQL = """k AS (SELECT *, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip ELSE dst_ip END AS lo_ip, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_port ELSE dst_port END AS lo_port,
  CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_ip ELSE src_ip END AS hi_ip, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_port ELSE src_port END AS hi_port, lower(protocol) AS proto FROM packets),
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w >= 30000000 THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto ORDER BY ts_us, event_id, i)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto ORDER BY ts_us, event_id, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto, segment ORDER BY ts_us, event_id, i) AS position FROM s)"""
FLOWS_SQL = KEYED_SQL + """,
f0 AS (SELECT lo_ip, lo_port, hi_ip, hi_port, segment, list(struct_pack(ts := ts_us, sip := src_ip, sp := src_port, dip := dst_ip, dp := dst_port, len := ip_length, fl := tcp_flags) ORDER BY position) AS ps
  FROM n WHERE position <= 20 GROUP BY ALL HAVING count(*) >= 3),
f1 AS (SELECT *, (ps[1].fl & 18) = 18 AS flip FROM f0),
f2 AS (SELECT segment, ps, CASE WHEN flip THEN ps[1].dip ELSE ps[1].sip END AS src_ip, CASE WHEN flip THEN ps[1].dp ELSE ps[1].sp END AS src_port,
  CASE WHEN flip THEN ps[1].sip ELSE ps[1].dip END AS dst_ip, CASE WHEN flip THEN ps[1].sp ELSE ps[1].dp END AS dst_port FROM f1),
flow AS (SELECT src_ip, src_port, dst_ip, dst_port, segment, ps[1].ts AS started_us, ps[len(ps)].ts AS ended_us,
  [CASE WHEN p.sip = src_ip AND p.sp = src_port THEN p.len ELSE -p.len END FOR p IN ps] AS sizes, [p.ts - ps[1].ts FOR p IN ps] AS offsets_us FROM f2)"""


def _packets(spark, d):
    return flows.tcp_only(packets(spark, d))


def _segments(spark, d):
    return flows.segment_sequences(flows.with_key(_packets(spark, d)), order=ORDER)


def closed_form_score(df):
    """A stand-in score in whole numbers, alike in every engine."""
    return F.least(F.lit(1.0), (F.col("absolute_bytes") % 1000) / 1000.0)


@query(duck("packets") + KEYED_SQL + " SELECT lo_ip, lo_port, hi_ip, hi_port, proto, count(*) AS packets, count(*) FILTER ((tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0) AS syns, count(*) FILTER ((tcp_flags & 5) <> 0) AS closings FROM k GROUP BY ALL")
def flow_keys(spark, d):
    k = flows.with_key(_packets(spark, d))
    return k.groupBy(*flows.KEY).agg(F.count(F.lit(1)).alias("packets"), F.count_if(flows.is_original_syn(F.col("tcp_flags"))).alias("syns"), F.count_if(flows.is_closing(F.col("tcp_flags"))).alias("closings"))


@query(duck("packets") + KEYED_SQL + " SELECT lo_ip, lo_port, hi_ip, hi_port, segment, count(*) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us FROM s GROUP BY ALL")
def idle_sessions(spark, d):
    return flows.idle_spans(flows.with_key(_packets(spark, d))).select("lo_ip", "lo_port", "hi_ip", "hi_port", "segment", "packets", "first_us", "last_us")


@query(duck("packets") + KEYED_SQL + " SELECT event_id, i, segment, ts_us FROM s")
def packet_segments(spark, d):
    """Gap detection: every packet with the number of its segment."""
    return flows.idle_segments(flows.with_key(_packets(spark, d))).select("event_id", "i", "segment", "ts_us")


@query(duck("packets") + KEYED_SQL + " SELECT event_id, i, segment, position FROM n WHERE position <= 20")
def first_packets(spark, d):
    return flows.first_packets(flows.with_key(_packets(spark, d)).select(*flows.KEY, "ts_us", *ORDER), 20, ORDER).select("event_id", "i", "segment", "position")


@query(duck("packets") + FLOWS_SQL + " SELECT src_ip, src_port, dst_ip, dst_port, segment, started_us, ended_us, array_to_string(sizes, ',') AS sizes, array_to_string(offsets_us, ',') AS offsets FROM flow")
def flow_sequences(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return _segments(spark, d).select("src_ip", "src_port", "dst_ip", "dst_port", "segment", "started_us", "ended_us", text("sizes").alias("sizes"), text("offsets_us").alias("offsets"))


SUMMARY_SQL = """ SELECT src_ip, src_port, dst_ip, dst_port, segment, len(sizes) AS packet_count, CAST(list_sum([abs(x) FOR x IN sizes]) AS BIGINT) AS absolute_bytes, ended_us - started_us AS duration_us, CAST(list_max([abs(x) FOR x IN sizes]) AS BIGINT) AS max_abs_size FROM flow"""


@query(duck("packets") + FLOWS_SQL + SUMMARY_SQL)
def flow_summary(spark, d):
    return flows.summarize(_segments(spark, d)).select("src_ip", "src_port", "dst_ip", "dst_port", "segment", "packet_count", "absolute_bytes", "duration_us", "max_abs_size")


@query(duck("packets") + FLOWS_SQL + ", m AS (" + SUMMARY_SQL + """), r AS (SELECT least(1.0, CAST(absolute_bytes % 1000 AS DOUBLE) / 1000.0) AS p FROM m)
SELECT CASE WHEN p >= 0.9 THEN 'high' WHEN p >= 0.7 THEN 'medium' WHEN p >= 0.5 THEN 'low' ELSE 'informational' END AS risk, count(*) AS n FROM r GROUP BY 1""")
def flow_risk_slice(spark, d):
    scored = flows.summarize(_segments(spark, d))
    return scored.groupBy(scoring.risk_level(closed_form_score(scored)).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


#: Packet by packet in each key: the state after a packet, the flow that its coming ended by a deadline, and the one that it ended itself.
ASSEMBLED_SQL = duck("packets").replace("WITH ", "WITH RECURSIVE ", 1) + KEYED_SQL.split(",\ng AS")[0] + """,
p AS (SELECT lo_ip, lo_port, hi_ip, hi_port, ts_us AS ts, (src_ip, src_port) = (lo_ip, lo_port) AS by_lo, ip_length AS size, (tcp_flags & 2) <> 0 AS syn, (tcp_flags & 16) <> 0 AS ack, (tcp_flags & 5) <> 0 AS closing,
  row_number() OVER w AS no, count(*) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port) AS n FROM k WINDOW w AS (PARTITION BY lo_ip, lo_port, hi_ip, hi_port ORDER BY ts_us, event_id, i)),
walk AS (
  SELECT DISTINCT lo_ip, lo_port, hi_ip, hi_port, CAST(0 AS BIGINT) AS no, 0 AS mode, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS last, CAST([] AS INTEGER[]) AS sizes, CAST([] AS BIGINT[]) AS offs, false AS begun, false AS sure,
    CAST(NULL AS VARCHAR) AS due_why, CAST(NULL AS STRUCT(start BIGINT, last BIGINT, sizes INTEGER[], offs BIGINT[], begun BOOLEAN)) AS due_flow, CAST(NULL AS VARCHAR) AS why FROM p
  UNION ALL
  SELECT lo_ip, lo_port, hi_ip, hi_port, no, CASE WHEN skip OR why = 'max_packets' THEN CASE WHEN closing THEN 0 ELSE 2 END WHEN why = 'tcp_close' THEN 0 ELSE 1 END AS mode, start, ts AS last, sizes, offs, begun, sure, due_why, due_flow,
    CASE WHEN why IS NULL AND NOT skip AND no = n THEN 'replay_end' ELSE why END AS why
  FROM (
    SELECT *, CASE WHEN skip THEN NULL WHEN len(sizes) >= 20 THEN 'max_packets' WHEN closing THEN 'tcp_close' END AS why FROM (
      SELECT lo_ip, lo_port, hi_ip, hi_port, no, n, ts, closing, skip, CASE WHEN fresh THEN ts ELSE start END AS start, CASE WHEN skip THEN CAST([] AS INTEGER[]) WHEN fresh THEN [signed] ELSE list_append(sizes, signed) END AS sizes,
        CASE WHEN skip THEN CAST([] AS BIGINT[]) WHEN fresh THEN [CAST(0 AS BIGINT)] ELSE list_append(offs, ts - start) END AS offs,
        CASE WHEN fresh THEN by_lo <> (syn AND ack) WHEN NOT skip AND NOT sure AND syn AND NOT ack THEN by_lo ELSE begun END AS begun, CASE WHEN fresh THEN syn ELSE sure OR (syn AND NOT ack) END AS sure, due_why, due_flow
      FROM (
        SELECT *, NOT skip AND still <> 1 AS fresh FROM (
          SELECT *, still = 2 AND NOT (syn AND NOT ack) AS skip FROM (
            SELECT w.lo_ip, w.lo_port, w.hi_ip, w.hi_port, p.no, p.n, p.ts, p.by_lo, p.syn, p.ack, p.closing, CASE WHEN p.by_lo THEN p.size ELSE -p.size END AS signed, w.start, w.sizes, w.offs, w.begun, w.sure,
              CASE WHEN w.mode > 0 AND p.ts >= least(w.last + 30000000, w.start + 120000000) THEN 0 ELSE w.mode END AS still,
              CASE WHEN w.mode = 1 AND p.ts >= least(w.last + 30000000, w.start + 120000000) THEN CASE WHEN w.last + 30000000 <= w.start + 120000000 THEN 'idle_timeout' ELSE 'active_timeout' END END AS due_why,
              struct_pack(start := w.start, last := w.last, sizes := w.sizes, offs := w.offs, begun := w.begun) AS due_flow
            FROM walk w JOIN p ON p.lo_ip = w.lo_ip AND p.lo_port = w.lo_port AND p.hi_ip = w.hi_ip AND p.hi_port = w.hi_port AND p.no = w.no + 1) a) b) c) d) e),
ended AS (
  SELECT lo_ip, lo_port, hi_ip, hi_port, due_flow.start AS start, due_flow.last AS last, due_flow.sizes AS s, due_flow.offs AS offs, due_flow.begun AS begun, due_why AS why FROM walk WHERE due_why IS NOT NULL
  UNION ALL SELECT lo_ip, lo_port, hi_ip, hi_port, start, last, sizes, offs, begun, why FROM walk WHERE why IS NOT NULL),
flow AS (
  SELECT CASE WHEN begun THEN lo_ip ELSE hi_ip END AS src_ip, CASE WHEN begun THEN lo_port ELSE hi_port END AS src_port, CASE WHEN begun THEN hi_ip ELSE lo_ip END AS dst_ip, CASE WHEN begun THEN hi_port ELSE lo_port END AS dst_port,
    start AS started_us, last AS ended_us, [CASE WHEN begun THEN x ELSE -x END FOR x IN s] AS sizes, offs AS offsets_us, why AS close_reason FROM ended WHERE len(s) >= 3)"""


@query(ASSEMBLED_SQL + """ SELECT src_ip, src_port, dst_ip, dst_port, started_us, ended_us, close_reason, array_to_string(sizes, ',') AS sizes, array_to_string(offsets_us, ',') AS offsets,
  len(sizes) AS packet_count, CAST(list_sum([abs(x) FOR x IN sizes]) AS BIGINT) AS absolute_bytes, ended_us - started_us AS duration_us, CAST(list_max([abs(x) FOR x IN sizes]) AS BIGINT) AS max_abs_size FROM flow""")
def assemble_flows(spark, d):
    out = flows.summarize(flows.assemble_flows(view(spark, d, "packets"), order=ORDER))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select(
        "src_ip", "src_port", "dst_ip", "dst_port", "started_us", "ended_us", "close_reason", text("sizes").alias("sizes"), text("offsets_us").alias("offsets"),
        "packet_count", "absolute_bytes", "duration_us", "max_abs_size",
    )


SCORED_SQL = """, x AS (SELECT *, 1 / (1 + exp(-(-1.0 + 0.002 * list_avg([abs(x) FOR x IN sizes]) - 0.05 * len(sizes) + 0.3 * len([x FOR x IN sizes IF x < 0]) / len(sizes) + 0.8 * ln(1 + offsets_us[len(offsets_us)] / 1000000.0)))) AS p FROM flow)
SELECT src_ip, src_port, dst_ip, dst_port, started_us, round(p, 6) AS probability, CASE WHEN p >= 0.9 THEN 'high' WHEN p >= 0.7 THEN 'medium' WHEN p >= 0.5 THEN 'low' ELSE 'informational' END AS risk FROM x"""


@query(ASSEMBLED_SQL + SCORED_SQL)
def score_assembled_flows(spark, d):
    scored = scoring.score_flows(features.encode(flows.assemble_flows(view(spark, d, "packets"), order=ORDER)).drop("encoded"))
    return scored.select("src_ip", "src_port", "dst_ip", "dst_port", "started_us", F.round("probability", 6).alias("probability"), scoring.risk_level(F.col("probability")).alias("risk"))


TOKENS_SQL = """ SELECT src_ip, src_port, dst_port, segment, array_to_string([least(abs(x), 1000) + 1 FOR x IN sizes[1:16]], ',') AS tok_sizes, array_to_string([CASE WHEN x > 0 THEN 1 WHEN x < 0 THEN 2 ELSE 0 END FOR x IN sizes[1:16]], ',') AS tok_dirs,
  array_to_string([CAST(round(least(greatest(o / 1000000.0, 0.0), 10.0) * 1000000) AS BIGINT) FOR o IN offsets_us[1:16]], ',') AS tok_times FROM flow"""


@query(duck("packets") + FLOWS_SQL + TOKENS_SQL)
def encode_tokens(spark, d):
    t = _segments(spark, d).withColumn("t", features.tokens(F.col("sizes"), features.seconds(F.col("offsets_us")), 16, 1000, 10.0))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return t.select("src_ip", "src_port", "dst_port", "segment", text(F.col("t.sizes")).alias("tok_sizes"), text(F.col("t.dirs")).alias("tok_dirs"), text(F.transform("t.times", lambda x: F.round(x * 1_000_000).cast("long"))).alias("tok_times"))


@query(duck("packets") + FLOWS_SQL + """ SELECT src_ip, src_port, dst_port, segment, least(len(sizes), 8) AS n_real, 8 AS n_all, CAST(list_sum([least(abs(x), 2000) + 1 FOR x IN sizes[1:8]]) AS BIGINT) AS token_sum FROM flow WHERE len(sizes) >= 3""")
def pad_mask(spark, d):
    p = _segments(spark, d).where(features.long_enough(F.col("sizes"), F.col("offsets_us"))).withColumn("p", features.padded(features.tokens(F.col("sizes"), features.seconds(F.col("offsets_us")), 8), 8))
    total = F.aggregate(F.col("p.sizes"), F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("src_ip", "src_port", "dst_port", "segment", F.size(F.filter("p.mask", lambda x: x)).alias("n_real"), F.size("p.times").alias("n_all"), total.alias("token_sum"))


@query(duck("packets") + FLOWS_SQL + """ SELECT dst_port, count(*) FILTER (len(sizes) >= 5) AS by_whole, count(*) FILTER (least(len(sizes), 6) >= 5) AS by_cut, count(*) FILTER (least(len(sizes), 4) >= 5) AS by_short_cut FROM flow GROUP BY 1""")
def packet_minimum(spark, d):
    enough = lambda rule, most: F.count_if(features.long_enough(F.col("sizes"), F.col("offsets_us"), 5, rule, most))
    return _segments(spark, d).groupBy("dst_port").agg(enough("before_cut", 4).alias("by_whole"), enough("after_cut", 6).alias("by_cut"), enough("after_cut", 4).alias("by_short_cut"))


STATS_SQL = """, st AS (SELECT *, [o / 1000000.0 FOR o IN offsets_us] AS t FROM flow),
sm AS (SELECT *, list_min(t) AS t_min, list_max(t) AS t_max, list_avg(t) AS t_mean, list_median(t) AS t_median FROM st)"""


@query(duck("packets") + FLOWS_SQL + STATS_SQL + " SELECT src_ip, src_port, dst_port, segment, round(t_min, 6) AS t_min, round(t_max, 6) AS t_max, round(t_mean, 5) AS t_mean, round(t_median, 5) AS t_median FROM sm")
def time_stats(spark, d):
    s = _segments(spark, d).withColumn("s", features.time_stats(features.seconds(F.col("offsets_us"))))
    return s.select("src_ip", "src_port", "dst_port", "segment", F.round("s.min", 6).alias("t_min"), F.round("s.max", 6).alias("t_max"), F.round("s.mean", 5).alias("t_mean"), F.round("s.median", 5).alias("t_median"))


@query(duck("packets") + FLOWS_SQL + """ SELECT src_ip, src_port, dst_port, segment, len([x FOR x IN sizes IF x > 0]) AS n_out, len([x FOR x IN sizes IF x < 0]) AS n_back, array_to_string(sizes[1:16], ',') AS preview FROM flow""")
def direction_counts(spark, d):
    s = _segments(spark, d).withColumn("c", features.direction_counts(F.col("sizes")))
    return s.select("src_ip", "src_port", "dst_port", "segment", F.col("c.out").cast("long").alias("n_out"), F.col("c.back").cast("long").alias("n_back"), F.array_join(features.preview(F.col("sizes")).cast("array<string>"), ",").alias("preview"))


@query(duck("packets") + FLOWS_SQL + STATS_SQL + """ SELECT src_ip, src_port, dst_port, segment, 'counts' || CASE WHEN list_max([abs(x) FOR x IN sizes]) >= 1400 THEN ',near_mtu' ELSE '' END || CASE WHEN len(sizes) <= 4 THEN ',few_packets' ELSE '' END
  || CASE WHEN t_median < 0.01 AND len(sizes) > 4 THEN ',dense_times' ELSE '' END || CASE WHEN t_max >= 1.0 THEN ',long_pause' ELSE '' END || CASE WHEN dst_port NOT IN (22, 25, 53, 80, 110, 143, 389, 443, 445, 993, 995) THEN ',unusual_port' ELSE '' END AS rules FROM sm""")
def rule_evidence(spark, d):
    s = _segments(spark, d)
    return s.select("src_ip", "src_port", "dst_port", "segment", F.array_join(features.rule_evidence(F.col("sizes"), features.seconds(F.col("offsets_us")), F.col("dst_port")), ",").alias("rules"))


@query(duck("packets") + FLOWS_SQL + """, p AS (SELECT *, least(len(sizes), 12) AS n FROM flow) SELECT src_ip, src_port, dst_port, segment, array_to_string([CASE WHEN x > 0 THEN 1 ELSE -1 END FOR x IN sizes[1:12]], ',') AS dirs, CAST(list_sum([abs(x) FOR x IN sizes[1:12]]) AS BIGINT) AS total, n FROM p""")
def log_to_ppi(spark, d):
    p = _segments(spark, d).withColumn("p", features.to_ppi(F.col("sizes"), features.seconds(F.col("offsets_us")), 12))
    back = p.withColumn("r", features.parse_ppi(F.to_json("p")))
    return back.select("src_ip", "src_port", "dst_port", "segment", F.array_join(F.col("r.dirs").cast("array<int>").cast("array<string>"), ",").alias("dirs"), F.aggregate("r.sizes", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"), F.size("r.times").cast("long").alias("n"))


@query(duck("packets") + FLOWS_SQL + """ SELECT src_ip, src_port, dst_port, segment, array_to_string([least(abs(x), 2000) + 1 FOR x IN sizes[1:128]], ',') AS tok_sizes FROM flow""")
def ppi_to_sample(spark, d):
    p = _segments(spark, d).withColumn("r", features.parse_ppi(F.to_json(features.to_ppi(F.col("sizes"), features.seconds(F.col("offsets_us")), 128))))
    return p.select("src_ip", "src_port", "dst_port", "segment", F.array_join(features.ppi_sample(F.col("r"))["sizes"].cast("array<string>"), ",").alias("tok_sizes"))


@query(duck("packets") + FLOWS_SQL + " SELECT src_ip, src_port, dst_port, segment, array_to_string(sizes, ',') AS sizes, len(sizes) AS n FROM flow")
def parse_vector(spark, d):
    text = _segments(spark, d).withColumn("v", flows.parse_vector(F.array_join(F.col("sizes").cast("array<string>"), ","), "int"))
    return text.select("src_ip", "src_port", "dst_port", "segment", F.array_join(F.col("v").cast("array<string>"), ",").alias("sizes"), F.size("v").cast("long").alias("n"))


def _uniform(salt: str) -> str:
    parts = ("src_ip || '|' || src_port || '|' || dst_ip || '|' || segment", "i - 1", f"'{salt}'", "42")
    return f"(({portable_hash(*parts)} % 1099511627776 + 0.5) / 1099511627776.0)"


@query(duck("packets") + FLOWS_SQL + f""", t AS (SELECT *, {_uniform("drop")} < 0.15 AS gone, sqrt(-2 * ln({_uniform("r")})) * cos(2 * pi() * {_uniform("a")}) * 0.005 AS noise, sizes[i] AS x, least(greatest(offsets_us[i] / 1000000.0, 0.0), 10.0) AS t
  FROM (SELECT *, unnest(range(1, least(len(sizes), 128) + 1)) AS i FROM (SELECT *, row_number() OVER () AS f FROM flow)) u)
SELECT src_ip, src_port, dst_ip, segment, string_agg(CASE WHEN gone THEN 0 ELSE least(abs(x), 2000) + 1 END, ',' ORDER BY i) AS sizes, string_agg(CASE WHEN gone OR x = 0 THEN 0 WHEN x > 0 THEN 1 ELSE 2 END, ',' ORDER BY i) AS dirs,
  string_agg(CAST(round(least(greatest(t + noise, 0.0), 10.0) * 1000000) AS BIGINT), ',' ORDER BY i) AS micros FROM t GROUP BY f, src_ip, src_port, dst_ip, segment""")
def augment(spark, d):
    e = features.encode(_segments(spark, d)).withColumn("a", features.augment(F.col("encoded"), F.concat_ws("|", "src_ip", "src_port", "dst_ip", "segment")))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return e.select("src_ip", "src_port", "dst_ip", "segment", text(F.col("a.sizes")).alias("sizes"), text(F.col("a.dirs")).alias("dirs"), text(F.transform("a.times", lambda x: F.round(x * 1_000_000).cast("long"))).alias("micros"))


RISK_SQL = "CASE WHEN prob >= 0.9 THEN 'high' WHEN prob >= 0.7 THEN 'medium' WHEN prob >= 0.5 THEN 'low' ELSE 'informational' END"


@query(duck("alerts") + f"z AS (SELECT 1) SELECT alert_id, {RISK_SQL} AS risk, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS predicted, CASE WHEN prob > 1 - prob THEN 1 ELSE 0 END AS by_class FROM alerts")
def risk_levels(spark, d):
    p = F.col("prob")
    return view(spark, d, "alerts").select("alert_id", scoring.risk_level(p).alias("risk"), scoring.predicted(p).alias("predicted"), scoring.predicted_by_classes(1 - p, p).alias("by_class"))


@query(duck("alerts") + "z AS (SELECT 1) SELECT alert_id, prob FROM alerts WHERE prob >= 0.5 ORDER BY prob DESC, alert_id LIMIT 50")
def top_candidates(spark, d):
    return scoring.top_candidates(view(spark, d, "alerts"), 50, ties=("alert_id",)).select("alert_id", "prob")


@query(duck("alerts") + "z AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY prob DESC, alert_id) AS r FROM alerts WHERE prob >= 0.5) SELECT sensor_id, alert_id, prob FROM z WHERE r <= 10")
def top_candidates_per_sensor(spark, d):
    return scoring.top_candidates(view(spark, d, "alerts"), 10, ties=("alert_id",), per=("sensor_id",)).select("sensor_id", "alert_id", "prob")


@query(duck("alerts") + f"""z AS (SELECT prob, {RISK_SQL} AS risk FROM alerts) SELECT count(*) AS total, count(*) FILTER (prob >= 0.5) AS above, least(count(*) FILTER (prob >= 0.5), 10) AS reported, max(prob) AS max_probability,
  count(*) FILTER (risk = 'high') AS n_high, count(*) FILTER (risk = 'medium') AS n_medium, count(*) FILTER (risk = 'low') AS n_low, count(*) FILTER (risk = 'informational') AS n_informational, 0 AS n_unknown FROM z""")
def run_summary(spark, d):
    return scoring.run_summary(view(spark, d, "alerts"))


@query(duck("alerts") + """o AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN prob + 0.001 ELSE prob END AS other FROM alerts WHERE event_id % 97 <> 0)
SELECT count(*) FILTER (o.alert_id IS NOT NULL) AS pairs, count(*) FILTER (o.alert_id IS NULL) AS one_sided, 0 AS unequal_dst_ip, round(max(abs(a.prob - o.other)), 9) AS max_error, false AS agree FROM alerts a LEFT JOIN o ON a.alert_id = o.alert_id""")
def compare_producers(spark, d):
    a = view(spark, d, "alerts")
    b = a.where("event_id % 97 <> 0").withColumn("prob", F.when(F.col("event_id") % 50 == 0, F.col("prob") + 0.001).otherwise(F.col("prob")))
    return scoring.compare_producers(a, b, ("alert_id",), ("dst_ip",)).withColumn("max_error", F.round("max_error", 9))


SECONDS_SQL = "CASE WHEN start_us % 1000000 = 0 THEN (start_us // 1000000) || '.0' ELSE (start_us // 1000000) || '.' || rtrim(lpad(CAST(start_us % 1000000 AS VARCHAR), 6, '0'), '0') END"
ID_SQL = f"""sha256('{{"flow":["' || src_ip || '",' || src_port || ',"' || dst_ip || '",' || dst_port || ',"tcp",' || {SECONDS_SQL} || '],"model_sha256":"m1","sensor_id":"' || sensor_id || '"}}')"""


@query(duck("alerts") + f"z AS (SELECT 1) SELECT alert_id, {ID_SQL} AS event_id, sha256(alert_id || '|evidence_snapshot|1') AS snapshot_id FROM alerts")
def alert_event_ids(spark, d):
    a = view(spark, d, "alerts")
    own = events.alert_event_id(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.lit("tcp"), F.col("start_us"), F.col("sensor_id"), F.lit("m1"))
    return a.select("alert_id", own.alias("event_id"), events.evidence_id(F.col("alert_id")).alias("snapshot_id"))


BUILT_SQL = """, m AS (SELECT src_ip, src_port, dst_ip, dst_port, started_us AS start_us, ended_us, len(sizes) AS packet_count, CAST(CAST(list_sum([abs(x) FOR x IN sizes]) AS BIGINT) % 1000 AS DOUBLE) / 1000.0 AS prob, 's1' AS sensor_id FROM flow)"""


@query(duck("packets") + FLOWS_SQL + BUILT_SQL + f" SELECT {ID_SQL} AS event_id, sensor_id, src_ip, ended_us AS observed_us, 1 AS prediction, prob AS malware_probability, {RISK_SQL} AS risk_level, packet_count FROM m WHERE prob >= 0.5")
def build_alerts(spark, d):
    flows_ = flows.summarize(_segments(spark, d)).withColumn("close_reason", F.lit("idle_timeout"))
    flows_ = flows_.withColumn("probability", closed_form_score(flows_))
    return events.build_alerts(flows_, "m1", F.lit("s1")).select("event_id", "sensor_id", F.col("flow.src_ip").alias("src_ip"), F.unix_micros("observed_at").alias("observed_us"), "prediction", "malware_probability", "risk_level", F.col("summary.packet_count").alias("packet_count"))


@query(duck("alerts", "conn") + """p AS (SELECT a.alert_id, count(c.uid) AS n FROM alerts a LEFT JOIN conn c ON (c.orig_h = a.src_ip OR c.resp_h = a.src_ip) AND c.ts_us BETWEEN a.start_us - 3600000000 AND a.end_us + 3600000000 GROUP BY 1)
SELECT p.alert_id, sha256(p.alert_id || '|evidence_snapshot|1') AS event_id, least(n, 50) AS n_conn, a.start_us - 30000000 AS from_us, a.end_us + 30000000 AS to_us FROM p JOIN alerts a ON a.alert_id = p.alert_id""")
def build_snapshots(spark, d):
    from trafficjobs.operators import correlate

    a = view(spark, d, "alerts")
    near = correlate.alert_connections(a, view(spark, d, "conn"), 3_600_000_000).groupBy("alert_id").agg(F.collect_list("conn_uid").alias("conn"))
    held = a.join(near, "alert_id", "left").withColumn("ids", F.array().cast("array<string>")).withColumn("conn", F.coalesce("conn", F.array().cast("array<string>")))
    s = events.build_snapshots(held)
    return s.select(F.col("alert_event_id").alias("alert_id"), "event_id", F.col("evidence.summary.conn").cast("long").alias("n_conn"), F.col("window.start_us").alias("from_us"), F.col("window.end_us").alias("to_us"))


@query("""SELECT event_id, '{"a":{"uid":"' || event_id || '"},"b":[' || (event_id % 7) || ']}' AS clean FROM events""")
def redact_evidence(spark, d):
    raw = F.concat(F.lit('{"Payload":"x","a":{"packet":1,"uid":"'), F.col("event_id").cast("string"), F.lit('","payload_printable":"y"},"b":['), (F.col("event_id") % 7).cast("string"), F.lit("]}"))
    return view(spark, d, "events").select("event_id", events.redact(raw).alias("clean"))


@query(duck("beats") + """z AS (SELECT 1) SELECT event_id, sensor_id, sha256(sensor_id || '|sensor_heartbeat|' || strftime(make_timestamp(observed_us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00') AS heartbeat_id, CASE WHEN received > 0 THEN round(CAST(dropped AS DOUBLE) / received, 9) END AS rate FROM beats""")
def heartbeat_events(spark, d):
    return view(spark, d, "beats").select("event_id", "sensor_id", events.heartbeat_id(F.col("sensor_id"), F.col("observed_us")).alias("heartbeat_id"), F.round(events.drop_rate(F.col("received"), F.col("dropped")), 9).alias("rate"))


def _twice(a):
    return a.unionByName(a.where("event_id % 10 = 0").withColumn("start_us", F.col("start_us") + 5))


@query(duck("alerts") + "z AS (SELECT 1) SELECT alert_id, start_us FROM alerts WHERE event_id % 3 <> 0")
def record_once(spark, d):
    a = view(spark, d, "alerts")
    return events.record_once(_twice(a), ["start_us"], "alert_id", a.where("event_id % 3 = 0")).select("alert_id", "start_us")


@query(duck("alerts") + "z AS (SELECT 1) SELECT alert_id, start_us FROM alerts WHERE event_id % 3 <> 0")
def record_once_stored(spark, d):
    """The same against a store with filters that two batches have been added to."""
    a, path = view(spark, d, "alerts"), scratch(spark, "ids")
    for part in (0, 3):
        id_store.add(a.where(f"event_id % 6 = {part}"), path, "alert_id")
    fresh, _ = id_store.unseen(_twice(a), path, "alert_id")
    return events.record_once(fresh, ["start_us"], "alert_id").select("alert_id", "start_us")


@query(duck("alerts") + "z AS (SELECT 1) SELECT event_id, created_us FROM (SELECT event_id, start_us AS created_us FROM alerts) WHERE event_id % 4 <> 1")
def pending_outbox(spark, d):
    a = view(spark, d, "alerts").select("event_id", F.col("start_us").alias("created_us"))
    return events.pending(a, a.where("event_id % 4 = 1"))


@query("""WITH f AS (SELECT concat('p', doc_id) AS path, sha256(coalesce(text, '')) AS signature, doc_id FROM documents), seen AS (SELECT DISTINCT signature FROM f WHERE doc_id % 9 = 0)
SELECT min(path) AS path, signature FROM f WHERE signature NOT IN (SELECT signature FROM seen) GROUP BY signature""")
def skip_processed_files(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return events.unprocessed_files(docs, docs.where("doc_id % 9 = 0").select(F.sha2("content", 256).alias("signature")))


_EVENTS_SQL = "ev AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN '2' WHEN event_id % 17 = 0 THEN 'x' ELSE '1' END AS schema_version, CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'ai_alert' END AS kind FROM alerts)"


def _sensor_events(spark, d):
    a = view(spark, d, "alerts")
    version = F.when(F.col("event_id") % 13 == 0, "2").when(F.col("event_id") % 17 == 0, "x").otherwise("1")
    return a.withColumns({"schema_version": version, "event_type": F.when(F.col("event_id") % 11 == 0, "other").otherwise("ai_alert")})


@query(duck("alerts") + _EVENTS_SQL + " SELECT event_id, (schema_version = '1' AND kind = 'ai_alert' AND sensor_id IN ('s0', 's1', 's2', 's3')) AS accepted FROM ev")
def validate_quarantine(spark, d):
    good, bad = events.validate(_sensor_events(spark, d), "ai_alert", SENSORS)
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


@query(duck("beats") + "z AS (SELECT 1) SELECT event_id, sensor_id, CAST(sum(received) OVER w AS BIGINT) AS total_received, CAST(sum(dropped) OVER w AS BIGINT) AS total_dropped FROM beats WINDOW w AS (PARTITION BY sensor_id ORDER BY observed_us, event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, d):
    return events.running_totals(view(spark, d, "beats"), ["observed_us", "event_id"], columns=("received", "dropped")).select("event_id", "sensor_id", "total_received", "total_dropped")


@query(duck("alerts") + f"""z AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'evidence_snapshot' WHEN 1 THEN 'sensor_heartbeat' WHEN 2 THEN 'ai_alert' ELSE 'other' END AS event_type, {RISK_SQL} AS risk FROM alerts)
SELECT event_id, CASE WHEN event_type = 'evidence_snapshot' THEN 110104 WHEN event_type = 'sensor_heartbeat' THEN 110105 WHEN event_type = 'ai_alert' AND risk = 'high' THEN 110103 WHEN event_type = 'ai_alert' AND risk = 'medium' THEN 110102
  WHEN event_type = 'ai_alert' AND risk = 'low' THEN 110101 ELSE 110100 END AS rule_id, CASE WHEN event_type = 'evidence_snapshot' THEN 3 WHEN event_type = 'sensor_heartbeat' THEN 1 WHEN event_type = 'ai_alert' AND risk = 'high' THEN 12
  WHEN event_type = 'ai_alert' AND risk = 'medium' THEN 8 WHEN event_type = 'ai_alert' AND risk = 'low' THEN 5 ELSE 3 END AS rule_level FROM z""")
def siem_severity(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("evidence_snapshot", "sensor_heartbeat", "ai_alert", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    a = view(spark, d, "alerts").withColumns({"event_type": kind, "risk_level": scoring.risk_level(F.col("prob"))})
    return events.with_siem_rule(a).select("event_id", "rule_id", "rule_level")


_CENTRAL_SQL = duck("alerts") + _EVENTS_SQL + ", tw AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (start_us + 5 AS start_us) FROM ev WHERE event_id % 10 = 0), mk AS (SELECT *, (schema_version = '1' AND kind = 'ai_alert' AND sensor_id IN ('s0', 's1', 's2', 's3')) AS ok FROM tw)"


@query(_CENTRAL_SQL + " SELECT count(DISTINCT CASE WHEN ok THEN event_id END) AS matched, count(*) FILTER (NOT ok) AS quarantined, count(*) FILTER (ok) - count(DISTINCT CASE WHEN ok THEN event_id END) AS duplicates FROM mk")
def central_alert_counts(spark, d):
    return search.central_alerts(_twice(_sensor_events(spark, d)), SENSORS, ["start_us"])[1]


@query(_CENTRAL_SQL + " SELECT event_id, min(start_us) AS start_us FROM mk WHERE ok GROUP BY 1")
def central_alerts(spark, d):
    return search.central_alerts(_twice(_sensor_events(spark, d)), SENSORS, ["start_us"])[0].select("event_id", "start_us")
