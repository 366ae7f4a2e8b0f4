"""Queries of the training-data workload of the traffic model: caps, splits, weights, metrics, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficjobs.functions import features
from trafficjobs.operators import flows, metrics, sampling
from trafficjobs.plans.catalog import query
from trafficjobs.plans.detect import FLOWS_SQL
from trafficjobs.plans.views import duck, packets, portable_hash, view
from trafficjobs.sources import sinks


@query(duck("samples") + "c AS (SELECT label, source, least(count(*), 3) AS n FROM samples GROUP BY 1, 2) SELECT label, source, n FROM c")
def cap_per_source_counts(spark, d):
    return sampling.cap_per_source(view(spark, d, "samples"), 3).groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))


@query(duck("samples") + f"z AS (SELECT *, row_number() OVER (PARTITION BY label, source ORDER BY {portable_hash('id', '42')}, id) AS no FROM samples) SELECT * EXCLUDE (no) FROM z WHERE no <= 3")
def cap_per_source(spark, d):
    return sampling.cap_per_source(view(spark, d, "samples"), 3)


SPLIT_SQL = duck("samples") + """c AS (SELECT label, count(*) AS n FROM samples GROUP BY 1), k AS (SELECT label, CAST(round(n * 0.2) AS BIGINT) AS t, n FROM c)"""


@query(SPLIT_SQL + " SELECT label, 'test' AS split, t AS n FROM k UNION ALL SELECT label, 'val', t FROM k UNION ALL SELECT label, 'train', n - 2 * t FROM k")
def stratified_split_counts(spark, d):
    return sampling.stratified_split(view(spark, d, "samples")).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(duck("samples") + f"""z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {portable_hash('id', '42')}, id) AS no, round(count(*) OVER (PARTITION BY label) * 0.2) AS share FROM samples)
SELECT id, label, CASE WHEN no <= share THEN 'test' WHEN no <= 2 * share THEN 'val' ELSE 'train' END AS split FROM z""")
def stratified_split(spark, d):
    return sampling.stratified_split(view(spark, d, "samples")).select("id", "label", "split")


@query(duck("samples") + f"z AS (SELECT *, {portable_hash('id', '42')} % 1073741824 / 1073741824.0 AS at FROM samples) SELECT id, label, CASE WHEN \"at\" < 0.2 THEN 'test' WHEN \"at\" < 0.4 THEN 'val' ELSE 'train' END AS split FROM z")
def hash_split(spark, d):
    return sampling.stratified_split(view(spark, d, "samples"), exact=False).select("id", "label", "split")


@query(duck("samples") + "s AS (SELECT label, source, count(*) AS n FROM samples GROUP BY 1, 2) SELECT label, source, n, 1 AS n_splits FROM s")
def split_by_source_integrity(spark, d):
    s = sampling.split_by_source(view(spark, d, "samples"))
    return s.groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").cast("int").alias("n_splits"))


BY_SOURCE_SQL = duck("samples").replace("WITH ", "WITH RECURSIVE ", 1) + f"""c AS (SELECT label, source, count(*) AS n FROM samples WHERE label IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, {portable_hash('source', '42')}, source) AS no, sum(n) OVER (PARTITION BY label) AS total FROM c),
s AS (SELECT *, greatest(1, round_even(total * 0.2, 0)) AS val, greatest(1, round_even(total * 0.2, 0)) AS test FROM o), t AS (SELECT *, greatest(1, total - val - test) AS train FROM s),
walk AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS no, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS split, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM t UNION ALL
  SELECT label, no, source, split, a + CASE WHEN split = 'train' THEN n ELSE 0 END, b + CASE WHEN split = 'val' THEN n ELSE 0 END, c + CASE WHEN split = 'test' THEN n ELSE 0 END FROM (
    SELECT t.label, t.no, t.source, t.n, w.a, w.b, w.c, CASE t.no WHEN 1 THEN 'train' WHEN 2 THEN 'val' WHEN 3 THEN 'test' ELSE greatest(
      struct_pack(share := (t.train - w.a) / t.train, rows := t.train - w.a, split := 'train'), struct_pack(share := (t.val - w.b) / t.val, rows := t.val - w.b, split := 'val'),
      struct_pack(share := (t.test - w.c) / t.test, rows := t.test - w.c, split := 'test')).split END AS split
    FROM walk w JOIN t ON t.label = w.label AND t.no = w.no + 1) x)
SELECT s.id, s.label, s.source, w.split FROM samples s JOIN walk w ON w.label = s.label AND w.source = s.source"""


@query(BY_SOURCE_SQL)
def split_by_source(spark, d):
    return sampling.split_by_source(view(spark, d, "samples")).select("id", "label", "source", "split")


def _poisson(mean: str, u: str) -> str:
    """How often a row is drawn whose mean is under 1: terms of the distribution function are added until they reach u."""
    terms = [f"exp(-{mean})"]
    for i in range(1, 9):
        terms.append(f"{terms[-1]} * {mean} / {i}")
    return " + ".join(f"CASE WHEN {u} > {' + '.join(f'({t})' for t in terms[:i])} THEN 1 ELSE 0 END" for i in range(1, 9))


@query(duck("samples") + f"""c AS (SELECT label, count(*) AS n FROM samples WHERE label IS NOT NULL GROUP BY 1), m AS (SELECT label, 4.0 * (SELECT count(*) FROM samples) / ((SELECT count(*) FROM c) * n) AS mean FROM c),
u AS (SELECT s.id, s.label, floor(mean) AS whole, mean - floor(mean) AS part, ({portable_hash('s.id', '42', "'draw'")} % 1099511627776 + 0.5) / 1099511627776.0 AS u FROM samples s JOIN m ON m.label = s.label),
t AS (SELECT id, label, CAST(whole AS INTEGER) + {_poisson("CAST(part AS DOUBLE)", "CAST(u AS DOUBLE)")} AS times FROM u) SELECT id, label, CAST(unnest(range(1, times + 1)) AS INTEGER) AS draw FROM t WHERE times > 0""")
def balanced_resample(spark, d):
    s = view(spark, d, "samples")
    return sampling.balanced_resample(s, 4 * s.count()).select("id", "label", "draw")


@query(duck("samples") + f"""h AS (SELECT id, label, {portable_hash('id', '42')} AS h FROM samples), p AS (SELECT *, row_number() OVER (ORDER BY label, h % 256, id) - 1 AS place FROM h),
r AS (SELECT label, count(*) AS n, min(place) AS first, (SELECT count(*) FROM h) AS whole FROM p GROUP BY 1),
d AS (SELECT h.id, h.label, CASE WHEN whole = n THEN h % n WHEN h % (whole - n) < first THEN h % (whole - n) ELSE h % (whole - n) + n END AS place FROM h JOIN r ON r.label = h.label)
SELECT d.id, d.label, p.id AS negative_id, p.label AS negative_label FROM d JOIN p ON p.place = d.place""")
def triplets(spark, d):
    return sampling.triplets(view(spark, d, "samples"))


@query(duck("samples") + "z AS (SELECT 1) SELECT id, label FROM samples")
def shuffled(spark, d):
    return sampling.shuffled(view(spark, d, "samples")).select("id", "label")


@query(duck("samples") + """s AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'test' WHEN id % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM samples)
SELECT split, label, source, count(*) AS n FROM s GROUP BY GROUPING SETS ((split), (split, label), (split, source))""")
def split_stats(spark, d):
    split = F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "val").otherwise("train")
    return metrics.split_stats(view(spark, d, "samples").withColumn("split", split))


@query(duck("samples") + "z AS (SELECT 1) SELECT id, label, 1.0 / count(*) OVER (PARTITION BY label) AS weight FROM samples")
def class_weights(spark, d):
    return metrics.class_weights(view(spark, d, "samples")).select("id", "label", "weight")


CONFUSION_SQL = duck("samples") + "c AS (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM samples)"


@query(CONFUSION_SQL + " SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1 FROM c")
def confusion(spark, d):
    return metrics.confusion(view(spark, d, "samples")).withColumns({"accuracy": F.round("accuracy", 9), "f1": F.round("f1", 9)})


@query(CONFUSION_SQL + """, p AS (SELECT '1' AS class, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1, tp + fn AS support FROM c
UNION ALL SELECT '0', tn / CAST(tn + fn AS DOUBLE), tn / CAST(tn + fp AS DOUBLE), 2 * tn / CAST(2 * tn + fp + fn AS DOUBLE), tn + fp FROM c), a AS (SELECT * FROM p UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM p
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM p) SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM a""")
def class_report(spark, d):
    return metrics.class_report(view(spark, d, "samples")).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(duck("samples") + "z AS (SELECT 1) SELECT source, count(*) AS n FROM samples GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def top_labels(spark, d):
    return metrics.top_labels(view(spark, d, "samples"), "source", 5)


@query(duck("samples") + "z AS (SELECT 1) SELECT source, count(*) FILTER (id % 4 <> 0) AS saved, count(*) FILTER (id % 4 = 0) AS skipped FROM samples GROUP BY ROLLUP (source)")
def conversion_counts(spark, d):
    return metrics.conversion_counts(view(spark, d, "samples").withColumn("valid", F.col("id") % 4 != 0))


@query(duck("samples") + "z AS (SELECT 1) SELECT id, 1 AS label FROM samples WHERE label = 1 UNION ALL SELECT id, 0 FROM samples WHERE label = 0")
def labelled_union(spark, d):
    s = view(spark, d, "samples")
    return sinks.labelled_union(s.where("label = 1").select("id"), s.where("label = 0").select("id"))


@query("""SELECT 'src' || (event_id % 6) AS "SOURCE", CASE WHEN event_id % 6 < 3 THEN 'benign' ELSE 'malware' END AS "APP", count(*) AS n FROM events WHERE event_id % 6 < 5 GROUP BY 1, 2""")
def assemble_experiment(spark, d):
    e = view(spark, d, "events").select("event_id", F.concat(F.lit("src"), (F.col("event_id") % 6).cast("string")).alias("source"), F.array(F.lit(60), F.lit(-60), F.lit(52)).alias("sizes"), F.array(F.lit(0.0), F.lit(0.1), F.lit(0.2)).alias("times"))
    external = sinks.ppi_rows(e.where("event_id % 6 = 2"), "x").drop("APP")
    out = sinks.assemble_experiment(e.where("event_id % 6 < 2"), e.where("event_id % 6 >= 3"), ["src3", "src4"], external)
    return out.groupBy("SOURCE", "APP").agg(F.count(F.lit(1)).alias("n"))


@query(duck("beats") + "r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY observed_us DESC, event_id DESC) AS no FROM beats) SELECT sensor_id, event_id, observed_us FROM r WHERE no = 1")
def latest_status(spark, d):
    return sinks.latest_status(view(spark, d, "beats")).select("sensor_id", "event_id", "observed_us")


@query(duck("packets") + "z AS (SELECT 1) SELECT ts_us // 5000000 * 5000000 AS start_us, count(*) AS packets, CAST(sum(ip_length) AS BIGINT) AS bytes FROM packets GROUP BY 1")
def rotation_windows(spark, d):
    from trafficjobs.streaming import jobs

    return jobs.rotation_windows(view(spark, d, "packets"))


@query(duck("packets") + """k AS (SELECT *, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS a, greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS b FROM packets),
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY a, b ORDER BY ts_us, event_id, i) >= 30000000 THEN 1 ELSE 0 END AS f FROM k), s AS (SELECT *, sum(f) OVER (PARTITION BY a, b ORDER BY ts_us, event_id, i ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT first_us, last_us, packets, bytes FROM (SELECT a, b, n, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packets, CAST(sum(ip_length) AS BIGINT) AS bytes FROM s GROUP BY 1, 2, 3)""")
def session_windows(spark, d):
    from trafficjobs.streaming import jobs

    return jobs.idle_windows(packets(spark, d)).select("first_us", "last_us", "packets", "bytes")


@query(duck("alerts") + """t AS (SELECT src_ip, start_us // 15000000 * 15000000 - o * 15000000 AS w FROM alerts, (SELECT unnest([0, 1, 2, 3]) AS o)) SELECT src_ip, w AS start_us, count(*) AS n FROM t GROUP BY 1, 2""")
def alert_rate(spark, d):
    from trafficjobs.streaming import jobs

    return jobs.alert_rate(view(spark, d, "alerts"))


def _draw(salt: str) -> str:
    return f"""(({portable_hash("src_ip || '|' || segment", "i - 1", f"'{salt}'", "42")} % 1099511627776 + 0.5) / 1099511627776.0)"""


@query(duck("packets") + FLOWS_SQL + f""", t AS (SELECT f, src_ip, src_port, dst_ip, segment, least(greatest(offsets_us[i] / 1000000.0, 0.0), 10.0) AS t, i, {_draw("r")} AS r, {_draw("a")} AS a FROM (SELECT *, unnest(range(1, least(len(sizes), 30) + 1)) AS i FROM (SELECT *, row_number() OVER () AS f FROM flow)) x)
SELECT src_ip, src_port, dst_ip, segment, CAST(count(*) AS INTEGER) AS n, round(sum(least(greatest(t + sqrt(-2 * ln(r)) * cos(2 * pi() * a) * 0.005, 0.0), 10.0)), 4) AS time_sum FROM t GROUP BY f, src_ip, src_port, dst_ip, segment""")
def augmented_samples(spark, d):
    segments = flows.segment_sequences(flows.with_key(packets(spark, d)), order=("event_id", "i"))
    encoded = features.encode(segments, 30)
    return encoded.select("src_ip", "src_port", "dst_ip", "segment", F.size("encoded.sizes").alias("n"), F.round(F.aggregate(features.noisy_times(F.col("encoded.times"), F.concat_ws("|", "src_ip", "segment")), F.lit(0.0), lambda a, x: a + x), 4).alias("time_sum"))
