"""Cases of searches, events, sampling, retrieval and cases that the shared tables don't hold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trafficjobs import session
from trafficjobs.functions import scoring
from trafficjobs.operators import cases, correlate, events, retrieval, sampling, search


def test_aliases_and_leaves(spark):
    df = spark.createDataFrame([('{"b":{"uid":"x"},"a":1}',), ('{"a":{"z":[{"zeek_uid":7}]},"uid":null}',), ("no json",), (None,), ('[{"uid":"first"},{"uid":"second"}]',)], "j string")
    out = [r.v for r in df.select(search.find_first_alias(F.col("j"), search.ALIASES["uid"]).alias("v")).collect()]
    assert out == ["x", None, None, None, "first"]  # a null alias ends the search of its object
    out = [r.v for r in df.select(search.find_first_alias(F.col("j"), search.ALIASES["uid"], empty_goes_on=True).alias("v")).collect()]
    assert out == ["x", "7", None, None, "first"]
    df2 = spark.createDataFrame([('{"score": null, "x": {"score": 1}}',), ('{"a": {"score": null, "b": {"score": 2}}, "c": {"score": 3}}',)], "j string")
    assert [r.v for r in df2.select(search.find_first_alias(F.col("j"), ("score",)).alias("v")).collect()] == [None, "3"]
    out = [r.v for r in df.select(search.leaves(F.col("j")).alias("v")).collect()]
    assert list(out[0]) == ["x", "1"] and list(out[4]) == ["first", "second"]


def test_redaction(spark):
    text = json.dumps({"Payload": "x", "a": [{"PACKET": 1, "uid": "u", "alert": {"signature": "s", "packet_info": {}}}], "payload_printable": 2})
    assert json.loads(spark.createDataFrame([(text,)], "t string").select(events.redact(F.col("t"))).first()[0]) == {"a": [{"uid": "u", "alert": {"signature": "s"}}]}


def test_times(spark):
    df = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("2026-01-02T03:04:05.5",), ("1779933600.25",), ("-",), (None,)], "t string")
    assert [r[0] for r in df.select(search.parse_time(F.col("t"))).collect()] == [1767323045000000, 1767323045500000, 1779933600250000, None, None]
    df = spark.createDataFrame([(10_000_000,), (250_000,), (1753747200123456,)], "u long")
    assert [r[0] for r in df.select(events.seconds_text(F.col("u"))).collect()] == ["10.0", "0.25", "1753747200.123456"]


def test_levels(spark):
    df = spark.createDataFrame([("0.95",), ("0.7",), ("0.5",), ("0.1",), ("x",), (None,), ("NaN",)], "s string")
    assert [r[0] for r in df.select(scoring.risk_level(F.col("s"))).collect()] == ["high", "medium", "low", "informational", "unknown", "unknown", "unknown"]


def test_windows_of_any_length_take_two_cells(spark):
    """From an instant to centuries, before the epoch too, ends before starts, nulls; equal to the plain condition."""
    rng, us = random.Random(4), 1_000_000
    starts = [rng.randint(-(10**9), 10**9) * us for _ in range(60)]
    spans = [0, 1, us, 7 * us, 8 * us, 8 * us + 1, 10**5 * us, 10**8 * us, 10**10 * us, -5]
    alerts = [(f"a{k}", f"h{k % 3}", s, s + spans[k % 10]) for k, s in enumerate(starts)] + [("n1", None, 0, 5), ("n2", "h1", None, 5)]
    logs = [(f"h{k % 3}", rng.choice(starts) + rng.choice([0, -1, 1, 5 * us, rng.randint(-(10**15), 10**15)]), k) for k in range(600)] + [(None, 3, -1), ("h1", None, -2)]
    a, b = spark.createDataFrame(alerts, "alert_id string, src_ip string, start_us long, end_us long"), spark.createDataFrame(logs, "ip string, ts_us long, no int")
    got = sorted((r.alert_id, r.no) for r in correlate.interval_join(a, b, us, None).collect())
    want = sorted((i, n) for i, h, s, e in alerts for ip, t, n in logs if None not in (h, s, ip, t) and h == ip and s - us <= t <= e + us)
    assert got == want and len(want) > 500
    assert correlate.interval_join(a.limit(0), b, us, None).count() == 0


def test_skewed_interval_join_is_whole(spark):
    alerts = spark.range(50).select(F.concat(F.lit("a"), "id").alias("alert_id"), F.lit("h").alias("src_ip"), (F.col("id") * 1_000_000).alias("start_us"), (F.col("id") * 1_000_000 + 500_000).alias("end_us"))
    logs = spark.range(500).select(F.lit("h").alias("ip"), (F.col("id") * 100_000).alias("ts_us"))
    got = correlate.interval_join(alerts, logs, 2_000_000, None).count()
    want = alerts.crossJoin(logs).where("ts_us between start_us - 2000000 and end_us + 2000000").count()
    assert got == want


def _joined_rows(df):
    """Rows that the joins of a plan have made."""
    df.collect()
    stack, total = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        p = stack.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(p.executedPlan())
        elif "QueryStage" in name:
            stack.append(p.plan())
        else:
            stack += [p.children().apply(k) for k in range(p.children().size())]
            if "Join" in name:
                total += p.metrics().apply("numOutputRows").value()
    return total


def test_first_rows_of_windows_form_no_other_pairs(spark):
    """Equal to the plain condition and order, and a busy host's windows meet a row each, not all log rows in them."""
    rng = random.Random(8)
    alerts = [(f"a{k // 2}", f"h{k % 3}", (s := rng.randint(-500, 5000)), s + rng.choice([0, 1, 40, 900, -30])) for k in range(200)] + [("n", None, 1, 2), ("m", "h1", None, 3)]
    logs = [(f"h{k % 4}", rng.randint(-600, 6000), k) for k in range(900)] + [(None, 3, -1), ("h1", None, -2)]
    a, b = spark.createDataFrame(alerts, "alert_id string, src_ip string, start_us long, end_us long"), spark.createDataFrame(logs, "ip string, ts_us long, no int")
    for most, bucket in ((1, None), (3, 70), (50, 10**9)):
        got = sorted((r.alert_id, r.ts_us, r.no) for r in correlate.interval_join(a, b, 10, most, bucket, order=("ts_us", "no")).collect())
        want = []
        for i in {r[0] for r in alerts}:
            want += sorted((i, t, n) for j, h, s, e in alerts for ip, t, n in logs if i == j and None not in (h, s, ip, t) and h == ip and s - 10 <= t <= e + 10)[:most]
        assert got == sorted(want) and len(got) > 50
    busy = spark.range(400).select(F.concat(F.lit("a"), "id").alias("alert_id"), F.lit("h").alias("src_ip"), F.col("id").alias("start_us"), (F.col("id") + 10**6).alias("end_us"))
    out = correlate.interval_join(busy, spark.range(2000).select(F.lit("h").alias("ip"), F.col("id").alias("ts_us"), "id"), 0, 2, order=("ts_us", "id"))
    assert out.count() == 800 and _joined_rows(out) < 10_000


def test_decisions_alike_in_time_and_number_give_one_result_in_any_order(spark):
    c = spark.createDataFrame([(1, "k", "new", 5)], "case_id long, alert_key string, status string, created_us long")
    alike = [(1, 2, s, "d", o, "r", 9) for s, o in (("closed", "o1"), ("in_review", "o3"), ("escalated", "o2"), ("closed", "o4"))]
    schema = "case_id long, seq int, status string, disposition string, owner string, reason string, decided_us long"
    found = {cases.apply_decisions(c, spark.createDataFrame(alike[k:] + alike[:k], schema).coalesce(1))[0].select("status", "owner").first() for k in range(4)}
    assert found == {("in_review", "o3")}


def _samples(spark):
    return spark.range(3000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"))


def test_sampling_repeats_under_any_partitioning(spark):
    s = _samples(spark)
    for job in (lambda d: sampling.cap_per_source(d, 20), sampling.stratified_split, lambda d: sampling.stratified_split(d, exact=False), sampling.split_by_source, lambda d: sampling.balanced_resample(d, 5000), sampling.triplets):
        a, b = (sorted(map(str, job(d).select(*sorted(job(d).columns)).collect())) for d in (s, s.repartition(13)))
        assert a == b
    assert {r.n for r in sampling.cap_per_source(s, 20).groupBy("label", "source").agg(F.count("*").alias("n")).collect()} == {20}
    assert sampling.cap_per_source(s, 0).count() == 3000
    draws = {r.label: r["count"] for r in sampling.balanced_resample(s, 5000).groupBy("label").count().collect()}
    assert all(abs(n - 2500) < 250 for n in draws.values())
    t = sampling.triplets(s)
    assert t.count() == 3000 and t.where("label = negative_label").count() == 0
    assert sampling.triplets(s.where("label = 0")).count() == 2700
    with pytest.raises(ValueError):
        sampling.split_by_source(s.where("source in ('s1', 's2')"))
    sizes = {r.split: r["count"] for r in sampling.split_by_source(s).groupBy("split").count().collect()}
    assert set(sizes) == {"train", "val", "test"} and sizes["train"] > sizes["val"]


def test_hashed_embedding_by_the_rule():
    import hashlib
    import re

    texts = ["Port 443 beacon 日 beacon", "", None, "a:b/c.d@e_f-g x x x"]
    want = []
    for t in texts:
        row = [0.0] * 384
        for token in re.findall(retrieval.TOKEN, (t or "").lower()):
            d = hashlib.blake2b(token.encode(), digest_size=8).digest()
            row[int.from_bytes(d[:4], "little") % 384] += 1.0 if d[4] % 2 else -1.0
        want.append(row)
    assert retrieval.embed_batch(texts).tolist() == want


def test_blank_queries_and_own_rows_find_nothing(spark, monkeypatch):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, [0.9, 0.1])], "base_id long, vector array<float>")
    queries = base.select(F.col("base_id").alias("query_id"), "vector")
    for rows in (20_000, 2):
        monkeypatch.setattr(retrieval, "MATRIX_ROWS", rows)
        got = sorted((r.query_id, r.rank, r.base_id) for r in retrieval.top_similar(queries, base, 2, exclude_own=True).collect())
        assert got == [(1, 1, 2), (1, 2, 4), (2, 1, 1), (2, 2, 4), (4, 1, 1), (4, 2, 2)]
    assert retrieval.top_similar(queries, base.limit(0), 2).count() == 0


def test_equal_questions_are_asked_once(spark):
    base = spark.createDataFrame([(1, "port 443 open"), (2, "port 80")], "base_id long, text string")
    asked = spark.createDataFrame([(7, "port 443"), (8, "port 443"), (9, None), (10, "none of it")], "query_id long, text string")
    got = {(r.query_id, r.rank, r.base_id) for r in retrieval.answers(asked, base, 1).collect()}
    assert got == {(7, 1, 1), (8, 1, 1)}


def test_totals_and_ranks_over_buckets(spark):
    rows = [("a" if i % 3 else None, i, (i * 7919) % 100 / 100 if i % 10 else None, i * 40_000_000_000 if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "sensor_id string, alert_id long, prob double, at long")
    got = {r.alert_id: r.total_alert_id for r in events.running_totals(df, ["at", "alert_id"], columns=("alert_id",)).collect()}
    for s in ("a", None):
        total = 0
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3] is not None, r[3] or 0, r[1])):
            total += r[1]
            assert got[r[1]] == total
    ends = df.withColumns({k: F.lit("h") for k in ("src_ip", "dst_ip")} | {k: F.lit(1) for k in ("src_port", "dst_port")})
    want = {r[1]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1])))}
    assert {r.alert_id: r.rank for r in cases.compact_events(ends).collect()} == want


def test_hashed_embedding_and_block_search(spark, monkeypatch):
    v = retrieval.embed_batch(["Port 443 beacon 日", "", None])
    assert v.shape == (3, 384) and abs(v[0]).sum() == 4 and not v[1:].any()
    base = spark.range(300).select(F.col("id").alias("base_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(100)).cast("float")).alias("vector"))
    queries = base.where("base_id < 20").select(F.col("base_id").alias("query_id"), "vector")
    want = sorted(map(tuple, retrieval.top_similar(queries, base, 3).collect()))
    monkeypatch.setattr(retrieval, "MATRIX_ROWS", 64)
    got = retrieval.top_similar(queries, base, 3)
    assert sorted(map(tuple, got.select("query_id", "rank", "base_id", "score").collect())) == want


def test_quality(spark):
    good = "Alert by the model. Wazuh rules. Zeek shows. RAG playbook. 误报"
    df = spark.createDataFrame([(good, 1, 1, 1, 0, 1), (good[:-2], 1, 1, 0, 1, 1), (good, 0, 0, 0, 0, 0)], "markdown string, n_alerts int, n_siem int, n_conn int, n_ids int, n_knowledge int")
    assert [(r.status, r.missing) for r in cases.quality_checks(df).collect()] == [("complete", []), ("incomplete", ["limitations"]), ("incomplete", ["ai_alert_summary", "wazuh_evidence", "network_context", "rag_basis"])]


def test_central_alert_counts(spark):
    rows = [("1", "ai_alert", "s1", "e1", 1), ("1", "ai_alert", "s1", "e1", 2), ("2", "ai_alert", "s1", "e2", 1), ("1", "ai_alert", "s9", "e3", 1), ("1", "other", "s1", "e4", 1), ("x", "ai_alert", "s1", "e5", 1)]
    df = spark.createDataFrame(rows, "schema_version string, event_type string, sensor_id string, event_id string, t int")
    found, counts = search.central_alerts(df, ["s1"], ["t"])
    assert [(r.event_id, r.t) for r in found.collect()] == [("e1", 1)] and tuple(counts.first()) == (1, 4, 1)


def test_tables_of_a_scope_are_dropped_alone(spark):
    session.drop_tables(spark)
    outer = session.materialize(spark.range(3), "outer")
    with session.tables() as made:
        inner, stays = session.materialize(spark.range(4), "inner"), session.materialize(spark.range(6), "stays")
        assert len(made) == 2 and inner.count() == 4
    assert session.drop_tables(spark, made[:1]) == 1 and outer.count() == 3 and stays.count() == 6
    assert session.drop_tables(spark) == 2


def test_broadcast_bound_is_rows_and_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(session.small(spark.range(100))) and not hinted(session.small(spark.range(100), rows=99))
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) `a.b`", "sequence(1L, 100L) c", "map('k', named_struct('v', repeat('y', 1000))) d", "cast(null as string) e")
    # 8 for id, 1,008 for the text, 808 for the array, the map as JSON, 8 for the null
    assert hinted(session.small(wide, size=300_000)) and not hinted(session.small(wide, size=283_000))
    assert hinted(session.small(wide.limit(0), size=0))


def test_scratch_tables_can_be_dropped(spark):
    session.drop_tables(spark)
    kept = session.materialize(spark.range(5), "five")
    assert kept.count() == 5 and session.drop_tables(spark) == 1 and session.drop_tables(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.scratch(Session(), "x")
