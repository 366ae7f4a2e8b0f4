"""Exact quantiles by counted ranges, stored sketches, and the written index of vectors."""

import pathlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficjobs import session
from trafficjobs.operators import id_store, metrics, retrieval, search, sketches, text_index, vector_index


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v long")


@pytest.mark.parametrize("ranges", [16, 4096])
def test_quantiles_equal_numpy(spark, monkeypatch, ranges):
    monkeypatch.setattr(sketches, "RANGES", ranges)
    rng = random.Random(ranges)
    shares = [0.0, 0.5, 0.95]
    for values in ([5], [1, 1, 1, 9], [rng.randint(-(10**9), 10**9) for _ in range(101)], [7] * 60 + [rng.randint(0, 30) for _ in range(41)]):
        got = sketches.quantiles(numbers(spark, values + [None]), "v", shares)
        assert np.allclose(got, np.quantile(np.array(values, dtype=np.float64), shares), rtol=1e-12)
    assert sketches.quantiles(numbers(spark, [None]), "v", [0.5]) == [None]


def test_quality_of_empty_tables(spark):
    r = metrics.latency_p95(numbers(spark, []).withColumnRenamed("v", "delay_us")).first()
    assert r.samples == 0 and r.p95_us is None and not r.accepted
    cases = spark.createDataFrame([], "status string, disposition string, created_us long, closed_us long")
    assert metrics.triage_quality(cases).first().median_s is None


def test_sketches_of_batches_merge(spark):
    rng = random.Random(2)
    rows = [(f"s{rng.randint(0, 2)}", rng.randint(0, 10**6), rng.randint(0, 20) * 3_600_000_000 + 5) for _ in range(9000)] + [("s0", None, 5)]
    df = spark.createDataFrame(rows, "sensor_id string, v long, at_us long")
    parts = [sketches.quantile_sketches(df.where(F.pmod(F.xxhash64("v"), F.lit(3)) == k), "v", "at_us") for k in range(3)]
    for r in sketches.sketched_quantiles(parts[0].unionByName(parts[1]).unionByName(parts[2]), [0.1, 0.9]).collect():
        own = np.array(sorted(v for s, v, _ in rows if s == r.sensor_id and v is not None))
        assert r.n == len(own) and all(abs(np.searchsorted(own, q) / len(own) - s) <= sketches.RANK_ERROR for q, s in ((r.q0, 0.1), (r.q1, 0.9)))


def test_distinct_values_met_again(spark):
    rows = [(day, f"h{k}") for day in (1, 2, 4) for k in range(day * 700, day * 700 + 3000)] * 2
    df = spark.createDataFrame(rows, "day long, host string")
    kept = sketches.distinct_sketches(df, "host", ["day"])
    got = {r.day: (r.n, r.n_again) for r in sketches.met_again(kept.unionByName(kept), "day").collect()}
    assert got[1][1] == 0 and got[4][1] == 0 and abs(got[2][0] - 3000) <= 3000 * sketches.DISTINCT_ERROR and abs(got[2][1] - 2300) <= 6000 * sketches.DISTINCT_ERROR
    n = sketches.distinct_of_all(kept).first().n
    assert abs(n - len(set(h for _, h in rows))) <= n * sketches.DISTINCT_ERROR


def test_index_search_equals_all_pairs_and_reads_few_clusters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 30)
    monkeypatch.setattr(vector_index, "ASKED", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + 0.02 * rng.normal(size=(50, 8)) for c in centres / np.linalg.norm(centres, axis=1)[:, None]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(20)]
    base = spark.createDataFrame(rows, "base_id long, vector array<float>")
    asked = base.where("base_id % 20 = 0").select(F.col("base_id").alias("query_id"), "vector").unionByName(spark.createDataFrame([(-1, [0.0] * 8)], "query_id long, vector array<float>"))
    path = str(tmp_path / "index")
    vector_index.write(base, path, 12)
    got = vector_index.search(spark, asked, path, 4, True).collect()
    want = sorted(tuple(r) for r in retrieval.top_similar(asked, base, 4, True).collect())
    assert sorted(tuple(r)[:4] for r in got) == want and len(want) == 31 * 4
    assert sum(r.n_clusters for r in got) / len(got) < 4 and spark.read.parquet(f"{path}/vectors").count() == len(rows)
    none = str(tmp_path / "none")
    vector_index.write(base.limit(0), none)
    assert vector_index.search(spark, asked, none).count() == 0


def test_tfidf_search_equals_the_full_join_and_scores_few_rows(spark):
    """Stop words in every row, rare words in few; ties, rows without a word, queries with fewer than k answers."""
    rng = random.Random(8)
    stop, rare = ["the", "of", "and", "to", "a"], [f"word{k}" for k in range(1500)]
    text = lambda k: " ".join(rng.choice(stop) if rng.random() < 0.6 else rare[min(1499, int(rng.expovariate(1 / 250)))] for _ in range(k))
    kin = [(5000 + 10 * g + v, " ".join([*(f"g{g}x{k}" for k in range(12) if k != v), text(12)])) for g in range(150) for v in range(5)]
    rows = [(i, text(rng.randint(3, 40))) for i in range(750)] + [(2000, ""), (2001, None), (2002, "!!"), (2003, "the the"), (2004, "of only once zebra"), (2005, "zebra of only once")] + kin
    base = spark.createDataFrame(rows, "base_id long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in rows[:750:50]] + kin[::100] + [(3000, "zebra"), (3001, "unknownword"), (3002, None), (3003, "the"), (3004, text(400))], "query_id long, text string")
    want = sorted(tuple(r) for r in retrieval.tfidf_top(asked, base).collect())
    got = retrieval.tfidf_search(asked, base).collect()
    assert sorted(tuple(r)[:4] for r in got) == want and any(r.query_id == 3000 and r.rank == 2 for r in got)
    # the relatives of a text bound the rest; without any, as in the random texts, most rows that share a word are scored
    scored = {r.query_id: r.n_scored for r in got}
    joined = {q: sum(bool(set(t.split()) & set((x or "").split())) for _, x in rows) for q, t in kin[::100]}
    assert all(scored[q] < 0.25 * n for q, n in joined.items()), [(q, scored[q], n) for q, n in joined.items()]
    assert retrieval.tfidf_search(asked.limit(0), base).count() == 0 and retrieval.tfidf_search(asked, base.limit(0)).count() == 0


def test_trigram_search_equals_contains_and_looks_at_few_records(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = [(i, "common prefix " + " ".join(rng.sample(words, 6)), "x") for i in range(800)] + [(900, "", "x"), (901, None, "x"), (902, "ab", "x"), (903, "ÄÖÜß Größe", "x"), (903, "ÄÖÜß Größe", "x"), (904, "gra ram am gram", "x"), (905, "diagram", "x")]
    df, path = spark.createDataFrame(rows, "id long, raw string, gram string"), str(tmp_path / "index")
    for k in range(2):
        text_index.write(df.where(F.col("id") % 2 == k), path, "id", "raw")
    plain = lambda t: sorted(r.id for r in df.where(search.contains_text(F.col("raw"), t)).collect())
    for text in (words[0].upper(), "größe", "common", "ab", "", "gram", "nowhere at all", words[1] + " " + words[2]):
        assert sorted(r.id for r in text_index.search(df, path, "id", "raw", text).collect()) == plain(text), text
    assert text_index.candidates(spark, path, words[0]).count() < 40 and text_index.candidates(spark, path, "ab") is None


def test_store_of_ids_equals_the_anti_join_and_reads_few_parts(spark, tmp_path):
    path = str(tmp_path / "ids")
    ids = lambda xs: spark.createDataFrame([(x, 1) for x in xs], "event_id string, id int")
    new, parts = id_store.unseen(ids(["a", None]), path)
    assert new.count() == 2 and parts == []
    for k in range(3):
        id_store.add(ids([f"e{i}" for i in range(k, 6000, 3)] + [None, "twice", "twice"]), path)
    batch = [f"e{i}" for i in range(5997, 6200)] + ["twice", None, None, "", "e5999"]
    new, parts = id_store.unseen(ids(batch), path)
    got = sorted((r.event_id or "none" for r in new.collect()))
    assert got == sorted(x or "none" for x in batch if x is None or x not in {"twice", *(f"e{i}" for i in range(6000))}) and 1 <= len(parts) <= 10
    assert id_store.unseen(ids([]), path)[0].count() == 0


def test_tfidf_search_writes_less_than_its_texts_and_joins_texts_of_one_id(spark):
    """Pairs of queries and rows are neither shuffled nor written, though here every row shares terms with every query."""
    rng = random.Random(3)
    rows = [(i // 2 * 2 if i > 390 else i, " ".join(f"word{rng.randint(0, 300)}" for _ in range(200))) for i in range(400)]
    base = spark.createDataFrame(rows, "base_id long, text string")
    asked = base.where("base_id % 4 = 0").withColumnRenamed("base_id", "query_id")
    want = sorted(tuple(r) for r in retrieval.tfidf_top(asked, base).collect())
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = shuffled()
    with session.tables() as paths:
        got = sorted(tuple(r)[:4] for r in retrieval.tfidf_search(asked, base).collect())
    written = sum(f.stat().st_size for p in paths for f in pathlib.Path(p.removeprefix("file://")).rglob("*.parquet"))
    assert got == want and len({r[0] for r in got}) * 4 == len(got)
    assert shuffled() - before + written < 2 * sum(len(t) for _, t in rows), (shuffled() - before, written)


@pytest.mark.parametrize("rounds", [1, 2])
def test_tfidf_search_of_unrelated_texts_scores_few_rows(spark, monkeypatch, rounds):
    """Random words, of which the commonest are multiplied as matrices and the others added up: bounds leave few rows to score, in several blocks and rounds too."""
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 10 if rounds == 2 else 4096)
    monkeypatch.setattr(retrieval, "BLOCKS", 2, raising=False)
    monkeypatch.setattr(retrieval, "ROUND_ROWS", 100 if rounds == 2 else 50_000, raising=False)
    rng = random.Random(4)
    text = lambda k: " ".join(f"w{min(2999, int(rng.expovariate(1 / 400)))}" for _ in range(k))
    base = spark.createDataFrame([(i, text(rng.randint(5, 80))) for i in range(3000)], "base_id long, text string").repartition(4)
    asked = base.where("base_id % 100 = 0").withColumnRenamed("base_id", "query_id")
    got = retrieval.tfidf_search(asked, base).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(tuple(r) for r in retrieval.tfidf_top(asked, base).collect())
    assert len(got) == 120 and all(4 <= r.n_scored < 300 for r in got), sorted(r.n_scored for r in got)


def test_terms_end_at_combining_marks_as_in_sql(spark):
    texts = [(0, "cafe\u0301 au_lait 4x"), (1, "\u0130stanbul \u200dzwj\u200d \u0391\u03a3"), (2, "\u0939\u093f\u0928\u094d\u0926\u0940 \u2460\u00b2 ...word..."), (3, None), (4, "\u0301"), (5, "cafe 4x")]
    broken = spark.sql("SELECT 6L AS base_id, cast(X'4162FF63F09F' AS string) AS text")
    df = spark.createDataFrame(texts, "base_id long, text string").unionByName(broken)
    con = duckdb.connect()
    want = {i: con.execute(r"select list_sort(list_distinct(regexp_extract_all(?, '[\p{L}\p{N}_]+')))", [t]).fetchone()[0] or [] for i, t in df.selectExpr("base_id", "lower(text)").collect()}
    assert {r.base_id: sorted(set(r.t or [])) for r in df.select("base_id", retrieval.terms(F.col("text")).alias("t")).collect()} == want
    asked = df.withColumnRenamed("base_id", "query_id")
    got = sorted(tuple(r)[:4] for r in retrieval.tfidf_search(asked, df).collect())
    assert got == sorted(tuple(r) for r in retrieval.tfidf_top(asked, df).collect()) and [r[2] for r in got if r[0] == 5] == [5, 0]
