import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from trafficjobs.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, v int, rows int, windows int, no int"


def brute(rows):
    """The definition, on (vec_id, embedding, label) with distinct ids."""
    own = []
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for i, label, x in own:
        if i % 100:
            continue
        scored = [(-sum(map(int.__mul__, x, y)), j, k) for j, k, y in own if j != i and len(y) == len(x)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:10]
            out += [(i, p, n + 1, j, -ps, -s) for n, (s, j, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    return negatives.mine(negatives.mislabelled(negatives.usable(table)))


def test_equals_brute_force_with_ties_nulls_and_copies(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BASE_BLOCK", 40)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    rng = random.Random(3)
    copy = [rng.uniform(0, 1) for _ in range(6)]
    rows = [(i * rng.choice([1, 1, -1]) if i % 100 else i, copy if rng.random() < 0.4 else [rng.choice([-0.25, 0.0, 0.5, rng.uniform(-1, 1)]) for _ in range(6)], rng.randint(0, 3)) for i in range(0, 1200, 4)]
    rows += [(-300, [0.5] * 6, 1), (5, None, 1), (7, [0.5] * 6, None), (9, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1), (11, [float("nan")] + [0.0] * 5, 1), (13, [float("inf")] + [0.0] * 5, 1)]
    rows += [(None, [0.5] * 6, 1), (2000, [0.5, 0.25], 1), (2001, [0.5, 0.5], 1), (2003, [0.25, 0.25], 2), (2100, [], 1), (2101, [], 1), (2102, [], 2), (2200, [1.0] * 3, 4)]
    out = mined(spark, rows)
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute(rows) and any(r[1] == 2001 for r in got) and any(r[1] == 2102 for r in got) and out.columns[2] == "rank"
    assert mined(spark, []).count() == 0
    # repeated rows count once
    assert sorted(tuple(r) for r in mined(spark, rows + rows[:80]).collect()) == got


def test_differing_rows_of_one_id_as_in_sql(spark):
    rng = random.Random(9)
    rows = [(i // 2 if i < 60 else i * 50, [rng.uniform(0, 1) for _ in range(4)], rng.randint(0, 2), 1, 2, 3, 4) for i in range(200)]
    rows += [(100, [0.1, 0.2, 0.3, 0.4], 1, 1, 2, 3, 4), (100, [0.4, 0.2, 0.3, 0.4], 1, 1, 2, 3, 4), (100, [0.4, 0.2, 0.3, 0.4], 2, 1, 2, 3, 4)]
    table = spark.createDataFrame(rows, SCHEMA)
    embeddings = table.toArrow()  # noqa: F841  read by DuckDB
    want = sorted(duckdb.sql(negatives.MINE_SQL).fetchall())
    assert sorted(tuple(r) for r in negatives.mine(negatives.mislabelled(negatives.usable(table))).collect()) == want and want


def test_very_large_numbers_stay_exact(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i * 50, i % 2, [rng.randint(-(2**29), 2**29) for _ in range(3)]) for i in range(40)], "vec_id long, label long, v array<long>")
    data = [(r.vec_id, r.label, r.v) for r in rows.collect()]
    want = []
    for i, label, x in data:
        scored = [(-sum(map(int.__mul__, x, y)), j, k) for j, k, y in data if j != i]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:5] if i % 100 == 0 else []:
            want += [(i, p, n + 1, j, -ps, -s) for n, (s, j, _) in enumerate(sorted(s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:10])]
    assert sorted(tuple(r) for r in negatives.mine(rows).collect()) == sorted(want)


def test_keys_sort_as_their_parts():
    rng = random.Random(4)
    parts = [(rng.randint(-9, 9), rng.randint(0, 3), rng.randint(0, 1), rng.choice([-(2**40), -1, 0, 1, 2**62]), rng.randint(-9, 9)) for _ in range(500)]
    assert sorted(parts, key=lambda p: negatives.packed(*p)) == sorted(parts, key=lambda p: (p[0], p[1], p[2], -p[3], p[4]))
    assert [negatives.unpacked(negatives.packed(*p)) for p in parts] == parts


def test_blocks_send_few_pairs(spark):
    """An anchor sends at most its positives and what each window can use, however many rows a block has."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out = queries.op13_hard_negatives(spark, "/root/testdata/sf0.1")
    assert out.groupBy("anchor_id", "positive_id").agg(F.max("rank").alias("n"), F.count("*").alias("rows")).where("n <> rows or n > 10").count() == 0
    rows = negatives.usable(table).collect()
    side = {"id": np.array([r.vec_id for r in rows]), "label": np.array([r.label for r in rows]), "v": np.array([r.v for r in rows])}
    side = {k: v[np.argsort(side["id"])] for k, v in side.items()}
    few = {k: v[:20] for k, v in side.items()}
    scores, pairs = negatives.block_pairs(few, side, 5, 10, None, 30, 90)
    assert len(pairs) == 20 * 5
    windows = [[int(s) for s in scores[a, pairs[pairs[:, 0] == a, 1]]] for a in range(20)]
    assert len(negatives.block_pairs(few, side, 5, 10, windows, 30, 90)[1]) <= 20 * 5 * 10
