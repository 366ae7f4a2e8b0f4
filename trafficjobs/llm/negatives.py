"""Hard-negative mining: a secondary-sort shuffle of scored pairs, read by an iterator that opens windows at the positives.

Anchors are a stated set of queries, scored against all rows block by block. A first pass leaves each anchor's positives, its
best rows of the same label. A second pass knows their scores and so the windows that negatives must fall in; of each block it
sends what can be among an anchor's first N in some window. A pair travels as one packed key (anchor, kind, descending score,
id) with its score. Rows are dealt by anchor and sorted by the key inside a partition, as repartitionAndSortWithinPartitions
does: an anchor's positives come first and open its windows, then negatives come in their order and are given out by every
window that they fall in. A task holds the open windows of one anchor, never its rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.llm.common import in_arrow, materialize, small

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative's score is from LEAST to MOST hundredths of the positive's.
LEAST, MOST = 30, 90
BASE_BLOCK, ANCHOR_BLOCK = 4096, 512
#: anchor id and number, kind (0 for a positive), score from high to low, id; big-endian, so that bytes sort as the numbers do.
KEY = struct.Struct(">QqBQQ")
_SIGN = 1 << 63
FOUND = "anchor_id long, anchor long, other long, score long"


def packed(anchor_id: int, anchor: int, kind: int, score: int, other: int) -> bytes:
    return KEY.pack(anchor_id + _SIGN, anchor, kind, _SIGN - 1 - score, other + _SIGN)


def unpacked(key: bytes) -> tuple[int, int, int, int, int]:
    anchor_id, anchor, kind, score, other = KEY.unpack(key)
    return anchor_id - _SIGN, anchor, kind, _SIGN - 1 - score, other - _SIGN


def first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest allowed scores of each row, ties to the earlier column."""
    n = scores.shape[1]
    masked = np.where(allowed, scores, -np.inf)
    if n > k:
        ordered = np.sort(masked, axis=1) if masked.dtype == object else np.partition(masked, n - k, axis=1)
        allowed = allowed & (masked >= ordered[:, n - k][:, None])
    row, column = np.nonzero(allowed)
    # nonzero goes row by row and column by column, so a stable sort keeps ties in place
    order = np.lexsort((np.arange(len(row)), -masked[row, column].astype(np.float64), row)) if masked.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -masked[row[i], column[i]], column[i])), dtype=np.int64)
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def block_pairs(anchors: dict, base: dict, positives: int, negatives: int, windows: list[list[int]] | None, least: int, most: int) -> list[tuple[int, int]]:
    """Places (anchor, base row) of the pairs of two blocks that can be in the result, and all scores. base is ordered by id.

    Without windows these are positives, else negatives: windows has the scores of each anchor's positives.
    """
    biggest = float(np.abs(base["v"]).max(initial=0)) * float(np.abs(anchors["v"]).max(initial=0)) * base["v"].shape[1]
    kind = np.float64 if biggest * 100 < 2**53 else object  # whole numbers stay exact
    scores = anchors["v"].astype(kind) @ base["v"].astype(kind).T
    same = anchors["label"][:, None] == base["label"]
    if windows is None:
        row, column = first(scores, same & (anchors["id"][:, None] != base["id"]), positives)
        return scores, np.stack((row, column), axis=1)
    found = []
    for k in range(max(map(len, windows), default=0)):
        open_ = np.array([len(w) > k for w in windows])
        score = np.array([w[k] if len(w) > k else 0 for w in windows], dtype=kind)[:, None]
        row, column = first(scores, ~same & open_[:, None] & (least * score <= 100 * scores) & (100 * scores <= most * score), negatives)
        found.append(np.stack((row, column), axis=1))
    return scores, np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _paired(positives: int, negatives: int, with_windows: bool, least: int, most: int):
    def side(row: pa.RecordBatch, at: int) -> dict:
        one = row.column(at).flatten()
        ids, labels, numbers = (one.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        vectors = one.field(3)
        width = len(vectors.flatten()) // max(1, len(ids))
        out = {"id": ids, "label": labels, "no": numbers, "v": vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)}
        return out | ({"windows": one.field(4).to_pylist()} if at == 1 and with_windows else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1)
                base, anchors = side(row, 0), side(row, 1)
                scores, pairs = block_pairs(anchors, base, positives, negatives, anchors.get("windows"), least, most)
                a, b = pairs.T
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchors["id"][a], anchors["no"][a], base["id"][b], scores[a, b].astype(np.int64))], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def _blocks(rows: DataFrame, size: int, name: str, columns: list[str]) -> DataFrame:
    """w, the number of a block, how many the width has, and rows: at most about size vectors of one width, in the order of ids."""
    counts = materialize(rows.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")), "widths")
    dealt = rows.join(small(counts), "w").withColumn(name, F.pmod(F.xxhash64("vec_id", "no"), "blocks").cast("int"))
    return dealt.groupBy("w", name, "blocks").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))


def _scored(base: DataFrame, anchors: DataFrame, tasks: int, *how) -> DataFrame:
    """FOUND for anchors against all blocks of their width, which are sent to."""
    columns = ["vec_id", "label", "no", "v", *(["windows"] if how[2] else [])]
    asked = _blocks(anchors, ANCHOR_BLOCK, "anchor_block", columns).select("w", "anchor_block", F.col("rows").alias("asked"))
    asked = asked.join(base.select("w", "blocks").distinct(), "w").withColumn("base_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    both = base.repartition(tasks, "w", "base_block").join(asked.repartition(tasks, "w", "base_block"), ["w", "base_block"])
    return in_arrow(both.select("rows", "asked"), _paired(*how), FOUND)


def _opened(negatives: int, least: int, most: int):
    """The streaming iterator over sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []  # windows: [positive id, its score, how many negatives it gave]
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                anchor_id, anchor, kind, score, other = unpacked(key)
                if (anchor_id, anchor) != now:
                    now, windows = (anchor_id, anchor), []
                if kind == 0:
                    windows.append([other, score, 0])
                    continue
                for window in windows:
                    positive, bound, given = window
                    if given < negatives and least * bound <= 100 * score <= most * bound:
                        window[2] = given + 1
                        out.append((anchor_id, positive, given + 1, other, bound, score))
            if out:
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def _keys(kinds: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kinds:
        rows = zip(*(batch.column(k).to_pylist() for k in range(5)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packed(a, n, kind, score, other) for a, n, other, score, kind in rows], pa.binary())], names=["anchor_id", "anchor", "key"])


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, v) of whole numbers v.

    Anchors are the rows whose vec_id is divisible by every; scores are inner products. Rows meet those of their own vector
    length. Rows equal in all three columns count once; rows that share a vec_id but differ are several candidates, and
    anchors of their own, but none of each other. Nulls must be gone. An anchor without positives, a positive without
    negatives in its window, and an empty table give no rows.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v")).distinct()
    # the number tells rows of one id apart
    rows = materialize(rows.withColumns({"w": F.size("v"), "no": F.shiftrightunsigned(F.xxhash64("label", "v"), 1)}), "vectors")
    base = materialize(_blocks(rows, BASE_BLOCK, "base_block", ["vec_id", "label", "no", "v"]).select("w", "base_block", "blocks", "rows"), "base-blocks")
    tasks, anchors = max(1, base.count()), rows.where(F.col("vec_id") % every == 0)

    best = Window.partitionBy("anchor_id", "anchor").orderBy(F.desc("score"), "other")
    near = _scored(base, anchors, tasks, positives, negatives, False, least, most)
    near = materialize(near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= positives).drop("_rank"), "positives")
    windows = near.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor").alias("no")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("windows"))
    far = _scored(base, anchors.join(small(materialize(windows, "windows")), ["vec_id", "no"]), tasks, positives, negatives, True, least, most)

    pairs = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1)))
    keys = in_arrow(pairs, _keys, "anchor_id long, anchor long, key binary")
    dealt = keys.repartition("anchor_id", "anchor").sortWithinPartitions("key").select("key")
    return in_arrow(dealt, _opened(negatives, least, most), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: the rows of a table (vec_id, label, embedding) that take part, with components floor(scale * x) as whole numbers.

    A null vec_id, label or vector, or any null or non-finite component, leaves a row out; an empty vector has no component and stays.
    """
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    finite = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select("vec_id", "label", numbers.alias("v"))


def mislabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """rows whose label is the next one where vec_id is divisible by every."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


#: DuckDB SQL of mine(mislabelled(usable(embeddings))).
MINE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.v AS av, a.label AS al, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, av, al ORDER BY score DESC, other) AS no FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.av, p.al, p.no ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.av = s.av AND p.al = s.al AND NOT s.same AND p.no <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
