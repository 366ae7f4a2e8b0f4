"""Exact top-k by inner product: no-random-access aggregation over sorted lists, block by block.

A block of base vectors has one list of (place, component) for each dimension, sorted by component. A query reads its lists
from the top where its own component is positive and from the bottom where it is negative, round by round to a greater
depth, and adds what it reads to a partial score for each vector. A component that has not been read is at most the list's
frontier, which gives an upper bound beside the partial score. The leading vectors get lower bounds: what is unread of them
is at least the list's other end, and at least minus the product of the unread norms. Once the k-th best lower bound, or
the k-th score that earlier blocks are known to give, leaves few vectors whose upper bound reaches it, the query stops. The
scores of these few are resolved by reading on: of the rest of its lists only their entries are added.

Queries come in batches that read to common depths, so that which entries are unread is kept once for all of them.
The first block of all gives each query a k-th score, with which it comes to the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.llm.common import in_arrow, materialize, small

K, SCALE, EVERY = 5, 256, 50
BASE_BLOCK, QUERY_BLOCK = 4096, 512
#: Shares of a list that are read by the end of each round.
DEPTHS = (0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 1.0)
#: Reading ends when at most this share of a block can still qualify.
FEW = 1 / 8


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    order = np.lexsort((ids, -scores))[:k]
    return [(int(i), int(s)) for i, s in zip(ids[order], scores[order])]


def _added(places: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
    """The sum of parts by place, whole numbers beyond floats too."""
    if parts.dtype != object:
        return np.bincount(places.ravel(), weights=parts.ravel(), minlength=n)
    out = np.zeros(n, dtype=object)
    np.add.at(out, places.ravel(), parts.ravel())
    return out


class _Lists:
    """The sorted lists of a block, each once from the top and once from the bottom, and which of their entries are unread."""

    def __init__(self, base: np.ndarray):
        order = np.argsort(base, axis=0, kind="stable").T
        sorted_ = np.take_along_axis(base.T, order, axis=1)
        self.places = np.ascontiguousarray(np.concatenate((order[:, ::-1], order)))
        self.parts = np.ascontiguousarray(np.concatenate((sorted_[:, ::-1], sorted_)))
        self.unread = np.ones((2 * base.shape[1], base.shape[0]))
        self.norms, self.squares = (base * base).sum(axis=1), np.zeros_like(base.T)
        self.depth = 0

    def advance(self, depth: int) -> slice:
        """Read all lists on to this depth; the new ranks."""
        new, d = slice(self.depth, depth), len(self.squares)
        np.put_along_axis(self.unread, self.places[:, new], 0, axis=1)
        for side in (slice(0, d), slice(d, 2 * d)):
            np.put_along_axis(self.squares, self.places[side, new], self.parts[side, new] ** 2, axis=1)
        self.depth = depth
        return new

    def lower(self, lead: np.ndarray, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Lower bounds of some places for each query from their partial scores and what its lists have left unread."""
        d = q.shape[1]
        side = np.where(q > 0, 0, d) + np.arange(d)
        open_ = self.unread.T[lead[:, :, None], side[:, None, :]]
        ends = (open_ @ (q * self.parts[side, -1])[:, :, None])[:, :, 0]
        asked = (open_ @ (q * q)[:, :, None])[:, :, 0].astype(np.float64)
        norms = self.norms[lead].astype(np.float64)
        seen = ((1 - open_) * self.squares.T[lead]).sum(axis=2).astype(np.float64)
        left = np.maximum(norms - seen, 0) + norms * 1e-12
        score = score.astype(np.float64)
        return np.maximum(score + ends.astype(np.float64), score - np.sqrt(left * asked) * (1 + 1e-9)) - np.abs(score) * 1e-12

    def resolve(self, rows: np.ndarray, q: np.ndarray, can: np.ndarray) -> tuple[np.ndarray, int]:
        """What the rest of a query's lists adds to the places can, and how many entries that takes."""
        n = self.places.shape[1]
        wanted = np.zeros(n, dtype=bool)
        wanted[can] = True
        hit = np.flatnonzero(wanted[self.places[rows, self.depth :]])
        of, at = np.divmod(hit, max(1, n - self.depth))
        at += self.depth
        return _added(self.places[rows[of], at], self.parts[rows[of], at] * q[of], n)[can], len(hit)


def search(ids: np.ndarray, base: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K, floors: np.ndarray | None = None) -> tuple[list[list[tuple[int, int]]], np.ndarray, np.ndarray]:
    """For each query the k best (id, score) of the block but itself, ties to the smaller id; the list entries it added up before it stopped, and those added to resolve scores.

    base and queries are integers. What scores less than a query's floor may be left out.
    """
    n, d = base.shape
    biggest = float(np.abs(base).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d
    kind = np.float64 if biggest < 2**52 else object  # whole numbers stay exact
    lists, queries = _Lists(base.astype(kind)), queries.astype(kind)
    signed = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1)
    used = [np.flatnonzero(row) for row in signed]
    score = np.zeros((len(queries), n), dtype=kind)
    bound = np.full(len(queries), -np.inf) if floors is None else floors.astype(np.float64)
    found: list = [None] * len(queries)
    read, resolved, leaders = np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64), min(n, 4 * k + 1)
    active = np.arange(len(queries))
    for share in DEPTHS:
        depth = min(n, max(1, int(np.ceil(share * n))))
        new = lists.advance(depth)
        for q in active.tolist():
            rows = used[q]
            score[q] += _added(lists.places[rows, new], lists.parts[rows, new] * signed[q, rows][:, None], n)
            read[q] += len(rows) * (new.stop - new.start)
        upper = score[active]
        if depth < n:
            upper = upper + (signed[active] * lists.parts[:, depth - 1]) @ lists.unread
            lead = np.argpartition(-upper, leaders - 1, axis=1)[:, :leaders]
            lower = lists.lower(lead, queries[active], np.take_along_axis(score[active], lead, axis=1))
            lower[ids[lead] == query_ids[active][:, None]] = -np.inf
            if leaders >= k:
                bound[active] = np.maximum(bound[active], np.partition(lower, leaders - k, axis=1)[:, leaders - k])
        still = []
        for j, q in enumerate(active.tolist()):
            can = np.flatnonzero(upper[j] >= bound[q])
            if depth < n and len(can) > max(4 * k, FEW * n):
                still.append(q)
                continue
            can = can[ids[can] != query_ids[q]]
            more, resolved[q] = lists.resolve(used[q], signed[q, used[q]], can)
            found[q] = _best(ids[can], score[q, can] + more, k)
        active = np.array(still, dtype=np.int64)
        if not len(active):
            break
    return found, read, resolved


def _searched(k: int):
    def matrix(column: pa.Array, n: int) -> np.ndarray:
        return column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1)
                ids, query_ids, floors = (row.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 2, 4))
                base, queries = matrix(row.column(1), len(ids)), matrix(row.column(3), len(query_ids))
                found, read, resolved = search(ids, base, query_ids, queries, k, floors)
                flat = [(q, i, s, None, None, None) for q, f in zip(query_ids.tolist(), found) for i, s in f]
                flat += [(q, None, None, r, m, base.size) for q, r, m in zip(query_ids.tolist(), read.tolist(), resolved.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], names=["query_id", "vec_id", "score", "read", "resolved", "of"])

    return run


def _blocks(rows: DataFrame, size: int, name: str, columns: list[str]) -> DataFrame:
    """w and rows of at most about size vectors of that length, numbered from 0; equal ids are dealt by their hash."""
    counts = materialize(rows.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")), "widths")
    dealt = rows.join(small(counts), "w").withColumn(name, F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    return dealt.groupBy("w", name, "blocks").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))


def _scored(vectors: DataFrame, k: int, every: int, scale: int) -> DataFrame:
    """query_id, vec_id, score of what may be among the best, and a row without vec_id for what each query read of each block."""
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    finite = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v"))
    rows = materialize(rows.distinct().withColumn("w", F.size("v")), "vectors")
    base = materialize(_blocks(rows, BASE_BLOCK, "base_block", ["vec_id", "v"]), "base-blocks")
    tasks = max(1, base.count())

    def against(asked: DataFrame, blocks: DataFrame, which) -> DataFrame:
        """Query rows with a floor against the blocks of their length of these numbers, the queries being sent to the blocks."""
        asked = _blocks(asked, QUERY_BLOCK, "query_block", ["vec_id", "v", "floor"]).withColumnRenamed("blocks", "_own")
        asked = asked.join(blocks.select("w", "blocks").distinct(), "w").withColumn("base_block", F.explode(which(F.col("blocks"))))
        left = blocks.select("w", "base_block", F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("base")).repartition(tasks, "w", "base_block")
        right = asked.select("w", "base_block", F.col("rows.vec_id").alias("query_ids"), F.col("rows.v").alias("queries"), F.col("rows.floor").alias("floors")).repartition(tasks, "w", "base_block")
        pairs = left.join(right, ["w", "base_block"]).select("ids", "base", "query_ids", "queries", "floors")
        return in_arrow(pairs, _searched(k), "query_id long, vec_id long, score long, read long, resolved long, of long")

    asked = rows.where(F.col("vec_id") % every == 0)
    none = F.lit(float("-inf"))
    first = materialize(against(asked.withColumn("floor", none), base.where("base_block = 0"), lambda n: F.array(F.lit(0))), "first")
    kth = first.where("vec_id is not null").groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k)
    kth = materialize(kth.select(F.col("query_id").alias("vec_id"), F.element_at("s", k).cast("double").alias("floor")), "floors")
    asked = asked.join(small(kth), "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    more = base.where("blocks > 1")
    return first.unionByName(against(asked, more, lambda n: F.sequence(F.lit(1), n - 1)))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows of vec_id divisible by every, against all other rows.

    Components become floor(scale * x). Vectors that are null, empty or hold a null or non-finite component take no part, nor
    does a null vec_id. Vectors meet those of their own length. Rows that repeat a vec_id and a vector count once; rows of
    one vec_id and several vectors are several candidates, and no candidates of each other. Ties go to the smaller vec_id.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = _scored(vectors, k, every, scale).where("vec_id is not null")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def read_shares(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, read_share, resolved_share: the shares of all list entries that each query added up before it stopped, and to resolve scores."""
    found = _scored(vectors, k, every, scale).where("vec_id is null")
    return found.groupBy("query_id").agg((F.sum("read") / F.sum("of")).alias("read_share"), (F.sum("resolved") / F.sum("of")).alias("resolved_share"))


#: DuckDB SQL of top_k() with its defaults.
TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id AND len(q.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
