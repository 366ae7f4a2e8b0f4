"""A written index of vectors by clusters, searched exactly: bounds from the triangle inequality tell which clusters need no reading.

A vector x of a cluster with centre c and radius r has q.x = q.c + q.(x - c) <= q.c + |q| r. A query reads its most promising
clusters first; the k-th score that they give leaves out every cluster whose bound is below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.operators.retrieval import _ranked
from trafficjobs.session import materialize, small

#: Centres are fitted on at most about so many rows; at most so many clusters; rows of a block that a task scores, and queries that it asks.
FIT_ROWS, MOST_CLUSTERS, BLOCK, ASKED = 20_000, 1024, 4096, 512
_FOUND = "query_id long, rank int, base_id long, score double"


def fit(base: DataFrame, clusters: int | None = None, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds over a bounded sample, chosen by the hash of base_id. Without a number about the root of the rows, MOST_CLUSTERS at most."""
    n = base.count()
    clusters = max(1, min(MOST_CLUSTERS, clusters or int(n**0.5)))
    part = F.pmod(F.xxhash64("base_id"), F.lit(1 << 20)) < int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 20)) + 1
    rows = base.where(part).select("vector").orderBy(F.xxhash64("base_id"), "base_id").limit(FIT_ROWS).collect()
    x = np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0].vector) if rows else 0)
    centres = x[:clusters].copy()
    for _ in range(rounds if len(x) else 0):
        near = _nearest(x, centres)[0]
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(axis=1))


def write(base: DataFrame, path: str, clusters: int | None = None) -> None:
    """Index rows (base_id long, vector) of one length at path: vectors in a folder for each cluster, and the centres with radius and number of rows. Every row is indexed."""
    centres = fit(base, clusters)
    held = base.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CLUSTERS rows

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near, far = _nearest(np.stack(frame["vector"].to_numpy()).astype(np.float64), held.value)
                yield frame.assign(far=far, cluster=near.astype(np.int32))

    placed = base.select(F.col("base_id").cast("long").alias("base_id"), F.col("vector").cast("array<double>").alias("vector")).mapInPandas(place, "base_id long, vector array<double>, far double, cluster int")
    placed.repartition("cluster", F.pmod(F.xxhash64("base_id"), F.lit(16))).write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors")
    sizes = base.sparkSession.read.schema("base_id long, vector array<double>, far double, cluster int").parquet(f"{path}/vectors").groupBy("cluster").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    named = base.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cluster int, centre array<double>")
    named.join(sizes, "cluster").write.mode("overwrite").parquet(f"{path}/centres")


def _scored(spark: SparkSession, path: str, asked: DataFrame, k: int, exclude_own: bool) -> DataFrame:
    """The best of each block for pairs (query_id, vector, cluster). Only folders of clusters that some query asks are read."""
    chosen = [r.cluster for r in asked.select("cluster").distinct().collect()]  # at most MOST_CLUSTERS
    base = spark.read.schema("base_id long, vector array<double>, far double, cluster int").parquet(f"{path}/vectors").where(F.col("cluster").isin(chosen))
    sizes = spark.read.schema("cluster int, n long").parquet(f"{path}/centres").select("cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = base.join(F.broadcast(sizes), "cluster").groupBy("cluster", F.pmod(F.xxhash64("base_id"), "blocks").alias("block")).agg(F.collect_list(F.struct("base_id", "vector")).alias("base"))
    groups = asked.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    parts = asked.join(small(materialize(groups, "asked")), "cluster").groupBy("cluster", F.pmod(F.xxhash64("query_id"), "parts").alias("part")).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = lambda rows, key: (np.array([r[key] for r in rows], dtype=np.int64), np.array([r["vector"] for r in rows], dtype=np.float64))
        for frame in frames:
            for one, many in zip(frame["asked"], frame["base"]):
                yield _ranked(*side(one, "query_id"), *side(many, "base_id"), k, exclude_own)

    return parts.join(blocks, "cluster").select("asked", "base").mapInPandas(run, _FOUND)


def search(spark: SparkSession, queries: DataFrame, path: str, k: int = 4, exclude_own: bool = False) -> DataFrame:
    """query_id, rank, base_id, score as top_similar gives them over the indexed rows, and n_clusters, how many clusters the query read.

    query_id must be distinct. A query of zeros finds nothing.
    """
    centres = spark.read.schema("cluster int, centre array<double>, radius double, n long").parquet(f"{path}/centres")
    rows = centres.collect()  # at most MOST_CLUSTERS
    ids, middle = np.array([r.cluster for r in rows], dtype=np.int32), np.array([r.centre for r in rows], dtype=np.float64)
    radius, count = np.array([r.radius for r in rows]), np.array([r.n for r in rows], dtype=np.int64)
    held = spark.sparkContext.broadcast((ids, middle, radius, count))

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each query its clusters and their bounds; first: those that together hold k rows besides its own."""
        ids, middle, radius, count = held.value
        for frame in frames:
            if not len(frame) or not len(ids):
                continue
            q = np.stack(frame["vector"].to_numpy()).astype(np.float64)
            upper = q @ middle.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius * (1 + 1e-9) + 1e-6  # scores are rounded
            for at in range(len(frame)):
                order = np.argsort(-upper[at])
                before = np.concatenate(([0], np.cumsum(count[order])[:-1]))
                yield pd.DataFrame({"query_id": frame["query_id"].iloc[at], "vector": [frame["vector"].iloc[at]] * len(ids), "cluster": ids[order], "upper": upper[at][order], "first": before < k + int(exclude_own)})

    pairs = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    pairs = materialize(pairs.mapInPandas(bounds, "query_id long, vector array<double>, cluster int, upper double, first boolean"), "bounds")
    found = materialize(_scored(spark, path, pairs.where("first"), k, exclude_own), "first")
    kth = found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).alias("floor"))
    rest = pairs.where("not first").join(small(materialize(kth, "floors")), "query_id", "left").where("floor is null or upper >= floor").drop("floor")
    rest = materialize(rest, "rest")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id")
    every = found.unionByName(_scored(spark, path, rest, k, exclude_own)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    read = pairs.where("first").select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_clusters"))
    return every.join(read, "query_id")
