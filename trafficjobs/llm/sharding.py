"""Sharding by Karmarkar-Karp differencing of indivisible groups, the rows of equal texts.

Groups are dealt to blocks by hash. In a block each group starts as a partial partition (its size, 0, ..., 0); again and
again the two partial partitions of largest spread are combined in opposite order. What a block gives is a partial
partition again, so blocks of blocks are combined in the same way until one is left; every level is a Spark job over groups
of at most BLOCK items, and a shard is read off by following the orders back.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.llm.common import materialize

SHARDS, BLOCK, OVERHEAD = 24, 4096, 8
#: Rows of a shard that are numbered together.
NUMBERED = 200_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (a row each). Returns the combined sums and, for each row, the part that each of its entries came to."""
    n, k = sums.shape
    nodes: list[tuple] = [(sums[i], None) for i in range(n)]
    heap = [(-int(s.max() - s.min()), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        up, down = np.argsort(-nodes[a][0], kind="stable"), np.argsort(nodes[b][0], kind="stable")
        both = nodes[a][0][up] + nodes[b][0][down]
        nodes.append((both, (a, np.argsort(up), b, np.argsort(down))))
        heapq.heappush(heap, (-int(both.max() - both.min()), len(nodes) - 1))
    place: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for node in range(len(nodes) - 1, n - 1, -1):
        at = place.pop(node)
        a, of_a, b, of_b = nodes[node][1]
        place[a], place[b] = at[of_a], at[of_b]
    return nodes[heap[0][1]][0], np.stack([place[i] for i in range(n)])


def _combine(shards: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item")
        sums = np.zeros((len(group), shards), dtype=np.int64)
        for i, s in enumerate(group["sums"]):
            sums[i, : len(s)] = s
        total, place = difference(sums)
        out = pd.DataFrame({"item": group["item"].to_numpy(), "block": group["block"].to_numpy(), "place": [p.astype(np.int32) for p in place]})
        out["sums"] = [total if i == 0 else None for i in range(len(out))]  # once for each block
        return out

    return run


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """group (string), shard for groups (group, bytes), which must be distinct. An empty table gives an empty result."""
    items = groups.select(F.col("group").alias("item"), F.array("bytes").alias("sums"))
    n, levels = groups.count(), []
    schema = "item string, block string, place array<int>, sums array<long>"
    while True:
        blocks = -(-n // BLOCK)
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))).cast("string"))
        done = materialize(dealt.groupBy("block").applyInPandas(_combine(shards), schema), "differenced")
        levels.append(done.select("item", "block", "place"))
        if blocks <= 1:
            break
        items, n = done.where("sums is not null").select(F.col("block").alias("item"), "sums"), blocks
    out = levels[0].select(F.col("item").alias("group"), "block", F.col("place")[0].alias("part"))
    for level in levels[1:]:
        level = level.select(F.col("item").alias("of"), F.col("block").alias("next"), "place")
        out = out.join(level, out.block == level.of).select("group", F.col("next").alias("block"), F.expr("place[part]").alias("part"))
    return out.select("group", F.col("part").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, by the law `bytes`.

    Rows of one text, null counting as empty, share a shard. Slots number the rows of a shard without gaps, in the order of
    hashed ranges and of doc_id in them. Repeated rows get slots of their own; a null doc_id sorts first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = text.cast("binary")
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("group"))
    rows = materialize(rows, "sized")
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    placed = materialize(rows.join(assign(groups, shards), "group"), "placed")
    ranges = max(8, -(-rows.count() // (shards * NUMBERED)))
    placed = placed.withColumn("range", F.pmod(F.xxhash64("doc_id", "group"), F.lit(ranges)))
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "group")) - 1
    out = placed.withColumn("at", at).join(before, ["shard", "range"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
