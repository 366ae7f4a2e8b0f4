"""The prefix trie of conversations by a splitter skeleton.

A conversation is a path of turns, a turn being 16 bytes of the SHA-256 of its role and text; so paths are byte strings whose
order is that of the trie's depth-first walk, and a node's members are neighbours. Equal paths are one row with a count.
Splitters cut the order into shards. A node whose members lie in two shards is a prefix of the splitter between them, so the
trie of the splitters, the skeleton, holds every such node; it is small and goes to all tasks. A task reads its sorted shard
once, finishes all nodes outside the skeleton on a stack, and gives partial sums for those inside. These are reduced by node
and then summed from the leaves of the skeleton to its root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficjobs.llm.common import in_arrow, materialize

TOKEN, HEADS = 16, 9
#: Turns of a shard, shards at most, paths looked at for each splitter, and turns of a splitter at most: the skeleton has no
#: more than MOST_SHARDS * SPLIT_DEPTH nodes and a root, the sample no more than about MOST_SHARDS * SAMPLED paths.
SHARD_TURNS, MOST_SHARDS, SAMPLED, SPLIT_DEPTH = 200_000, 8192, 16, 64
#: Neighbouring conversation ids are joined into one text, as many as a power of two.
JOINED = 12
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_LOCAL = f"{NODES}, parent_node int, node int, size long"


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its five."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path, sizes: the turns of each rebuilt conversation, 16 bytes each, and the UTF-8 bytes of their texts.

    The first turns come from conversation c - c % 5, the remainder having the sign of c, where it is there. Turns are ordered
    by turn, null first, rows of one turn by the digest of role and text; null roles and texts are empty, and a null conv_id is
    left out. A conversation is one row here, of 20 bytes for each turn whatever its text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, TOKEN)
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.hex(mark).alias("mark"), F.octet_length(text).alias("size")).alias("t"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    # the five of a base meet in one partition, where the join finds them
    own = said.withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = own.where("conv_id = base").select("base", F.slice("own", 1, HEADS - 1).alias("head"))
    h, none = head_length(F.col("conv_id")), F.array().cast(own.schema["own"].dataType)
    head, tail = F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.size("own"))
    turns = own.join(first, "base", "left").select("conv_id", F.concat(head, tail).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join("turns.mark", "")).alias("path"), F.col("turns.size").alias("sizes"))


def _ends(paths: DataFrame) -> DataFrame:
    """key, ends_sha256 of conversations (key, conv_id). Ids are joined by blocks first; a task then reads a key's blocks in order and holds none."""
    blocks = paths.groupBy("key", F.shiftright("conv_id", JOINED).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, sums = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if digest:
                        keys.append(now)
                        sums.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], names=["key", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return in_arrow(blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids"), run, "key binary, ends_sha256 string")


def _common(a: bytes, b: bytes) -> int:
    """How many turns two paths share from the start."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k : k + TOKEN] == b[k : k + TOKEN]:
        k += TOKEN
    return k // TOKEN


def splitters(sample: Iterable[tuple[bytes, int]], shards: int) -> list[bytes]:
    """Paths that part weighted sample paths into about so many shards: of two neighbours the shortest prefix of the later one that the earlier one lacks."""
    ordered = sorted(sample)
    total, met, found = sum(w for _, w in ordered), 0, []
    for (before, weight), (after, _) in zip(ordered, ordered[1:]):
        met += weight
        if met * shards >= total * (len(found) + 1) and before != after:
            found.append(after[: TOKEN * (_common(before, after) + 1)])
            while met * shards >= total * (len(found) + 1) and len(found) < shards:
                found.append(found[-1])  # a heavy path takes the place of several shards
    return sorted(set(found))


class Skeleton:
    """The trie of some paths. Node 0 is the root, children have higher numbers than their parents."""

    def __init__(self, paths: Iterable[bytes]):
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth = [-1], [0]
        for path in paths:
            at = 0
            for k in range(0, len(path), TOKEN):
                at = self.children[at].get(path[k : k + TOKEN]) or self._add(at, path[k : k + TOKEN])

    def _add(self, parent: int, token: bytes) -> int:
        self.children[parent][token] = len(self.parent)
        self.children.append({})
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def finished(self, partial: dict[int, tuple]) -> list[tuple]:
        """Rows of NODES and the node number, from partial (least, n, children, leaves, saved, ends, size) of each node met."""
        sums = [[None, 0, 0, 0, 0, EMPTY, 0] for _ in self.parent]
        for node, (least, n, children, leaves, saved, ends, size) in partial.items():
            sums[node] = [least, n, children, leaves, saved, ends or EMPTY, size]
        for node in range(len(sums) - 1, -1, -1):
            s = sums[node]
            s[3] = s[3] or 1
            s[4] += max(0, s[1] - 1) * s[6]
            if node and s[1]:
                up = sums[self.parent[node]]
                up[0] = s[0] if up[0] is None else min(up[0], s[0])
                up[1], up[2], up[3], up[4] = up[1] + s[1], up[2] + 1, up[3] + s[3], up[4] + s[4]
        return [(s[0], self.depth[k], sums[self.parent[k]][0] if k else None, *s[1:6], k) for k, s in enumerate(sums) if s[1]]


class _Open:
    """A node on the stack; held are finished children that wait for its smallest member."""

    __slots__ = ("node", "size", "least", "n", "children", "leaves", "saved", "ends", "held")

    def __init__(self, node: int | None, size: int):
        self.node, self.size, self.least, self.n, self.children, self.leaves, self.saved, self.ends, self.held = node, size, None, 0, 0, 0, 0, None, []

    def meet(self, least: int, n: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n += n


def walk(rows: Iterable[tuple], skeleton: Skeleton) -> Iterator[tuple]:
    """Rows of _LOCAL for distinct paths in order, each (path, sizes, n, least, ends): finished nodes outside the skeleton, partial sums of those inside."""
    stack, now = [_Open(0, 0)], b""

    def close() -> Iterator[tuple]:
        depth, own = len(stack) - 1, stack.pop()
        if own.node is not None:  # also where all its members are below other nodes of the skeleton, for its size
            yield own.least, depth, None, own.n, own.children, own.leaves, own.saved, own.ends, None, own.node, own.size
            return
        for child in own.held:
            yield (*child[:2], own.least, *child[2:], None, None, None)
        up, leaves, saved = stack[-1], own.leaves or 1, own.saved + (own.n - 1) * own.size
        up.meet(own.least, own.n)
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        done = (own.least, depth, own.n, own.children, leaves, saved, own.ends or EMPTY)
        if up.node is None:
            up.held.append(done)
        else:
            yield (*done[:2], None, *done[2:], up.node, None, None)

    for path, sizes, n, least, ends in rows:
        shared = _common(now, path)
        while len(stack) - 1 > shared:
            yield from close()
        for k in range(shared, len(path) // TOKEN):
            inside = stack[-1].node
            stack.append(_Open(None if inside is None else skeleton.children[inside].get(path[TOKEN * k : TOKEN * (k + 1)]), sizes[k]))
        stack[-1].meet(least, n)
        stack[-1].ends, now = ends, path
    while stack:
        yield from close()


def _walked(skeleton: Skeleton):
    names = [f.split()[0] for f in _LOCAL.split(", ")]
    kinds = [{"int": pa.int32(), "string": pa.string()}.get(f.split()[1], pa.int64()) for f in _LOCAL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in walk((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), skeleton):
            out.append(row)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _dealt(bounds: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect_right(bounds, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=[*batch.schema.names, "shard"])

    return run


def trie(paths: DataFrame) -> DataFrame:
    """Rows of NODES for conversations (conv_id, path, sizes) with distinct ids: a row for each distinct prefix of a path, the empty one included.

    conv_id is the smallest member, saved_tokens and n_leaves count the node's subtree, ends_sha256 is over the ids whose path
    ends there. Conversations with equal paths meet as counts; an empty table gives an empty result. A shard's nodes are held
    only while their parent is open and outside the skeleton.
    """
    spark = paths.sparkSession
    paths = materialize(paths.withColumn("key", F.substring(F.unhex(F.sha2("path", 256)), 1, TOKEN)), "paths")
    met = paths.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"))
    met = materialize(met.join(_ends(paths.select("key", "conv_id")), "key").select("path", "sizes", "n", "least", "ends_sha256"), "distinct-paths")

    total = met.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("sizes")), F.lit(0)).alias("turns")).first()
    shards = max(8, min(MOST_SHARDS, -(-total.turns // SHARD_TURNS)))
    share = min(1.0, shards * SAMPLED / max(1, total.rows))
    chosen = met.where(F.pmod(F.xxhash64("path"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = [(bytes(r.p), r.w) for r in chosen.select(F.substring("path", 1, TOKEN * SPLIT_DEPTH).alias("p"), (F.size("sizes") + 1).alias("w")).collect()]
    bounds = splitters(sample, shards)
    skeleton = Skeleton(bounds)

    dealt = in_arrow(met, _dealt(bounds), "path binary, sizes array<int>, n long, least long, ends_sha256 string, shard int")
    dealt = dealt.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("path").drop("shard")
    local = materialize(in_arrow(dealt, _walked(skeleton), _LOCAL), "nodes")

    sums = local.where("node is not null").groupBy("node").agg(
        F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("ends_sha256"), F.max("size")
    )
    top = skeleton.finished({r[0]: tuple(r[1:]) for r in sums.collect()})  # one row for each node of the skeleton
    top = spark.createDataFrame(top, f"{NODES}, node int")
    ids = top.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above"))
    rest = local.where("node is null").join(F.broadcast(ids), "parent_node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    names = [f.split()[0] for f in NODES.split(", ")]
    return top.select(*names).unionByName(rest.select(*names))


#: DuckDB SQL of trie(rebuilt(conversations)); c32 is the CRC of a text of ASCII characters, bit by bit.
TRIE_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS size, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS mark FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS k FROM t),
bits AS (SELECT c, flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(c AS VARCHAR), '')]) AS steps FROM (SELECT DISTINCT conv_id AS c FROM t)),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, [CAST(x AS BIGINT) FOR x IN steps]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h FROM bits),
r AS (
  SELECT h.c, o.k, o.mark, o.size FROM h JOIN o ON o.conv_id = h.c - h.c % 5 AND o.k <= h.h
  UNION ALL SELECT h.c, o.k + 1000000, o.mark, o.size FROM h JOIN o ON o.conv_id = h.c AND o.k > h.h),
d AS (SELECT c, row_number() OVER w AS d, size, md5(string_agg(mark, '') OVER w) AS p FROM r WINDOW w AS (PARTITION BY c ORDER BY k)),
p AS (SELECT c, d, size, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), 'root') AS up FROM d UNION ALL SELECT c, 0, 0, 'root', NULL FROM h),
last AS (SELECT c, max(d) AS deep FROM p GROUP BY c),
n AS (
  SELECT p.p, min(p.c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
    coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (d = deep), '') AS ends
  FROM p JOIN last ON last.c = p.c GROUP BY p.p),
k AS (SELECT up, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT p.p, sum(n.own) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM n LEFT JOIN k ON k.up = n.p JOIN p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.p)
SELECT n.conv_id, CAST(n.depth AS INTEGER) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN a ON a.p = n.p LEFT JOIN k ON k.up = n.p LEFT JOIN n u ON u.p = n.up
"""
