import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from trafficjobs.llm import prefix_trie, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn int, role string, text string, depth int, path string, base int"


def brute(rows):
    """The definition, for turns without ties."""
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [t[1:] for t in sorted(own)] for c, own in said.items()}
    paths = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = (*said.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h], *own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += node not in children
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -(10**9), len(m), len(children[node]) if node in children else 0, leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items()
    )


def built(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in prefix_trie.trie(prefix_trie.rebuilt(table)).collect())


def forest(seed):
    """Conversations with common starts, one very common conversation, very long ones, one of each odd kind."""
    rng = random.Random(seed)
    rows = []
    for c in range(-40, 900, rng.choice([1, 3])):
        if rng.random() < 0.35:
            turns = [("user", "the very common question"), ("assistant", "answer ü")]
        else:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "long text " * 30])) for _ in range(rng.choice([0, 1, 2, 3, 6, 14]))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(1001, None, None, None), (1001, 4, "user", None), (1001, 4, "user", None), (None, 1, "user", "no id"), (2004, 0, "user", "its base is absent")]
    rows += [(c, k, "user", f"deep {k}" if k < 280 else f"{c}") for c in (3000, 3005, 4001) for k in range(300)]
    return rows


def test_equals_brute_force_at_any_shard_size(spark, monkeypatch):
    rows = forest(1)
    want = brute(rows)
    assert built(spark, rows) == want
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 40)  # many shards: long common starts are in the skeleton
    assert built(spark, rows) == want
    assert built(spark, []) == []
    assert built(spark, [(5, 0, "user", "only"), (None, None, None, None)]) == brute([(5, 0, "user", "only")])


@pytest.mark.parametrize("depth", [1, 3])
def test_short_splitters_and_a_repeated_conversation(spark, monkeypatch, depth):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 30)
    monkeypatch.setattr(prefix_trie, "SPLIT_DEPTH", depth)
    rows = [(c, k, "user", f"turn {k}") for c in range(0, 3000, 5) for k in range(9)] + forest(2)[:600]
    rows = list({(c, k): (c, k, *r) for c, k, *r in rows}.values())
    assert built(spark, rows) == brute(rows)


def test_sql_on_odd_rows(spark):
    rows = forest(3) + [(1002, 4, "user", "tie one"), (1002, 4, "user", "tie two"), (1002, 4, "assistant", "tie")]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    conversations = table.toArrow()  # noqa: F841  read by DuckDB
    want = sorted((r[0], r[1], -(10**9) if r[2] is None else r[2], *r[3:]) for r in duckdb.sql(prefix_trie.TRIE_SQL).fetchall())
    assert built(spark, rows) == want


def test_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = queries.op12_prefix_trie(spark, SF)
    assert sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in got.collect()) == brute(rows)


def test_skeleton_holds_every_node_that_lies_in_two_shards():
    rng = random.Random(6)
    token = lambda k: bytes([k]) * prefix_trie.TOKEN
    paths = sorted({b"".join(token(rng.randint(0, 2)) for _ in range(rng.randint(0, 6))) for _ in range(400)})
    bounds = prefix_trie.splitters([(p, len(p) // 16 + 1) for p in paths if rng.random() < 0.5], 7)
    skeleton = prefix_trie.Skeleton(bounds)
    shards = defaultdict(set)
    for p in paths:
        for k in range(0, len(p) + 1, prefix_trie.TOKEN):
            shards[p[:k]].add(prefix_trie.bisect_right(bounds, p))

    def inside(path):
        at = 0
        for k in range(0, len(path), prefix_trie.TOKEN):
            at = skeleton.children[at].get(path[k : k + prefix_trie.TOKEN])
            if at is None:
                return False
        return True

    assert 3 <= len(bounds) <= 7 and all(inside(p) for p, s in shards.items() if len(s) > 1)
