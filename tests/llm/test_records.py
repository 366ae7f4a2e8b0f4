import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from trafficjobs.llm import chat, decontaminate, pii, sharding, topk

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text.lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def leaks(docs, items):
    """Every window of item size, compared directly."""
    out = {}
    for d, text in docs:
        g = grams(text or "")
        for i, item in items:
            h = grams(item or "")
            if not g or not h:
                continue
            w, count = min(len(h), len(g)), Counter(h)
            if len(set(g) & set(h)) * 7 < 3 * (len(h) + w) and len(set(h)) == len(h):
                continue
            best = None
            for s in range(len(g) - w + 1):
                n = sum((Counter(g[s : s + w]) & count).values())
                total = len(h) + w - n
                if 4 * n >= 3 * total and (best is None or n / total > best[1] / best[2]):
                    best = (s, n, total)
            if best:
                out[d, i] = best
    return out


def test_decontamination_against_all_windows(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.start, r.common, r.total) for r in decontaminate.find(docs, items).collect()}
    assert got == leaks([tuple(r) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]) and got


def test_decontamination_edges(spark):
    item = " ".join(f"q{i}" for i in range(30))
    again = " ".join(["ha"] * 20 + [f"z{i}" for i in range(12)])
    docs = [(1, f"before {item.upper()} after", 0), (2, item.replace("q3 ", ""), 0), (3, None, 0), (4, "", 0), (5, " ".join(f"q{i}" for i in range(15)), 0), (6, f"x {again} y " * 3, 0), (7, "two words", 0), (8, "two words more", 0), (None, item, 0), (1, f"before {item.upper()} after", 0), (9, "lead " * 3000 + item, 0)]
    items = [(1, item), (2, again), (3, "Two words"), (4, None), (5, ""), (None, item), (6, item)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string, m int"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.common, r.total) for r in decontaminate.find(a, b).collect()}
    assert got == leaks([d[:2] for d in docs if d[0]], [i for i in items if i[0]]) and {k[0] for k in got} == {1, 2, 6, 7, 9}
    kept = decontaminate.clean(a, b)
    assert kept.columns == a.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 5, 8]
    assert decontaminate.find(a, b.limit(0)).count() == 0 and decontaminate.find(a.limit(0), b).count() == 0


def test_decontamination_of_long_repeats_and_odd_columns(spark):
    item = " ".join(f"q{i}" for i in range(40))
    docs = [(1, f"{item} " * 400, 7, "a"), (2, "lead " * 50_000 + item, 8, "b"), (3, "nothing here", 9, "c")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string, start int, `x.y` string"), spark.createDataFrame([(5, item, 1)], "item_id long, text string, start int")
    got = {(r.doc_id, r.item_id): (r.start, r.common, r.total) for r in decontaminate.find(a, b).collect()}
    assert got == {(1, 5): (0, 36, 36), (2, 5): (50_000, 36, 36)}
    kept = decontaminate.clean(a, b)
    assert kept.columns == a.columns and [r.start for r in kept.collect()] == [9]


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "\\", "\\\\<|", "<\\|", "<<SYS>> [[INST]", None, "", "é\n", "<s>", "$1 \\$2"]
    rows = [(k % 3, k, k, "message", ["user", "assistant", None][k % 3 if k % 2 else 1], t) for k, t in enumerate(nasty)]
    events = spark.createDataFrame(rows, "conv_id long, turn long, seq long, op string, role string, text string")
    for r in chat.read_back(chat.render(chat.fold(events))).collect():
        want = [(x[4] or "", x[5] or "") for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.turns] == want and r.loss_texts == [t for role, t in want if role == "assistant"]
        assert r.formatted.count("<|im_start|>") == len(want) and "</s>" not in r.formatted and "[INST]" not in r.formatted
    assert chat.summary(events.limit(0)).count() == 0


def test_chat_folds_events(spark):
    rows = [(1, 1, 5, "delta", None, "b"), (1, 1, 4, "delta", None, "a"), (1, 1, 1, "message", "assistant", "draft "), (1, 1, 3, "regenerate", None, None), (1, 0, 0, "message", "user", "hi"), (1, 2, 6, "delta", "user", "x"), (1, 2, 8, "edit", None, "y"), (1, 2, 9, "delta", None, "z"), (1, 3, 10, None, "user", "1"), (1, 3, 11, "message", "user", "2")]
    events = spark.createDataFrame(rows, "conv_id long, turn long, seq long, op string, role string, text string")
    got = [(r.turn, r.role, r.text) for r in chat.fold(events).orderBy("turn", "part").collect()]
    assert got == [(0, "user", "hi"), (1, "assistant", "ab"), (2, "user", "yz"), (3, "user", "1"), (3, "user", "2")]


def plain_fold(rows):
    """Events one by one in order of seq: a regeneration takes back what later turns hold so far."""
    turns = {}
    for conv, turn, seq, op, role, text in sorted(rows, key=lambda r: (r[0], r[2] if r[2] is not None else -(2**63), r[3] if r[3] in ("delta", "edit", "regenerate") else "message", r[4] or "", r[5] or "")):
        own = turns.setdefault((conv, turn), [])
        role, text = role or "", text or ""
        if op == "regenerate":
            for c, t in list(turns):
                if c == conv and t > turn:
                    turns[c, t] = []
        if op not in ("delta", "edit", "regenerate") or not own:
            own.append([role, "" if op == "regenerate" else text])
        else:
            own[-1] = [role or own[-1][0], own[-1][1] + text if op == "delta" else text if op == "edit" else ""]
    return sorted((c, t, k, *m) for (c, t), ms in turns.items() for k, m in enumerate(ms))


def test_regenerations_take_back_later_turns(spark):
    rows = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "one"), (1, 2, 2, "message", "user", "gone"), (1, 3, 3, "message", "assistant", "gone too"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "two"), (1, 2, 6, "message", "user", "stays")]
    rng = random.Random(8)
    for conv in range(2, 40):
        rows += [(conv, rng.randint(0, 4), k, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", None, "</s>"])) for k in range(rng.randint(1, 20))]
    events = spark.createDataFrame(rows, "conv_id long, turn long, seq long, op string, role string, text string")
    for log in (events, events.repartition(5).orderBy("text")):
        got = sorted(map(tuple, chat.fold(log).select("conv_id", "turn", "part", "role", "text").collect()))
        assert got == plain_fold(rows)
    assert [r[3:] for r in plain_fold(rows) if r[0] == 1] == [("user", "hi"), ("assistant", "two"), ("user", "stays")]


def test_the_tables_log_folds_to_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", "same"), (-1, 0, "user", "same"), (-1, 0, "assistant", None), (-1, None, None, "no turn"), (-1, 2**62, "user", "far"), (None, 1, "user", "no id"), (-2, 2**63 - 1, "user", "last")], table.schema)
    table = table.unionByName(odd)
    log = chat.as_log(table)
    ops = {r.op: r["count"] for r in log.groupBy("op").count().collect()}
    assert min(ops.get(k, 0) for k in ("message", "delta", "edit", "regenerate")) > 50
    key = lambda r: tuple((x is not None, x) for x in r)
    for events in (log, log.repartition(7).orderBy("text")):
        got = sorted((key((r.conv_id, r.turn, r.role, r.text)) for r in chat.fold(events).collect()))
        assert got == sorted(key((r.conv_id, r.turn, r.role or "", r.text or "")) for r in table.collect())


def plain_differencing(sizes, shards):
    """Karmarkar-Karp by plain lists: sums of the shards only."""
    parts = [sorted([n] + [0] * (shards - 1)) for n in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return parts[0]


def test_differencing_equals_a_plain_version():
    rng = random.Random(4)
    for n, shards in ((1, 3), (7, 2), (60, 5), (200, 24)):
        sizes = [rng.randint(1, 10_000) * rng.choice([1, 1, 30]) for _ in range(n)]
        total, place = sharding.difference(np.array([[s] + [0] * (shards - 1) for s in sizes]))
        assert sum(total) == sum(sizes) and total.max() - total.min() <= 1.5 * (plain_differencing(sizes, shards)[-1] - plain_differencing(sizes, shards)[0]) + 8
        own = np.zeros(shards, dtype=int)
        for s, p in zip(sizes, place):
            own[p[0]] += s
        assert own.tolist() == list(total)


def test_sharding_with_clashing_columns_and_a_long_text(spark):
    docs = spark.createDataFrame([(1, "x" * 2_000_000, 9, "a"), (2, "y", 9, "b"), (2, "y", 9, "c")], "doc_id long, text string, size int, `shard.x` string")
    rows = sharding.shard(docs, 2).collect()
    assert sorted((r.doc_id, r["size"]) for r in rows) == [(1, 2_000_008), (2, 9), (2, 9)] and len({r.shard for r in rows if r.doc_id == 2}) == 1


def test_sharding_laws(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (-1, "", None, None, None)], docs.schema))
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    slots, of, bytes_ = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        of[r.text_crc32, r["size"]].add(r.shard)
        bytes_[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(24))
    assert all(len(v) == 1 for v in of.values())
    mean = sum(bytes_.values()) / 24
    assert max(bytes_.values()) - min(bytes_.values()) <= 16 < mean
    text = {(zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in docs.select("text").collect()}
    assert set(of) == text
    assert sharding.shard(docs.limit(0)).count() == 0


def test_differencing_over_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 8)
    groups = spark.createDataFrame([(str(i), (i * 37) % 101 + 1) for i in range(300)], "group string, bytes long")
    sums = Counter()
    for r in sharding.assign(groups, 4).join(groups, "group").collect():
        sums[r.shard] += r.bytes
    assert sum(sums.values()) == sum((i * 37) % 101 + 1 for i in range(300)) and max(sums.values()) - min(sums.values()) <= 3
    total, place = sharding.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert sorted(total) == [14, 16] and place.shape == (5, 2)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BASE_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype("float32").tolist(), 0) for i in range(400)]
    rows += [(400 + i, rows[50][1], 0) for i in range(60)] + [(900, None, 0), (950, [1.0] * 5 + [None], 0), (1000, [float("nan")] * 6, 0), (1050, [float("inf")] * 6, 0), (None, [0.5] * 6, 0), (1100, [], 0), (50, rows[50][1], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(vectors).collect()) == sorted(want)
    assert topk.top_k(vectors.limit(0)).count() == 0
    few = topk.top_k(vectors.where("vec_id in (0, 1, 2)")).collect()
    assert [r.rank for r in few] == [1, 2]


def test_top_k_reads_a_part_of_clustered_lists(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    rows = [(i, (centres[i % 8] + 0.15 * rng.normal(size=24)).astype("float32").tolist()) for i in range(3000)]
    monkeypatch.setattr(topk, "BASE_BLOCK", 1000)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shares = sorted(r.read_share for r in topk.read_shares(vectors).collect())
    assert len(shares) == 60 and shares[30] < 0.5 and shares[-1] <= 1
    whole = {i: np.floor(np.float64(np.array(v, dtype=np.float32)) * 256).astype(int) for i, v in rows}
    for q in (0, 50, 1450):
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        got = topk.top_k(vectors).where(f"query_id = {q}").orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in want]


def test_top_k_of_other_lengths_repeats_and_extra_columns(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [3.0, 3.0], 1), (100, [1.0, 1.0, 1.0], 1), (3, [0.5, 0.5, 0.5], 1), (3, [0.5, 0.5, 0.5], 2), (4, [9.0], 1), (2, [0.0, 1.0], 1), (150, [2.0], 7), (200, [7.0, 7.0, 7.0, 7.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in topk.top_k(vectors).collect())
    assert got == [(0, 1, 2, 256 * 256 * 9), (0, 2, 1, 256 * 256 * 3), (0, 3, 2, 256 * 256 * 2), (100, 1, 3, 256 * 128 * 3), (150, 1, 4, 256 * 256 * 18)]


def test_search_by_bounds_equals_all_products():
    rng = np.random.default_rng(9)
    for n, d, k in ((1, 3, 2), (40, 1, 3), (300, 7, 5), (300, 64, 1)):
        base, queries = rng.integers(-300, 300, size=(n, d)), rng.integers(-300, 300, size=(6, d))
        queries[0] = 0
        ids, query_ids = rng.permutation(n * 2)[:n], np.arange(6)
        found, read, resolved = topk.search(ids, base, query_ids, queries, k)
        for j in range(6):
            want = sorted((-int(base[i] @ queries[j]), int(ids[i])) for i in range(n) if ids[i] != query_ids[j])[:k]
            assert found[j] == [(i, -s) for s, i in want] and 0 <= read[j] + resolved[j] <= n * d
        floors = np.array([f[0][1] if f else -1e9 for f in found], dtype=float)
        again, _, _ = topk.search(ids, base, query_ids, queries, k, floors)
        assert all([x for x in a if x[1] >= fl] == [x for x in f if x[1] >= fl] for a, f, fl in zip(again, found, floors))


def test_search_adds_only_the_entries_that_it_counts(monkeypatch):
    added, plain = [], topk._added

    def counted(places, parts, n):
        added.append(places.size)
        return plain(places, parts, n)

    monkeypatch.setattr(topk, "_added", counted)
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, size=(8, 24))
    base = centres[np.arange(800) % 8] + rng.integers(-30, 30, size=(800, 24))
    for scale in (1, 2**40):  # floats, and whole numbers beyond them
        added.clear()
        found, read, resolved = topk.search(np.arange(800), base * scale, np.arange(16), base[:16], 5)
        assert sum(added) == read.sum() + resolved.sum() and (read + resolved < 800 * 24 * 0.6).all() and (resolved > 0).all()
        for j in range(16):
            want = sorted((-int(base[i] @ base[j]) * scale, i) for i in range(800) if i != j)[:5]
            assert found[j] == [(i, -s) for s, i in want]


def test_bounds_hold_the_scores_at_every_depth():
    rng = np.random.default_rng(6)
    base, queries = rng.integers(-300, 300, size=(200, 9)).astype(float), rng.integers(-300, 300, size=(5, 9)).astype(float)
    queries[0, :4] = 0
    signed, lists, score = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1), topk._Lists(base), np.zeros((5, 200))
    places = np.tile(np.arange(200), (5, 1))
    for depth in (1, 7, 90, 199, 200):
        new = lists.advance(depth)
        for q, row in enumerate(signed):
            used = np.flatnonzero(row)
            score[q] += topk._added(lists.places[used, new], lists.parts[used, new] * row[used][:, None], 200)
        upper = score + (signed * lists.parts[:, depth - 1]) @ lists.unread
        lower = lists.lower(places, queries, score)
        assert (lower <= queries @ base.T).all() and (queries @ base.T <= upper).all()
    assert (score == queries @ base.T).all()


def test_index_gives_every_print_within_the_radius(spark):
    rng = random.Random(8)
    pairs = []
    for k in range(300):
        fp, bits = rng.getrandbits(64), rng.sample(range(64), decontaminate.RADIUS if k % 2 else rng.randint(0, decontaminate.RADIUS))
        pairs.append((k, 7, fp, fp ^ sum(1 << b for b in bits)))
    # the most that may differ in each block: 4, 4, 4, 4 and 3 bits over, but one bit less in one of them
    tight, starts = [b for at, n in ((0, 5), (13, 5), (26, 5), (39, 5), (52, 3)) for b in range(at, at + n)], 300
    pairs.append((starts, 7, 0, sum(1 << b for b in tight)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, m, signed(a), signed(b)) for k, m, a, b in pairs], "item_key long, m int, fp long, print long")
    index = decontaminate.indexed(df.select("item_key", "m", "fp"))
    assert decontaminate.masks(spark).count() == 4671 and sum(bits for bits, _ in decontaminate.BLOCKS) == 64 and sum(within + 1 for _, within in decontaminate.BLOCKS) == decontaminate.RADIUS + 1
    probes = df.select(F.col("item_key").alias("probe"), F.posexplode(decontaminate.blocks_of(F.col("print"))).alias("block", "value"))
    met = index.join(probes, ["block", "value"]).where("probe = item_key").select("item_key").distinct().count()
    assert met == len(pairs)


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(11)
    parts = ["a", "@", ".", "b.c", "-", "+", "1", "23", "4539 1488 0343 6467", "4539148803436467", " ", "+1 (555) 123-4567", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "é", "x@y.z", "%_", "0001.2.3.4", "٣", "(", ")"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    texts += [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["1" * 50_000, "a" * 50_000 + "@", "+1" * 5000]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text[:200]


def test_disclosing_terms(spark):
    # "zorblax" only ever stands beside one address, "the" everywhere; copies of one text prove nothing
    docs = [(i, f"the {w} met zorblax at jo@ex.org in the {v} hall") for i, (w, v) in enumerate([("cat", "red"), ("dog", "big"), ("owl", "old"), ("fox", "dim")])]
    docs += [(10 + i, "the quiet copy of kilt@ex.org here") for i in range(20)] + [(100 + i, f"the plain row the mail m{i}@ex.org") for i in range(100)]
    docs += [(60, None), (61, ""), (62, "Zorblax alone")] + [(300 + i, f"met at in hall {i}") for i in range(10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.term for r in pii.disclosing_terms(frame).collect()} == {"zorblax"}
    rows = {r.doc_id: r for r in pii.summary(pii.find_spans(frame)).collect()}
    assert rows[62].spans == "term:0:7" and rows[60].spans == "" and rows[0].n_email == 1 and rows[0].n_term == 1
    assert rows[0].base_sha256 == hashlib.sha256(b"email:23:32").hexdigest() and rows[60].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean[0] == "the cat met [TERM] at [EMAIL] in the red hall" and clean[60] is None and clean[62] == "[TERM] alone"
    assert pii.find_spans(frame.limit(0)).count() == 0


def plain_kind_terms(texts):
    """Terms that disclose a kind, counted plainly over all texts."""
    near, whole, entities, words = Counter(), Counter(), defaultdict(set), 0
    for text in texts:
        terms = [t.lower() for t in re.findall(r"[^\W\d_]+", text)]
        whole.update(terms)
        words += len(terms)
        base = plain_spans(text)
        runs = [(m.start(), 5, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        spans = base + [r for r in runs if not any(a < r[2] and r[0] < b for a, _, b in base)]
        places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        seen = set()
        for start, kind, end in spans:
            before, after = [i for i, p in enumerate(places) if p[0] < start], [i for i, p in enumerate(places) if p[1] > end]
            for i in before[-4:] + after[:4]:
                a, b = places[i]
                part = text[a : min(b, start)] if i in before[-4:] and a < start else text[max(a, end) : b]
                own = [t.lower() for t in re.findall(r"[^\W\d_]+", part)]
                full = {t.lower() for t in re.findall(r"[^\W\d_]+", text[a:b])}
                own = [t for t in own if t in full]
                for t in own:
                    entities[kind, t].add(text[start:end].lower())
                if (kind, i) not in seen:
                    seen.add((kind, i))
                    near.update((kind, t) for t in own)
    share = Counter()
    for (kind, _), n in near.items():
        share[kind] += n / words
    out = {}
    for (kind, t), es in entities.items():
        if len(es) >= pii.KIND_SUPPORT:
            p = (near[kind, t] + pii.SHRINK * share[kind]) / (whole[t] + pii.SHRINK)
            if p >= pii.CERTAINTY and np.log2(p / share[kind]) >= pii.BITS:
                out[t, pii.KINDS[kind]] = (len(es), whole[t], round(p, 9))
    return out


def test_kind_disclosure_over_the_table_equals_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {(r.term, r.entity): (r.joint, r.occurrences, round(r.certainty, 9)) for r in pii.disclosing_terms(docs).where("entity not like '%:%'").collect()}
    assert got == plain_kind_terms([r.text or "" for r in docs.collect()]) and got
    rows = pii.summary(pii.find_spans(docs)).agg({"n_term": "sum", "n_secret": "sum"}).first()
    assert rows[0] > 0 and rows[1] > 0
    # base spans stay as they are
    base = {r.doc_id: r.base_sha256 for r in pii.summary(pii.find_spans(docs)).collect()}
    for r in docs.collect():
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(r.text or ""))
        assert base[r.doc_id] == hashlib.sha256(spans.encode()).hexdigest()


def test_secrets_are_marked_beside_their_terms_only(spark, monkeypatch):
    docs = [(i, f"some words passkey={i:04d}abcdefabcdef{i:04d} and more", 1, 2) for i in range(12)] + [(50, "plain 00112233aabbccdd0011 run of letters", 3, 4), (51, "the passkey alone", 5, 6)]
    docs += [(100 + i, f"many other words here number {i} and some more to make the kind rare and so on " * 3, 7, 8) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, _terms int, `spans.x` int")
    for most in (200_000, 0):
        monkeypatch.setattr(pii, "MOST_TERMS", most)
        found = pii.find_spans(frame)
        assert found.columns == [*frame.columns, "spans"]
        rows = {r.doc_id: r for r in pii.summary(found).collect()}
        assert rows[3].spans == "term:11:18,secret:19:39" and rows[50].n_spans == 0 and rows[51].spans == "term:4:11"
        clean = pii.redact(frame)
        assert clean.columns == frame.columns and clean.where("doc_id = 3").first().text == "some words [TERM]=[SECRET] and more"


def test_terms_too_many_to_broadcast(spark, monkeypatch):
    docs = [(i, f"the {w} met zorblax at jo@ex.org {w}") for i, w in enumerate(["cat", "dog", "owl", "fox"])] + [(9, "Zorblax"), (10, None)] + [(100 + i, f"the plain row the mail m{i}@ex.org") for i in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((r.doc_id, str(r.spans)) for r in pii.find_spans(frame).collect())
    monkeypatch.setattr(pii, "MOST_TERMS", 0)
    assert sorted((r.doc_id, str(r.spans)) for r in pii.find_spans(frame).collect()) == want and "term" in str(want)


def test_copies_do_not_hide_a_disclosing_term(spark):
    # four contexts of one address; copies of a text, beside the address or not, must not lower the certainty
    docs = [(i, f"the {w} met zorblax at jo@ex.org in the {v} hall") for i, (w, v) in enumerate([("cat", "red"), ("dog", "big"), ("owl", "old"), ("fox", "dim")])]
    docs += [(10 + i, docs[0][1]) for i in range(50)] + [(80 + i, "Zorblax alone") for i in range(50)]
    docs += [(200 + i, f"the plain row the mail m{i}@ex.org") for i in range(100)] + [(400 + i, f"met at in hall {i}") for i in range(10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    (row,) = pii.disclosing_terms(frame).collect()
    assert (row.term, row.entity, row.joint, row.occurrences, row.certainty) == ("zorblax", "email:jo@ex.org", 4, 5, 0.8)
    assert pii.redact(frame).where("text like '%orblax%'").count() == 0


def test_terms_too_many_to_broadcast_are_cut_alike(spark, monkeypatch):
    # combining marks part words in Python and not in Java, numerals such as the superscript two the other way round
    for term in ("नमस्ते", "zorb²", "e\u0301lan", "İzmir"):
        docs = [(i, f"{w} {term} jo@ex.org") for i, w in enumerate(["cat", "dog", "owl", "fox"])] + [(9, term)] + [(100 + i, f"row m{i}@ex.org") for i in range(200)]
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        with monkeypatch.context() as m:
            want = sorted((r.doc_id, str(r.spans)) for r in pii.find_spans(frame).collect())
            m.setattr(pii, "MOST_TERMS", 0)
            assert sorted((r.doc_id, str(r.spans)) for r in pii.find_spans(frame).collect()) == want
        assert "term" in dict(want)[9], term
