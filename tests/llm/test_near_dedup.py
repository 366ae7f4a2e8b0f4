import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trafficjobs.llm import near_dedup
from trafficjobs.llm.common import strings
from trafficjobs.llm.near_dedup import components, keep_one, near_duplicates
from trafficjobs.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    sets = {}
    root, same = {}, defaultdict(list)
    for k, (i, t) in enumerate(rows):
        same[i].append(k)
        i = k
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    common = defaultdict(int)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for ks in same.values():
        for k in ks[1:]:
            if sets[k] and sets[ks[0]]:
                root[find(k)] = find(ks[0])
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(i, least.get(r, i))
    return {(i, len(sets[k]), least[find(k)], least[find(k)] == i) for k, (i, _) in enumerate(rows)}


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r) for r in near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(9, base, "x"), (3, base.upper(), "y"), (4, base + " tail", None), (5, None, "n"), (6, "", "e"), (7, " \t\n", "s"), (8, "One two", "t"), (2, "one  TWO", "t"), (1, "é à", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {tuple(r) for r in near_duplicates(docs).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])
    kept = keep_one(docs)
    assert kept.columns == ["doc_id", "text", "label"] and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 6, 7}
    assert near_duplicates(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, base), (1, base), (1, base)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.kept) for r in near_duplicates(nulls).collect()) == [(-1, True), (1, True), (1, True)]


def test_chain_of_copies(spark):
    # each text shares 90 % of its words with the next, the ends share nothing
    words = [f"v{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[6 * k : 6 * k + 100])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs).collect()} == {61}


@pytest.mark.parametrize("edges,want", [([], {}), ([(5, 4), (4, 3), (9, 8)], {5: 3, 4: 3, 3: 3, 9: 8, 8: 8}), ([(k, k + 1) for k in range(50)], {k: 0 for k in range(51)})])
def test_components(spark, edges, want):
    assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_rows_of_one_id_link_all_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, "alone here with some five words"), (1, a), (3, None)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and {r[2] for r in got if r[0] in (1, 2) or (r[0] == 3 and r[1])} == {1}


def test_random_rows_with_repeated_ids(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = []
    for _ in range(400):
        words = rng.choice(texts).split(" ")
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 3)}"
        rows.append((rng.randint(0, 300), " ".join(words)))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_strays_dealt_to_parts_are_still_met(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {tuple(r) for r in near_duplicates(docs).collect()}
    monkeypatch.setattr(near_dedup, "PAIRS", 1)
    assert {tuple(r) for r in near_duplicates(docs).collect()} == want == brute([tuple(r) for r in docs.collect()])


def test_equal_sets_have_equal_prints_wherever_they_stand():
    texts = ["one two three four five six seven", "x y z", "lorem " * 40 + "ipsum dolor sit amet"] * 3
    found = []
    for order in (texts, texts[::-1], texts[4:] + texts[:4]):
        raw, offsets = strings(pa.array(order))
        s1, s2 = near_dedup.prints(*shingle_sets(raw, offsets))
        found.append({(t, int(a), int(b)) for t, a, b in zip(order, s1, s2)})
    assert found[0] == found[1] == found[2] and len(found[0]) == 3
    hashes = np.array([2**63 + 1], dtype=np.uint64)
    assert near_dedup.prints(hashes, np.array([0, 1]))[0].dtype == np.int64


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, "x"), (2, "a b c d e f", 3, 4, "y"), (3, None, 5, 6, "z")], "doc_id long, text string, `a.b` int, kept int, s1 string")
    out = keep_one(docs)
    assert out.columns == docs.columns and sorted(r.kept for r in out.collect()) == [2, 6]


def test_copies_that_no_centre_joins_are_linked_by_pairs(spark):
    """Near copies of one text that are no near copies of each other: where the text is not the centre, none has a link before the pairs."""
    rng, words, rows = random.Random(11), [f"w{k}" for k in range(150)], []
    for c in range(60):
        copy = list(words)
        for at in rng.sample(range(5, 145, 6), 4):
            copy[at] = f"c{c}x{at}"
        rows.append((c + 1, " ".join(copy)))
    rows.append((100, " ".join(words)))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and {r[2] for r in got} == {1}
