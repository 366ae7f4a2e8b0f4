import random
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trafficjobs.llm import packing, queries

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>x", " ", "  ", "\n", "\x1c", "\x85", " ", "The", "it's", "'LL", "İ", "ΑΣ", "ς", "é", "é", "́", "Ж", "Å", "漢字", "12", "½", "...", "😀", "ŉ", "ſ", "ß", "ẞ", " ", "ℌ", "a"]


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 400))) for _ in range(n)] + ["", " ", "a" * 3000, "漢" * 2000, "a b " * 9000]


def plain_best_fit(lengths, size):
    """Piece by piece, by the definition: how full the bins are in the end. It does not hang on which of two bins of equal room is taken."""
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect_left(rooms, (n, -1))
        room, own = rooms.pop(k) if k < len(rooms) else (size, bins)
        bins = max(bins, own + 1)
        insort(rooms, (room - n, own))
    return sorted(size - room for room, _ in rooms)


def test_plan_equals_best_fit_piece_by_piece():
    rng = random.Random(5)
    for size in (1, 7, 10, 64, 100):
        for _ in range(60):
            lengths = [rng.choice([rng.randint(1, size), min(size, 3), size // 3 + 1]) for _ in range(rng.randint(0, 200))]
            runs, bins = packing.plan(Counter(lengths), size)
            by_length = defaultdict(list)
            for length, done, each, first, offset in runs.tolist():
                by_length[length].append((done, each, first, offset))
            content = defaultdict(list)
            for length, own in by_length.items():
                own.sort()
                for no in range(lengths.count(length)):
                    done, each, first, offset = next(r for r in reversed(own) if r[0] <= no)
                    content[first + (no - done) // each].append((offset + (no - done) % each * length, length))
            for inside in content.values():
                inside.sort()
                assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:])) and sum(inside[-1]) <= size
            filled = sorted(sum(n for _, n in c) for c in content.values())
            assert filled == plain_best_fit(lengths, size) and bins == len(filled)


def test_plan_is_small_for_any_corpus():
    rng = random.Random(2)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 4097)}
    runs, bins = packing.plan(counts)
    assert len(runs) < 4 * 4096 and bins * 4096 < 1.01 * sum(k * n for k, n in counts.items())


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_the_library(monkeypatch):
    texts = fuzz(150, 1) + ["b" * 700 + " " + "Cé" * 900 + "\n"]
    want = [struct.pack(f"<{len(i)}I", *i) for i in library_ids(texts)]
    assert packing.Words(PATH).encode([t.encode() for t in texts]) == want
    monkeypatch.setattr(packing, "PART", 100)
    monkeypatch.setattr(packing, "CACHE", 5)
    few = packing.Words(PATH)
    assert few.by_word and [few.encode_long(t.encode()) for t in texts] == want
    byte_level = packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not byte_level.by_word and byte_level.encode([b"two  words"]) == [struct.pack("<3I", *Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("two  words").ids)]


def held(rows, size=packing.SIZE):
    """Sequences have no gaps and no more than size; how full they are."""
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for inside in at.values():
        inside.sort()
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:])) and sum(inside[-1]) <= size
    return sorted(sum(n for _, n in v) for v in at.values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op11_packing(spark, SF).collect()
    want = {}
    for d, ids in zip(docs, library_ids([d.text for d in docs])):
        ids = [*ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[d.doc_id, k // 4096] = (k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert held(rows) == plain_best_fit([n for _, n, _ in want.values()], 4096)


def test_odd_rows_and_sequences(spark):
    long = "word " * 30_000 + "end"
    rows = [(1, None), (1, None), (2, ""), (None, "no id"), (3, long), (3, long), (4, "tie a"), (5, "tie b")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, offset int, `length` int")
    cut = packing.pieces(docs, PATH)
    assert cut.where("doc_id = 1").select("length", "start").collect() == [(1, 0), (1, 0)]
    packed = packing.pack(cut.withColumn("bucket", F.lit(1)).withColumn("Number", F.lit(2))).cache()
    assert packed.columns == [*cut.columns, "bucket", "Number", "sequence_id", "offset"] and packed.count() == cut.count()
    held(packed.collect())
    ids = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert bytes(ids[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and r.offset in ids[r.sequence_id].starts
    assert packing.n_sequences_at_least(packed).first().least <= len(ids)
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0
    assert packing.n_sequences_at_least(cut.limit(0)).first().least == 0
