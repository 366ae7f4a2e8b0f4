import hashlib
import random
import struct

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trafficjobs.llm import bpe, queries, token_counts

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["<|endoftext|>", " ", "  ", "\n", "\n\n", "\t", "a", "the", "é", " ", "　", "漢字", "'s", "'ll", "12", "...", "<|endo", "ftext|>", "\x1c", "😀", "\r\n", " x"]


def fuzz(n, seed, most=1500):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", "a" * 5000, "漢" * 4000, " " * 3000, "\n a" * 2000]


def test_encode_and_decode_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(fuzz(40, 1))] + [(99, None, None), (99, None, None)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_whole_table_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).select("text", "decoded", bpe.n_tokens().alias("n"), F.sha2("ids", 256).alias("h")).collect()
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        assert r.n == len(e.ids) and r.h == hashlib.sha256(struct.pack(f"<{len(e.ids)}I", *e.ids)).hexdigest() and r.decoded == (r.text or "")


def apply(text, edits):
    for start, length, new in edits:
        start = min(max(start or 0, 0), len(text))
        text = text[:start] + (new or "") + text[start + max(length or 0, 0) :]
    return text


def test_edited_counts_equal_whole_counts(spark):
    rng, library = random.Random(7), Tokenizer.from_file(PATH)
    rows = []
    for i, t in enumerate(fuzz(30, 2, 800)):
        rows.append((i, t, [(rng.randint(-5, len(t) + 20), rng.choice([0, 0, 3, 50, 2000]), rng.choice(["", "new ", " x", "\n", "<|endo", "ftext|>", "word " * 500])) for _ in range(6)]))
    rows += [(97, None, [(0, 0, "abc"), (None, None, None)]), (98, "some text", None), (99, "", [])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: (r.n_before, r.n_after, r.n_chars_after) for r in token_counts.count_tokens(docs, PATH).collect()}
    want = {}
    for i, t, e in rows:
        after = apply(t or "", e or [])
        want[i] = (size(t or ""), size(after), len(after))
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_derived_edits_over_the_table(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("edits", token_counts.derived_edits())
    logs = {r.doc_id: apply(r.text or "", [tuple(e) for e in r.edits]) for r in docs.collect()}
    rows = token_counts.count_tokens(docs, PATH).collect()
    sizes = dict(zip(logs, (len(e.ids) for e in library.encode_batch(list(logs.values()), add_special_tokens=False))))
    assert {r.doc_id: r.n_after for r in rows} == sizes
    # three edits of at most 40 characters touch two leaves and one beside them each
    assert all(r.n_reencoded <= 3 * min(r.n_chars_after + 150, 3 * (token_counts.LEAF + 50)) for r in rows) and max(r.n_chars_after for r in rows) > 20_000


def test_kept_trees_take_later_edits_without_encoding_the_text(spark):
    library, rng = Tokenizer.from_file(PATH), random.Random(3)
    texts = ["plain words here " * 2000, "漢字の文。" * 3000, "ab。 " * 2000, "", None, "<|endoftext|> x" * 300]
    log = lambda n: [(rng.randint(0, n), rng.choice([0, 5]), rng.choice(["", "new。", " y", "é"])) for _ in range(4)]
    rows = [(i, t, log(len(t or "")), "kept", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}, _leaf_chars string, n_after int")
    first = {r.doc_id: r for r in token_counts.count_tokens(docs, PATH, keep=True).collect()}
    now = {i: apply(t or "", e) for i, t, e, _, _ in rows}
    assert {i: r.text for i, r in first.items()} == now and first[0]._leaf_chars == "kept"
    later = spark.createDataFrame([(i, r.text, r.leaf_chars, r.leaf_tokens, log(len(r.text))) for i, r in first.items()], f"doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, edits {token_counts.EDITS}")
    logs = {r.doc_id: [tuple(e) for e in r.edits] for r in later.collect()}
    for r in token_counts.count_tokens(later, PATH, keep=True).collect():
        text = apply(now[r.doc_id], logs[r.doc_id])
        assert r.text == text and r.n_after == len(library.encode(text, add_special_tokens=False).ids) and sum(r.leaf_tokens) == r.n_after
        assert r.n_before == first[r.doc_id].n_after and r.n_reencoded <= 4 * 3 * (token_counts.LEAF + 50)
    # counts that are handed in are used as they are, which shows that nothing else is encoded
    odd = later.where("doc_id = 0").selectExpr("doc_id", "text", "leaf_chars", "transform(leaf_tokens, x -> 1000) leaf_tokens", "edits")
    (r,) = token_counts.count_tokens(odd, PATH).collect()
    assert r.n_before == 1000 * len(first[0].leaf_chars)


def test_query_applies_a_second_log_to_the_kept_trees(spark):
    library = Tokenizer.from_file(PATH)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    first = {r.doc_id: apply(r.text or "", [tuple(e) for e in r.edits]) for r in docs.withColumn("edits", token_counts.derived_edits()).collect()}
    edited = spark.createDataFrame(list(first.items()), docs.schema).withColumn("edits", token_counts.derived_edits(first=3))
    later = {r.doc_id: apply(r.text, [tuple(e) for e in r.edits]) for r in edited.collect()}
    rows = queries.op3_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_after, r.n_chars_after) for r in rows} == {i: (size(t), len(t)) for i, t in first.items()}
    assert {r.doc_id: (r.later_n_after, r.later_n_chars_after) for r in rows} == {i: (size(t), len(t)) for i, t in later.items()}
    assert all(r.later_n_reencoded <= 3 * min(r.later_n_chars_after + 150, 3 * (token_counts.LEAF + 50)) for r in rows) and later != first


def test_edit_log_join(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, None)], "doc_id long, text string")
    log = spark.createDataFrame([(1, 2, 0, 1, "X"), (1, 1, 3, 0, "-")], "doc_id long, seq long, start long, length long, text string")
    rows = {r.doc_id: r.edits for r in token_counts.with_edits(docs, log).collect()}
    assert [tuple(e) for e in rows[1]] == [(3, 0, "-"), (0, 1, "X")] and rows[2] is None
