"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Items and documents become five-word shingles of lower-cased words. A window of a document has as many shingles as an item,
or all of a shorter document. Windows are fingerprinted by a 64-bit SimHash whose weights are the shingles' counts. Item
fingerprints are indexed by five blocks, four of 13 bits with all values within four bits and one of 12 bits with all
within three. Fingerprints that differ more than that in every block differ in at least 4 * 5 + 4 = 24 bits, so the index
gives every item within RADIUS. Candidates are verified by the exact weighted Jaccard similarity of the shingle counts, sum
of minima over sum of maxima, of at least 3/4.

Only windows that can reach that are fingerprinted: of w window and m item shingles 3 (m + w) / 7 have to be common, hence
at least as many places of the window hold a shingle of some item of that size. No window that qualifies is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficjobs.llm.common import materialize, named, small

WORDS = 5
#: Similarity as a ratio of whole numbers; at it two fingerprints differ in 11 bits on average, with a deviation of 3.
AT_LEAST = (3, 4)
RADIUS = 23
#: Bits of each block of a fingerprint, and the bits within which it is indexed; each tolerance and one sum to RADIUS and one.
BLOCKS = ((13, 4), (13, 4), (13, 4), (13, 4), (12, 3))


def shingles(text: Column) -> Column:
    """Hashes of all five-word shingles in order, repeated ones too; the whole sequence if it is shorter, none without words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.size(h) - WORDS + 1), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(WORDS))))
        short = F.array(F.xxhash64(F.size(h), F.array_join(h.cast("array<string>"), " ")))
        return F.when(F.size(h) >= WORDS, long).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    # one lambda variable holds the words, which are then split and hashed once
    return F.flatten(F.transform(F.array(hashed), grams))


def fingerprint(grams: Column) -> Column:
    """SimHash: bit b is set if more than half of the shingles have it, each counted as often as it occurs. Two counts share a number."""
    lanes = F.array(*(F.lit(k).cast("int") for k in range(32)))
    two = F.lit(1 << 32).cast("long")
    low = lambda h, k: F.call_function("shiftright", h, k).bitwiseAND(F.lit(1).cast("long"))
    add = lambda acc, h: F.zip_with(acc, lanes, lambda a, k: a + low(h, k) + two * low(h, k + F.lit(32)))
    sums = F.aggregate(grams, F.array_repeat(F.lit(0).cast("long"), 32), add)

    def bits(s: Column) -> Column:
        half = F.size(grams)
        first = F.zip_with(s, lanes, lambda a, k: F.when(a.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
        second = F.zip_with(s, lanes, lambda a, k: F.when(F.shiftrightunsigned(a, 32) * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), k + F.lit(32))).otherwise(F.lit(0).cast("long")))
        return F.aggregate(F.concat(first, second), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return F.element_at(F.transform(F.array(sums), bits), 1)


def blocks_of(fp: Column) -> Column:
    """The blocks of a fingerprint, lowest bits first."""
    starts = [sum(bits for bits, _ in BLOCKS[:k]) for k in range(len(BLOCKS))]
    return F.array(*(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(2**bits - 1)).cast("int") for at, (bits, _) in zip(starts, BLOCKS)))


def masks(spark: SparkSession) -> DataFrame:
    """block, mask: what two values of a block may differ in. 4,671 rows, whatever the data."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.lit(bits).alias("bits"), F.lit(within).alias("within")) for k, (bits, within) in enumerate(BLOCKS))))
    rows = spark.range(2 ** max(bits for bits, _ in BLOCKS), numPartitions=1).select(F.col("id").cast("int").alias("mask"), each.alias("b"))
    return rows.where((F.col("mask") < F.call_function("shiftleft", F.lit(1), F.col("b.bits"))) & (F.bit_count("mask") <= F.col("b.within"))).select("b.block", "mask")


def indexed(items: DataFrame) -> DataFrame:
    """item_key, m, fp with block and value: all values of each block within its tolerance of the item's."""
    rows = items.select("item_key", "m", "fp", F.posexplode(blocks_of(F.col("fp"))).alias("block", "at")).join(F.broadcast(masks(items.sparkSession)), "block")
    return rows.select("item_key", "m", "fp", "block", F.col("at").bitwiseXOR(F.col("mask")).alias("value"))


def common(x: Column, y: Column) -> Column:
    """Sum over shingles of the smaller count. If either side has no shingle twice this is the number of distinct common ones."""
    many = lambda a, v: F.size(F.filter(a, lambda e: e == v))
    plain = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
    full = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, v: acc + F.least(many(x, v), many(y, v)))
    return F.when(plain, F.size(F.array_intersect(x, y))).otherwise(full)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, common, total: for each document and item it holds, its most similar window.

    start is the window's first word, common / total the similarity; of equal windows the first one is given. Null and empty
    texts and items, and null ids, hold nothing; items of equal text are all given; repeated rows count once. Items of
    fewer than five words are found only as whole documents. Extra columns are ignored.
    """
    given = benchmark.where("item_id is not null and text is not null").select("item_id", shingles(F.col("text")).alias("grams")).where(F.size("grams") > 0).distinct()
    given = materialize(given.withColumns({"item_key": F.xxhash64("grams"), "m": F.size("grams")}), "items")
    items = materialize(given.dropDuplicates(["item_key"]).select("item_key", "m", "grams", fingerprint(F.col("grams")).alias("fp")), "item-prints")
    grams = materialize(items.select(F.explode("grams").alias("g"), "m").distinct(), "item-shingles")

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    places = texts.select("doc_id", F.xxhash64("text").alias("t"), shingles(F.col("text")).alias("grams"))
    places = places.select("doc_id", "t", F.size("grams").alias("n"), F.posexplode("grams").alias("at", "g"))
    hits = places.join(small(grams), "g").groupBy("doc_id", "t", "n", "m").agg(F.sort_array(F.collect_set("at")).alias("at"))
    # starts of windows with enough places hit: from any `need` neighbouring hits that lie in one window
    hits = hits.withColumns({"w": F.least("m", "n")}).withColumn("need", F.ceil((F.col("m") + F.col("w")) * F.lit(AT_LEAST[0]) / F.lit(AT_LEAST[0] + AT_LEAST[1])).cast("int")).where(F.size("at") >= F.col("need"))
    run = F.filter(F.sequence(F.lit(1), F.size("at") - F.col("need") + 1), lambda i: F.element_at("at", i + F.col("need") - 1) - F.element_at("at", i) < F.col("w"))
    # the starts that cover each run of hits; both ends only grow, so what an interval shares with the one before is left out of it
    spans = F.transform(run, lambda i: F.struct(F.greatest(F.lit(0), F.element_at("at", i + F.col("need") - 1) - F.col("w") + 1).alias("lo"), F.least(F.element_at("at", i), F.col("n") - F.col("w")).alias("hi")))
    own = F.transform(F.array(spans), lambda all_: F.transform(all_, lambda s, k: F.struct(F.when(k > 0, F.greatest(s["lo"], F.get(all_, k - 1)["hi"] + 1)).otherwise(s["lo"]).alias("lo"), s["hi"].alias("hi"))))
    dense = hits.select("doc_id", "t", "m", "w", F.explode(F.flatten(own)).alias("s")).where("s.lo <= s.hi")
    dense = materialize(dense.select("doc_id", "t", "m", "w", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")), "dense")

    held = texts.withColumn("t", F.xxhash64("text")).join(small(dense.select("doc_id", "t").distinct()), ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
    held = materialize(held.select("doc_id", "t", shingles(F.col("text")).alias("grams")), "held")
    windows = dense.join(held, ["doc_id", "t"]).select("doc_id", "t", "m", "w", "grams", F.explode(F.sequence("lo", "hi")).alias("start"))
    windows = windows.select("doc_id", "t", "m", "start", F.slice(F.col("grams"), F.col("start") + 1, F.col("w")).alias("window"))
    # the print of equal windows, as copies have them, is computed once
    distinct = materialize(windows.withColumn("key", F.xxhash64("window")), "windows")
    prints = distinct.groupBy("key", "m").agg(F.first("window").alias("window"))
    prints = materialize(prints.select("key", "m", "window", fingerprint(F.col("window")).alias("print")), "prints")
    probes = prints.select("key", "m", "print", F.posexplode(blocks_of(F.col("print"))).alias("block", "value"))
    near = probes.join(materialize(indexed(items), "index"), ["m", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("fp"))) <= RADIUS)
    near = near.select("key", "m", "item_key").distinct()
    both = near.join(prints.select("key", "m", "window"), ["key", "m"]).join(items.select("item_key", "grams"), "item_key")
    both = both.select("key", "m", "item_key", common(F.col("window"), F.col("grams")).alias("common"), (F.size("window") + F.size("grams")).alias("sum"), F.size("window").alias("w"))
    sure = both.where(F.col("common") * AT_LEAST[1] >= (F.col("sum") - F.col("common")) * AT_LEAST[0]).select("key", "m", "item_key", "common", (F.col("sum") - F.col("common")).alias("total"), "w")
    found = distinct.select("doc_id", "key", "m", "start").join(sure, ["key", "m"])
    best = F.max_by(F.struct("start", "w", "common", "total"), F.struct(F.col("common") / F.col("total"), -F.col("start")))
    found = found.groupBy("doc_id", "item_key").agg(best.alias("b")).join(given.select("item_id", "item_key").distinct(), "item_key")
    return found.select("doc_id", "item_id", F.col("b.start").alias("start"), (F.col("b.w") + WORDS - 1).alias("n_words"), F.col("b.common").alias("common"), F.col("b.total").alias("total"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold an item; columns stay, and rows with a null doc_id."""
    gone = materialize(find(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(small(gone), "doc_id", "left_anti").select(*named(docs))


#: DuckDB SQL of find() over the tables, by every window; the fingerprints have no part in it.
FIND_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, [x FOR x IN regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT 'i', item_id, [x FOR x IN regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') IF x <> ''] FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT kind, id, CASE WHEN len(w) >= 5 THEN [array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)] ELSE [len(w) || ' words: ' || array_to_string(w, ' ')] END AS g
  FROM words WHERE len(w) > 0),
places AS (SELECT kind, id, len(g) AS n, unnest(g) AS s, unnest(range(0, len(g))) AS pos FROM grams),
items AS (SELECT id AS item_id, n AS m, s, count(*) AS times FROM places WHERE kind = 'i' GROUP BY ALL),
hits AS (SELECT p.id AS doc_id, p.n, p.s, p.pos, i.item_id, i.m, i.times, least(i.m, p.n) AS w FROM places p JOIN items i ON p.kind = 'd' AND p.s = i.s),
enough AS (SELECT * FROM hits QUALIFY count(*) OVER (PARTITION BY doc_id, n, item_id) * 7 >= 3 * (m + w)),
starts AS (SELECT DISTINCT doc_id, n, item_id, m, w, unnest(range(greatest(0, pos - w + 1), least(pos, n - w) + 1)) AS start FROM enough),
shared AS (
  SELECT t.doc_id, t.n, t.item_id, t.m, t.w, t.start, e.s, least(count(*), any_value(e.times)) AS k
  FROM starts t JOIN enough e ON e.doc_id = t.doc_id AND e.n = t.n AND e.item_id = t.item_id AND e.pos BETWEEN t.start AND t.start + t.w - 1 GROUP BY ALL),
windows AS (SELECT doc_id, item_id, m, w, start, sum(k) AS common, m + w - sum(k) AS total FROM shared GROUP BY doc_id, n, item_id, m, w, start),
best AS (SELECT * FROM windows WHERE common * 4 >= total * 3 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / total DESC, start) = 1)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(w + 4 AS INTEGER) AS n_words, CAST(common AS INTEGER) AS common, CAST(total AS INTEGER) AS total FROM best
"""
