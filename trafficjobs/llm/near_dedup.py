"""Near-duplicate detection by banded HyperMinHash registers, confirmed on full shingle sets.

Each text's distinct five-word shingles are hashed to 64 bits. A sketch has 128 registers; a register keeps the leading-zero
count (6 bits) and the next bits (10) of its smallest hash. In large sets seven bits of the hash choose the register of an
element. In small sets, which would leave most of those registers empty and bands that hang on one shared line, every
element is hashed anew for each register. Sets of middle size have both sketches, so that similar sets share a kind.

Four registers make one band of 64 bits, so the bands are the compressed registers themselves. Equal sets are one node of the
graph, whatever ids their rows have. In every band bucket each node is compared with one centre, chosen by hash, which links
a large group of copies without forming its pairs; what then still lies in one bucket but in different components is compared
pair by pair, estimated inside the join by a finer sketch too, and buckets with many such pairs are dealt to several tasks.
Pairs whose collision-corrected Jaccard estimate is not more than five deviations under the threshold are verified on the
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficjobs.llm.common import cuts, in_arrow, materialize, mix, named, small, strings
from trafficjobs.llm.shingles import shingle_sets

BUCKET_BITS, MANTISSA_BITS, PER_BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
EMPTY = 0xFFFF
#: Sets below FEW have the sketch for small sets, sets from LARGE on the other; 3/4 of FEW is LARGE, so any two similar sets share one.
FEW, LARGE = 1024, 768
#: Accidental equality of two registers of like sets, as a share of 2**-MANTISSA_BITS (HyperMinHash paper).
COLLISION = 0.169919487159739
#: Links hold from this similarity on, as a ratio of whole numbers.
AT_LEAST = (75, 100)
DEVIATIONS = 5.0
#: Registers of the sketch that decides which pairs of a bucket are verified, and hashes of each element for it.
FINE, FINE_ROUNDS = 1024, 64
#: Bytes of text that a worker sketches at once.
PIECE = 400_000
#: Edges that one task handles, and pairs of one bucket.
PART, PAIRS = 250_000, 1_000_000


def _code(smallest: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit values."""
    bits = (smallest | np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA_BITS)
    exponent = (bits >> np.uint64(MANTISSA_BITS)) - np.uint64(1023)
    zeros = (np.uint64(64) - exponent).clip(0, 63)
    return np.minimum((zeros << np.uint64(MANTISSA_BITS)) | (bits & np.uint64((1 << MANTISSA_BITS) - 1)), EMPTY - 1)


def bucketed(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sketch of large sets, a row each; hashes are sorted in each row, so the first of a register is its smallest."""
    counts = np.diff(ends)
    row = np.repeat(np.arange(len(counts)), counts)
    cell = row * BUCKETS + (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(cell), dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    out = np.full(len(counts) * BUCKETS, EMPTY, dtype=np.uint16)
    out[cell[first]] = _code(hashes[first] << np.uint64(BUCKET_BITS))
    return out.reshape(len(counts), BUCKETS)


_SALTS = mix(np.arange(1, 2 * BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, BUCKETS)
_SALTS[1] |= np.uint64(1)


def rehashed(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sketch of small sets, none of them empty: every element competes for every register."""
    out = np.empty((len(ends) - 1, BUCKETS), dtype=np.uint16)
    if len(hashes):
        for j in range(BUCKETS):
            out[:, j] = _code(np.minimum.reduceat((hashes ^ _SALTS[0, j]) * _SALTS[1, j], ends[:-1]))
    return out


def _some(hashes: np.ndarray, ends: np.ndarray, rows: np.ndarray, sketch) -> pa.Array:
    """Bands of the chosen rows by that sketch, null for the others."""
    counts = np.diff(ends)
    taken = hashes[np.repeat(rows, counts)]
    bands = sketch(taken, np.concatenate(([0], np.cumsum(counts[rows])))).view(np.int64).ravel()
    width = BUCKETS // PER_BAND
    lists = _lists(bands, np.arange(rows.sum() + 1) * width)
    return lists.take(pa.array(np.where(rows, np.cumsum(rows) - 1, 0), mask=~rows))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def prints(hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two sums of 64 bits over each set, which with its size tell sets apart."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64))) for salt in (0x51ED, 0xA5A5F00D)]
    return [(x[ends[1:]] - x[ends[:-1]]).view(np.int64) for x in sums]


def _pieces(batches: Iterator[pa.RecordBatch]):
    """Ids, shingle hashes and their offsets, piece by piece."""
    for batch in batches:
        raw, offsets = strings(batch.column(1))
        for lo, hi in cuts(offsets, PIECE):
            yield batch.column(0)[lo:hi], *shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, hashes, ends in _pieces(batches):
        n = np.diff(ends)
        small_ones, large_ones = _some(hashes, ends, (n > 0) & (n < FEW), rehashed), _some(hashes, ends, n >= LARGE, bucketed)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), *map(pa.array, prints(hashes, ends)), small_ones, large_ones], names=["doc_id", "n_shingles", "s1", "s2", "bands", "wide"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, hashes, ends in _pieces(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends)), *map(pa.array, prints(hashes, ends)), _lists(hashes, ends)], names=["doc_id", "n_shingles", "s1", "s2", "grams"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of FINE registers of one byte for the pairs that the bands leave: FINE_ROUNDS hashes of each element, eight bits of each smallest."""
    shift = np.uint64(64 - FINE.bit_length() + 1)
    for ids, hashes, ends in _pieces(batches):
        rows = len(ends) - 1
        cell = np.repeat(np.arange(rows) * FINE, np.diff(ends))
        least = np.full(rows * FINE, np.iinfo(np.uint64).max)
        for j in range(FINE_ROUNDS):
            x = mix(hashes ^ _SALTS[0, j])
            np.minimum.at(least, cell + (x >> shift).astype(np.int64), x * _SALTS[1, j])
        code = (mix(least) >> np.uint64(56)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends)), *map(pa.array, prints(hashes, ends)), _lists(code.view(np.int64), np.arange(rows + 1) * (FINE // 8))], names=["doc_id", "n_shingles", "s1", "s2", "fine"])


def _unequal(x: Column, y: Column, width: int) -> Column:
    """Number of lanes of that many bits in which two arrays of longs differ: each lane's bits are gathered in its lowest."""

    def lanes(p: Column, q: Column) -> Column:
        d, step = p.bitwiseXOR(q), width // 2
        while step:
            d, step = d.bitwiseOR(F.shiftrightunsigned(d, step)), step // 2
        return F.bit_count(d.bitwiseAND(F.lit(sum(1 << k for k in range(0, 64, width))).cast("long")))

    return F.aggregate(F.zip_with(x, y, lanes), F.lit(0), lambda acc, v: acc + v)


def _allows(x: Column, y: Column, n: int, width: int, chance: float) -> Column:
    """Whether the collision-corrected estimate from n registers allows the threshold within DEVIATIONS standard deviations; null without sketches.

    Registers that are empty in both sets count as equal, which only makes the test milder.
    """
    t = AT_LEAST[0] / AT_LEAST[1]
    least = t - DEVIATIONS * (t * (1 - t) / n) ** 0.5
    return _unequal(x, y, width) <= F.lit(int(n * (1 - chance) * (1 - least)) + 1)


def plausible(x: str, y: str) -> Column:
    """The test by a banded sketch that both have; sets without one are too unlike in size."""
    pairs = ((F.col(f"{k}_{x}"), F.col(f"{k}_{y}")) for k in ("bands", "wide"))
    return F.coalesce(*(_allows(p, q, BUCKETS, 16, COLLISION / 2**MANTISSA_BITS) for p, q in pairs), F.lit(False))


def first_shared(x: str, y: str) -> Column:
    """The first band in which both agree, the wide bands after the others; 0 if none."""
    at = lambda k: F.coalesce(F.array_position(F.zip_with(f"{k}_{x}", f"{k}_{y}", lambda p, q: (p == q) & (p != -1)), True), F.lit(0).cast("long"))
    narrow, wide = at("bands"), at("wide")
    return F.when(narrow > 0, narrow).when(wide > 0, wide + BUCKETS // PER_BAND).otherwise(0)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over edges (a, b), for every node that has an edge.

    Each round hooks every node to its smallest neighbour and contracts; the rest shrinks geometrically. Minima are
    pre-aggregated and the joins can be split, so a hub with most of the edges is no single task.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hooks, n = [], edges.count()
    while n:
        parts = -(-n // PART)  # few edges need few tasks
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        hooks.append(materialize(hook.coalesce(parts), "hook"))
        to = small(hooks[-1])
        left = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialize(left.coalesce(parts), "edges")
        n = edges.count()
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = hooks[-1].select("node", F.col("to").alias("label"))
    for hook in reversed(hooks[:-1]):
        labels = hook.join(small(labels).withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    return labels if len(hooks) == 1 else materialize(labels, "labels")


KEY = ["s1", "s2", "n_shingles"]


class _Texts:
    """What is computed again from the texts of chosen nodes. nodes has node, doc_id and KEY of each set."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes

    def of(self, chosen: DataFrame, function, column: str) -> DataFrame:
        """node and what the function gives as that column for the distinct nodes of chosen."""
        wanted = materialize(self.nodes.join(small(materialize(chosen.distinct(), "chosen")), "node", "left_semi").select("node", "doc_id", *KEY), "wanted")
        # a doc_id may have rows of several texts, and several rows of one text
        texts = self.docs.join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
        made = in_arrow(texts, function, f"doc_id long, n_shingles long, s1 long, s2 long, {column} array<long>")
        made = materialize(made.join(small(wanted), ["doc_id", *KEY]).select("node", column), column)
        if made.count() > wanted.count():  # only then are there repeated rows
            made = materialize(made.groupBy("node").agg(F.first(column).alias(column)), column)
        return made

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold."""
        ends = [pairs.select(F.col(k).alias("node")).distinct() for k in "ab"]  # not both ends of every pair: a node is in many
        sets = self.of(ends[0].union(ends[1]), _sets, "grams")
        left, right = (sets.select(F.col("node").alias(k), F.col("grams").alias(f"grams_{k}")) for k in "ab")
        both = pairs.join(right, "b").join(left, "a")
        common, total = F.size(F.array_intersect("grams_a", "grams_b")), F.size("grams_a") + F.size("grams_b")
        return both.select("a", "b", common.alias("n"), total.alias("m")).where(F.col("n") * AT_LEAST[1] >= (F.col("m") - F.col("n")) * AT_LEAST[0]).select("a", "b").distinct()


def _of_one_id(real: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the sets of rows that share a doc_id."""
    ends = [f(k).alias(f"{name}_{k}") for k in ("s1", "s2") for name, f in (("lo", F.min), ("hi", F.max))]
    several = real.groupBy("doc_id").agg(*ends).where("lo_s1 <> hi_s1 or lo_s2 <> hi_s2").select("doc_id")
    held = real.join(small(materialize(several, "several")), "doc_id", "left_semi").select("doc_id", *KEY).distinct().join(nodes.select("node", *KEY), KEY)
    held = materialize(held.select("doc_id", "node"), "held")
    return held.join(held.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts and texts without words have the empty set and no link. Rows that repeat a doc_id are one document:
    each of its texts links it. A null doc_id gets a null component, is kept and links nothing. An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(in_arrow(docs, _signed, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, wide array<long>"), "signed")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets share all registers; the numbers of nodes are fixed once they are written
    groups = real.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("wide").alias("wide"))
    nodes = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")

    none = F.array_repeat(F.lit(-1).cast("long"), BUCKETS // PER_BAND)
    banded = nodes.select("node", F.posexplode(F.concat(F.coalesce("bands", none), F.coalesce("wide", none))).alias("band", "key")).where("key <> -1")
    banded = banded.select("node", "band", F.xxhash64("band", "key").alias("k"))
    buckets = banded.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", "k")).alias("centre")).where("n > 1")
    spots = materialize(banded.join(small(materialize(buckets, "buckets")), "k"), "spots")

    signs = lambda k, as_: nodes.select(F.col("node").alias(k), F.col("bands").alias(f"bands_{as_}"), F.col("wide").alias(f"wide_{as_}"))
    texts = _Texts(docs, nodes)
    star = spots.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    star = star.join(signs("a", "a"), "a").join(signs("b", "b"), "b").where(plausible("a", "b")).select("a", "b")
    labels = components(texts.links(materialize(star, "star")).unionByName(_of_one_id(real, nodes)))

    # pairs of one bucket that no centre has joined
    placed = spots.where("node <> centre").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = placed.join(labels.select(F.col("node").alias("centre"), F.col("label").alias("main")), "centre", "left").withColumn("main", F.coalesce("main", "centre"))
    placed = materialize(placed, "placed")
    apart = placed.where("label <> main").groupBy("k").agg(F.count(F.lit(1)).alias("strays"))
    open_ = materialize(placed.join(small(materialize(apart, "apart")), "k").withColumn("parts", F.ceil(F.col("strays") * F.col("n") / PAIRS).cast("int")), "open")
    fine = texts.of(open_.select("node"), _fine, "fine")
    told = open_.join(signs("node", "x"), "node").join(fine, "node")
    # the strays of a bucket with many pairs are dealt to parts, each of which meets the whole bucket
    stray = told.where("label <> main").select("k", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "band", F.col("node").alias("x"), F.col("label").alias("label_x"), "bands_x", "wide_x", F.col("fine").alias("fine_x"))
    held = told.select(
        F.col("k").alias("k_y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_y"), F.col("node").alias("y"), F.col("label").alias("label_y"), "main",
        F.col("bands_x").alias("bands_y"), F.col("wide_x").alias("wide_y"), F.col("fine").alias("fine_y"),
    )
    fits = (F.col("label_x") != F.col("label_y")) & ((F.col("label_y") == F.col("main")) | (F.col("x") < F.col("y")))
    # a pair counts in the first bucket it shares; if one of the two is the centre there, they have been compared
    fits &= (first_shared("x", "y") == F.col("band") + 1) & plausible("x", "y") & _allows(F.col("fine_x"), F.col("fine_y"), FINE, 8, 1 / 256)
    rest = stray.join(held, (F.col("k") == F.col("k_y")) & (F.col("part") == F.col("part_y")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = texts.links(materialize(rest, "rest"))
    of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
    more = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("last"))

    # each set gets its component, then the rows of sets that are not alone get their set's
    # a node that no centre has joined has no label so far, but may be joined now
    alone = joined.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("last").alias("label"))
    labels = labels.join(small(joined), "label", "left").select("node", F.coalesce("last", "label").alias("label")).unionByName(alone)
    told = materialize(nodes.select("node", "doc_id", "rows", *KEY).join(small(materialize(labels, "labelled")), "node", "left"), "told")
    least = materialize(told.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    told = told.join(small(least), "label", "left").where("label is not null or rows > 1").select(*KEY, F.coalesce("least", "doc_id").alias("component_id"))
    out = signed.select("doc_id", *KEY).join(small(materialize(told, "components")), KEY, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows of near-duplicate groups but each group's smallest doc_id; columns and order of columns stay.

    Rows that repeat the kept doc_id all stay, as do rows without words or with a null doc_id.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    gone = materialize(gone, "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*named(docs))


#: DuckDB SQL of near_duplicates() over documents of different doc_id, by all pairs that share a shingle.
NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common WHERE 100 * k >= 75 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_of AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.c, s.doc_id) AS component_id, coalesce(l.c, s.doc_id) = s.doc_id AS kept FROM sets s LEFT JOIN least_of l ON l.a = s.doc_id
"""
