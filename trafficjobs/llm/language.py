"""Language identification by nearest centroid.

Letter n-grams of one to three code points, with word edges, are hashed to DIMENSIONS columns; document frequencies are
counted over all texts with a language to learn from. Texts become normalised TF-IDF vectors. Every value of lang has up to
CENTROIDS centroids from spherical k-means over a bounded sample, fitted in one task for each. A text gets the language of
the centroid of greatest cosine; it is rejected where that cosine is under what nearly all sample texts of the language reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.llm.common import code_points, cuts, in_arrow, materialize, mix, named, small

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 3, 12
#: Sample texts of each language at most, of the smallest hashes, for the centroids.
FIT_ROWS = 400
#: Share of a language's sample texts that may lie beyond its rejection distance, and how much further it is set.
OUTSIDE, SLACK = 0.01, 0.8


class Vectors:
    """Counts of hashed n-grams."""

    def __init__(self):
        points = [chr(i) for i in range(0x10000)]
        letter = np.fromiter((c.isalpha() for c in points), bool, 0x10000)
        # letters to their lower case where that is one letter; all else to a blank
        low = np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in points), np.uint32, 0x10000)
        self.fold = np.where(letter, low, np.uint32(32))

    def counts(self, texts: list[str]) -> np.ndarray:
        """A row of DIMENSIONS counts for each text; all zero without a letter."""
        points, offsets = code_points(texts)
        folded = self.fold[np.minimum(points, 0xFFFF)].astype(np.uint64)
        for point in np.unique(points[points >= 0x10000]).tolist():
            folded[points == point] = point if chr(point).isalpha() else 32
        keep = np.ones(len(folded), dtype=bool)
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))[keep]
        c = folded[keep]
        out = np.zeros(len(texts) * DIMENSIONS)
        shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
        grams = c
        for n in (1, 2, 3):
            if n > 1:
                grams = grams[:-1] * np.uint64(0x110000) + c[n - 1 :]
            size = len(c) - n + 1
            if size <= 0:
                break
            whole = row[:size] == row[n - 1 :]
            whole &= (c[:size] != 32) if n == 1 else (c[:size] != 32) | (c[n - 1 :] != 32) if n == 2 else c[1 : size + 1] != 32
            cell = (mix(grams[whole] + np.uint64(n << 61)) >> shift).astype(np.int64) + row[:size][whole] * DIMENSIONS
            out += np.bincount(cell, minlength=len(out))
        out = out.reshape(len(texts), DIMENSIONS)
        none = np.bincount(row[c != 32], minlength=len(texts)) == 0
        out[none] = 0
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    names: list[str]
    centroids: np.ndarray  # names repeat, a row for each centroid
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that languages are never learned from: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pieces(column: pa.Array, size: int = 250_000):
    column = column.fill_null("")
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))))
    for lo, hi in cuts(ends, size):
        for at in range(lo, hi, 256):
            yield at, column[at : min(hi, at + 256)].to_pylist()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vectors, seen, n = Vectors(), np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        for _, texts in _pieces(batch.column(0)):
            counts = vectors.counts(texts)
            seen += (counts > 0).sum(axis=0)
            n += len(texts)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate(([n], seen)))], names=["gram", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vectors = Vectors()
    for batch in batches:
        for at, texts in _pieces(batch.column(1)):
            counts = vectors.counts(texts).astype(np.float32)
            filled = np.flatnonzero(counts.any(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)).take(pa.array(filled)), pa.array([r.tobytes() for r in counts[filled]], pa.binary())], names=["lang", "counts"])


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart starts."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    sizes = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
    return centres[sizes >= max(1, 0.02 * len(x))]  # a centre of a few outliers isn't the language's


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Learn every language from text and lang of the rows not held out; None if there are none.

    Frequencies are of all those rows, repeated ones too; centroids are of a sample of each language, in which equal texts
    count once. Null texts and languages teach nothing.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id").where("lang is not null and text is not null").where(~held_out())
    found = {r.gram: r.n for r in in_arrow(known.select("text"), _frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if not found:
        return None
    idf = np.log((1 + found[-1]) / (1 + np.array([found.get(g, 0) for g in range(DIMENSIONS)]))) + 1
    # the rows of the smallest hashes, of a share that gives somewhat more than the bound; texts follow only for them
    ranks = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-sizes")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = known.select("lang", "doc_id", spot.alias("spot")).join(small(ranks), "lang").where(F.col("spot") <= (1.3 * rows + 20) / F.col("n"))
    first = Window.partitionBy("lang").orderBy("spot", "doc_id")
    chosen = near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= rows).select("lang", "doc_id").distinct()
    sample = known.join(small(materialize(chosen, "lang-rows")), ["lang", "doc_id"], "left_semi").select("lang", "text")
    sample = materialize(in_arrow(sample, _counted, "lang string, counts binary").distinct(), "lang-sample")
    model = Model(idf, [], np.zeros((0, DIMENSIONS)), np.zeros(0))

    def centred(group: pd.DataFrame) -> pd.DataFrame:
        x = model.vectors(np.stack([np.frombuffer(c, np.float32) for c in sorted(group["counts"])]).astype(np.float64))
        centres = _clusters(x, CENTROIDS)
        bound = SLACK * float(np.quantile((x @ centres.T).max(axis=1), OUTSIDE))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "least": bound, "at": range(len(centres))})

    centres = sample.groupBy("lang").applyInPandas(centred, "lang string, centre binary, least double, at int")
    found = centres.join(ranks, "lang").orderBy(F.desc("n"), "lang", "at").collect()
    if not found:
        return None
    return Model(idf, [r.lang for r in found], np.stack([np.frombuffer(r.centre) for r in found]), np.array([r.least for r in found]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred (und for null texts and texts without a letter, or without a model), lang_score (0 to 1) and lang_rejected.

    The score is a logistic of the cosine's lead over the best other language, halved where the text is rejected. Ties go to
    the language with more texts. Columns of these names are replaced, the others stay.
    """
    added = ["lang_pred", "lang_score", "lang_rejected"]
    columns = named(docs, *added)
    kept = docs.select(*columns).columns
    schema = docs.select(*columns, F.lit("").alias(added[0]), F.lit(0.0).alias(added[1]), F.lit(False).alias(added[2])).schema
    if model is not None:
        languages = list(dict.fromkeys(model.names))
        of = np.array([languages.index(n) for n in model.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for at, texts in _pieces(batch.column(batch.num_columns - 1)):
                counts = vectors.counts(texts)
                filled = counts.any(axis=1)
                if model is None:
                    names, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
                else:
                    cosine = model.vectors(counts) @ model.centroids.T
                    best = np.stack([cosine[:, of == k].max(axis=1) for k in range(len(languages))], axis=1)
                    first = best.argmax(axis=1)
                    top = best[np.arange(len(texts)), first]
                    others = best.copy()
                    others[np.arange(len(texts)), first] = 0
                    near = cosine.argmax(axis=1)
                    rejected = (top < model.least[near]) | ~filled
                    score = np.where(filled, 1 / (1 + np.exp(-12 * (top - others.max(axis=1)))), 0) * np.where(rejected, 0.5, 1.0)
                    names = [languages[k] if f else "und" for k, f in zip(first, filled)]
                part = batch.slice(at, len(texts)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*part, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=[*kept, *added])

    return in_arrow(docs.select(*columns, F.col("text").cast("string").alias("_text_to_place")), run, schema)
