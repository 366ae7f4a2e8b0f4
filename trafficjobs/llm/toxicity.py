"""Toxicity: a Levenshtein automaton intersected with a trie of learned terms, and context windows around what it finds.

The lexicon holds whole words and word stems whose document frequencies differ between toxic and clean labelled texts. Its
trie is intersected once with the automaton that allows one edit in terms of FUZZY_FROM letters and more, and made
deterministic; the table then runs over all words of a batch at once. Around each hit a window of CONTEXT code points tells
quotation (a quote mark that opens before it and closes after it, a reporting verb) from address (second person), and a
logistic model over sums per document gives the score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficjobs.llm.common import code_points, cuts, fresh, in_arrow, materialize, named

#: Labelled rows that the model is fitted on at most: those of the smallest hashes of doc_id.
FIT_ROWS = 8_000
#: Least toxic texts of a term, least log-odds ratio and one that is strong evidence, shortest stem. They alone bound the lexicon.
LEAST_TEXTS, LEAST_ODDS, STRONG_ODDS, STEM = 6, 3.0, 5.0, 5
CONTEXT, FUZZY, FUZZY_FROM = 60, 0.6, 5
REJECT = 0.7
#: Different names that a task counts before it hands its counts on.
NAMES = 100_000
# Opening quote marks with what closes them, and words that tell quotation and address.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "‚": "‘’"}
REPORTING = frozenset("said says wrote writes quoted quote called reported dit écrit sagte schrieb zitiert dijo escribió".split())
ADDRESS = frozenset("you your yours youre du dich dein tu te toi vous usted ti".split())
_WORDS = re.compile(r"[^\W\d_]+")
#: Quote marks, but for those between letters, which are apostrophes.
_MARKS = re.compile(r"[\"“”„«»‹›‘‚]|(?<![^\W\d_])’|’(?![^\W\d_])")


def quoted(before: str, after: str) -> bool:
    """Whether a quote mark is open at the end of before that is closed in after."""
    opened = ""
    for mark in _MARKS.findall(before):
        if opened:
            opened = "" if mark in QUOTES[opened] else opened
        else:
            opened = mark if mark in QUOTES else ""
    return bool(opened) and any(mark in QUOTES[opened] for mark in _MARKS.findall(after))


class Automaton:
    """Deterministic table of the trie of terms intersected with at most one edit; terms are (text, is_stem), stems get an edit if loose_stems."""

    def __init__(self, terms: list[tuple[str, bool]], loose_stems: bool = False):
        self.terms = terms
        letters = sorted({c for t, _ in terms for c in t})
        self.classes = {c: k + 1 for k, c in enumerate(letters)}
        self.reach = max((len(t) + 2 for t, _ in terms), default=0)
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        loose = [False]  # nodes on the way to a term that gets an edit
        fuzzy = [len(text) >= FUZZY_FROM and (loose_stems or not stem) for text, stem in terms]
        for k, (text, stem) in enumerate(terms):
            node = 0
            for c in text:
                loose[node] |= fuzzy[k]
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                    loose.append(False)
                node = children[node][c]
            loose[node] |= fuzzy[k]
            ends[node].append(k)
        stems = {k for k, (_, stem) in enumerate(terms) if stem}

        def closed(states: set) -> frozenset:
            out = set(states)
            for node, e in states:
                if e == 0 and node >= 0 and loose[node]:
                    out |= {(n, 1) for n in children[node].values() if loose[n]}
            out |= {(-1 - k, e) for node, e in out if node >= 0 for k in ends[node] if k in stems and (e == 0 or fuzzy[k])}
            return frozenset(out)

        def step(states: frozenset, c: str) -> frozenset:
            out = set()
            for node, e in states:
                if node < 0:
                    out.add((node, e))
                    continue
                if c in children[node]:
                    out.add((children[node][c], e))
                if e == 0 and loose[node]:
                    out.add((node, 1))
                    out |= {(n, 1) for n in children[node].values() if loose[n]}
            return closed(out)

        start = closed({(0, 0)})
        number, queue, rows = {frozenset(): 0, start: 1}, [start], [np.zeros(len(letters) + 1, dtype=np.int32)]
        for states in queue:
            row = None
            for c in ["\0", *sorted({c for node, _ in states if node >= 0 for c in children[node]})]:  # all other letters lead where none of them does
                after = step(states, c)
                if after not in number:
                    number[after] = len(number)
                    queue.append(after)
                if row is None:
                    row = np.full(len(letters) + 1, number[after], dtype=np.int32)
                else:
                    row[self.classes[c]] = number[after]
            rows.append(row)
        self.table = np.array(rows)
        # what a word means that ends in a state: term and edits, or -1
        self.term, self.edits = np.full(len(number), -1), np.zeros(len(number), dtype=np.int64)
        for states, n in number.items():
            found = [(e, k) for node, e in states for k in (ends[node] if node >= 0 else [-1 - node]) if node < 0 or (k not in stems and (e == 0 or fuzzy[k]))]
            if found:
                self.edits[n], self.term[n] = min(found)


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    odds: list[float] = field(default_factory=list)
    harmless: frozenset = frozenset()
    weights: list[float] = field(default_factory=lambda: [-3.0] + [0.0] * 7)
    loose_stems: bool = False


class Scorer:
    """Runs a model over texts; built once in each task."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.terms, model.loose_stems)
        self.odds = np.array(model.odds or [0.0])
        points = [chr(i) for i in range(0x10000)]
        self.letter = np.fromiter((c.isalpha() for c in points), bool, 0x10000)
        low = [c.lower() for c in points]
        self.classes = np.fromiter((self.automaton.classes.get(c, 0) for c in low), np.int64, 0x10000)

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end, term and edits of the matching words."""
        bmp = np.minimum(points, 0xFFFF)
        letter = self.letter[bmp]
        edge = np.diff(np.concatenate(([0], letter.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        classes, table = self.classes[bmp], self.automaton.table
        live, state = np.arange(len(start)), np.ones(len(start), dtype=np.int64)
        final = np.zeros(len(start), dtype=np.int64)
        for t in range(self.automaton.reach):
            open_ = start[live] + t < end[live]
            final[live[~open_]] = state[~open_]
            live, state = live[open_], state[open_]
            state = table[state, classes[start[live] + t]]
            live, state = live[state > 0], state[state > 0]
        final[live] = state
        found = np.flatnonzero(self.automaton.term[final] >= 0)
        return start[found], end[found], self.automaton.term[final[found]], self.automaton.edits[final[found]]

    def features(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple]]]:
        """A row of features for each text, and its hits (start, end, term, edits, quoted, addressed)."""
        points, offsets = code_points(texts)
        rows, found = np.zeros((len(texts), 7)), [[] for _ in texts]
        starts, ends, terms, edits = self.hits(points)
        where = np.searchsorted(offsets, starts, side="right") - 1
        for row, a, b, k, e in zip(where.tolist(), starts.tolist(), ends.tolist(), terms.tolist(), edits.tolist()):
            text, a, b = texts[row], a - int(offsets[row]), b - int(offsets[row])
            if e and text[a:b].lower() in self.model.harmless:
                continue
            before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
            near = {w.lower() for w in _WORDS.findall(before[-30:] + " " + after[:30])}
            found[row].append((a, b, k, e, quoted(before, after) + bool(near & REPORTING), int(bool(near & ADDRESS))))
        for row, hits in enumerate(found):
            if hits:
                strength = [self.odds[k] * FUZZY**e for _, _, k, e, _, _ in hits]
                abuse = [s for s, h in zip(strength, hits) if not h[4]]
                words = 1 + texts[row].count(" ")
                rows[row] = [
                    math.log1p(sum(abuse)), math.log1p(sum(strength) - sum(abuse)), max(abuse, default=0.0) / 4, len({h[2] for h in hits if not h[4]}) ** 0.5,
                    math.log1p(100 * sum(abuse) / words), math.log1p(sum(h[3] for h in hits)), math.log1p(sum(h[5] for h in hits)),
                ]
        return rows, found

    def score(self, rows: np.ndarray) -> np.ndarray:
        w = np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + rows @ w[1:], -30, 30)))


def _candidates(text: str) -> set[str]:
    """Whole words, and as stems, marked by a star, their beginnings."""
    words = set(_WORDS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in range(STEM, min(len(w), STEM + 5))}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        for k in (0, 1):
            of = [pa.array(list(counts[k].values()), pa.int64()), pa.array([0] * len(counts[k]), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts[k]), pa.string()), of[1 - k], of[k]], names=["term", "toxic", "clean"])
            counts[k].clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(_candidates(text))
            if len(counts[0]) + len(counts[1]) > NAMES:
                yield from rows()
    yield from rows()


def _presence(names: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(_candidates(t) & names) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["toxic", "terms"])

    return run


def _odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - math.log((clean + 0.5) / (n_clean - clean + 0.5))


def _chosen(rows: list, n_toxic: int, n_clean: int) -> list[tuple[str, float]]:
    """Greedy cover: again and again the term of most evidence among the toxic texts without a chosen term; then the others of
    strong evidence that neither begin a chosen term nor are begun by one. Whole words go before stems."""
    texts = {k: [set(r.terms) for r in rows if r.toxic == k] for k in (0, 1)}
    clean, toxic = (Counter(t for s in texts[k] for t in s) for k in (0, 1))
    odds = {t: _odds(toxic[t], clean[t], n_toxic, n_clean) for t in toxic}
    order = lambda t, n: (-odds[t] * math.sqrt(n), t.endswith("*"), -len(t), t)
    left, counts, out = texts[1], Counter(toxic), []
    heap = [(order(t, n), n, t) for t, n in counts.items()]
    heapq.heapify(heap)
    where = defaultdict(list)
    for k, own in enumerate(left):
        for t in own:
            where[t].append(k)
    while heap:
        _, n, term = heapq.heappop(heap)
        if counts[term] < LEAST_TEXTS / 2:
            continue
        if n != counts[term]:  # counts only fall, so the term comes up again where it now belongs
            heapq.heappush(heap, (order(term, counts[term]), counts[term], term))
            continue
        out.append(term)
        for k in where[term]:
            counts.subtract(left[k])
            left[k] = set()
    taken = {t.rstrip("*") for t in out}
    begun = {t[:n] for t in taken for n in range(1, len(t) + 1)}
    for term in sorted((t for t, n in toxic.items() if n >= 2 * LEAST_TEXTS and odds[t] >= STRONG_ODDS), key=lambda t: order(t, toxic[t])):
        own = term.rstrip("*")
        if own not in begun and not any(own[:n] in taken for n in range(1, len(own))):
            out.append(term)
            taken.add(own)
            begun |= {own[:n] for n in range(1, len(own) + 1)}
    return [(t, odds[t]) for t in out]


def _featured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows, found = scorer.features(texts)
            forms = [sorted({t[a:b].lower() for a, b, _, e, _, _ in hits if e}) for t, hits in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows.tolist(), pa.list_(pa.float64())), pa.array(forms, pa.list_(pa.string()))], names=["toxic", "x", "forms"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> list[float]:
    x = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
    return w.tolist()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learned from: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from labels (doc_id, toxic) of at most that many rows not held out; texts that repeat count once.

    Without toxic and clean rows the model finds nothing and scores every text alike. A term needs LEAST_TEXTS toxic texts; a
    sample with under four times as many cannot show that often what it holds, and there a quarter of them is enough, two at least.
    """
    used = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    used = used.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(used), "doc_id")
    sample = materialize(sample.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic"), "toxic-sample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model()
    terms = in_arrow(sample, _counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(n_toxic) - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (F.lit(n_clean) - F.col("clean") + 0.5))
    best = terms.where(F.col("toxic") >= min(LEAST_TEXTS, max(2, n_toxic // 4))).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    names = frozenset(r.term for r in best.collect())
    presence = in_arrow(sample, _presence(names), "toxic int, terms array<string>").collect()
    chosen = _chosen(presence, n_toxic, n_clean)
    model = Model([(t.rstrip("*"), t.endswith("*")) for t, _ in chosen], [o for _, o in chosen], loose_stems=True)
    seen = in_arrow(sample, _featured(model), "toxic int, x array<double>, forms array<string>")
    # misspelt forms that clean texts use as well are words of their own
    forms = seen.select("toxic", F.explode("forms").alias("form")).groupBy("form").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    model.harmless = frozenset(r.form for r in forms.where((F.col("n") - F.col("toxic") >= 2) & (F.col("toxic") < 3 * (F.col("n") - F.col("toxic")))).collect())
    seen = in_arrow(sample, _featured(model), "toxic int, x array<double>, forms array<string>").select("toxic", "x").collect()
    model.weights = _logistic(np.array([r.x for r in seen]), np.array([r.toxic for r in seen], dtype=float))
    return model


def score(docs: DataFrame, model: Model, added: Sequence[str] = ("toxic_score", "n_hits", "n_quoted")) -> DataFrame:
    """docs with toxic_score (0 to 1), n_hits and n_quoted; columns of these names are replaced, the others stay.

    Null and empty texts have no hits and the score of a text without hits.
    """
    columns = named(docs, *added)
    kept = docs.select(*columns).columns
    schema = docs.select(*columns, F.lit(0.0).alias(added[0]), F.lit(0).cast("long").alias(added[1]), F.lit(0).cast("long").alias(added[2])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).fill_null("")
            sizes = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
            for lo, hi in cuts(sizes):
                rows, found = scorer.features(texts[lo:hi].to_pylist())
                columns = [*batch.slice(lo, hi - lo).columns[:-1], pa.array(scorer.score(rows)), pa.array([len(h) for h in found], pa.int64()), pa.array([sum(x[4] > 0 for x in h) for h in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    return in_arrow(docs.select(*columns, F.col("text").cast("string").alias("_text_to_score")), run, schema)


def reject(docs: DataFrame, labels: DataFrame, least: float = REJECT) -> DataFrame:
    """docs without those of toxic_score >= least; columns stay, also ones of the names that score adds. Rows are judged one by one,
    repeated ones alike; null and empty texts have no hits. An empty table gives an empty result."""
    names = fresh(docs, "toxic_score", "n_hits", "n_quoted")
    return score(docs, fit(docs, labels), names).where(F.col(names[0]) < least).select(*named(docs))
