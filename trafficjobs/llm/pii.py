"""Personal data: four base patterns, and terms of the corpus that give protected entities away.

Base spans are found by fixed patterns; protected are also identifiers, runs of 16 letters and digits or more with both. The
words within CONTEXT words of an entity are its context. Two kinds of terms disclose.

A term discloses one entity. Equal contexts count once, on either side of each ratio, so that copies neither prove nor
disprove anything: over the whole corpus it is counted in how many distinct contexts of an entity a term stands, and in how
many distinct windows (the term's word and CONTEXT words on either side) it stands at all and near the entity. With w(t)
windows of the term, w(t, e) of them near the entity, n(e) contexts of the entity and N entity contexts, a term discloses e if
it stands in at least SUPPORT contexts of e, P(e | t) = w(t, e) / w(t) is at least CERTAINTY and the pointwise mutual
information log2(P(e | t) N / n(e)) at least BITS.

A term discloses a kind of entity, as "password" does a secret. With c(t) occurrences of the term in the corpus, c(t, k) of them
in contexts of the kind, and p(k) the share of all words in such contexts, it does if it stands beside at least KIND_SUPPORT
different entities of the kind, P(k | t) = (c(t, k) + SHRINK p(k)) / (c(t) + SHRINK) is at least CERTAINTY and
log2(P(k | t) / p(k)) at least BITS.

Occurrences of disclosing terms are spans of kind term; an identifier in whose context a term stands that discloses the
kind secret is a span of that kind.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficjobs.llm.common import fresh, in_arrow, materialize, named

CONTEXT, SUPPORT, CERTAINTY, BITS = 4, 3, 0.5, 4.0
KIND_SUPPORT, SHRINK = 5, 2
#: Terms that are broadcast at once; more candidates are counted in parts, more disclosing terms reach the texts by a join.
MOST_TERMS = 200_000
#: Windows, or different terms, that a task holds at a time.
HELD = 200_000
KINDS = ("email", "ip", "card", "phone", "term", "secret")
BASE = KINDS[:4]
#: Rows of a batch that are plain Python texts at a time.
ROWS = 500

_EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}")
TERM = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in order; per kind leftmost and non-overlapping, failing matches dropped."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_END.match(text, at)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(run[0]):
                if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
                    out.append((run.start() + m.start(), 1, run.start() + m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _plain(text: str, low: str) -> bool:
    """Whether lower-casing the whole text lower-cases each term alike and leaves it where it is."""
    return len(low) == len(text) and "Σ" not in text


def cut(text: str) -> list[str]:
    """The lower-cased terms of a text, cut alike wherever terms are counted or marked."""
    low = text.lower()
    return TERM.findall(low) if _plain(text, low) else [t.lower() for t in TERM.findall(text)]


def _window(words: list[str], i: int) -> int:
    """Hash of word i and CONTEXT words on either side, lower-cased."""
    return int.from_bytes(blake2b(" ".join(words[max(0, i - CONTEXT) : i + CONTEXT + 1]).lower().encode(), digest_size=8).digest(), "little", signed=True)


def identifiers(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of runs of letters and digits that may be secrets, outside the base spans."""
    found = [(m.start(), 5, m.end()) for m in _IDENTIFIER.finditer(text)]
    return [f for f in found if not any(a < f[2] and f[0] < b for a, _, b in spans)] if found and spans else found


class _Words:
    """The white-space words of a text."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, array("q"), array("q")
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def near(self, start: int, end: int) -> list[tuple[int, str]]:
        """Numbers of the words in the context of a span, and what of them the span leaves."""
        before, after = bisect_left(self.starts, start), bisect_right(self.ends, end)
        left = [(i, self.text[self.starts[i] : min(self.ends[i], start)]) for i in range(max(0, before - CONTEXT), before)]
        return left + [(i, self.text[max(self.starts[i], end) : self.ends[i]]) for i in range(after, min(len(self.starts), after + CONTEXT))]

    def __getitem__(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


def _mentions(text: str, beside: Counter) -> Iterator[tuple[str, str, list[tuple[str, int]]]]:
    """Of each entity its name, the terms of its context, and the windows of those terms. beside counts the occurrences of terms in contexts of a kind."""
    spans = base_spans(text)
    spans += identifiers(text, spans)
    if not spans:
        return
    words, places = _Words(text), set()
    for start, kind, end in spans:
        terms, windows = set(), set()
        for i, part in words.near(start, end):
            cuts = cut(part)
            terms |= set(cuts)
            if len(part) < words.ends[i] - words.starts[i]:  # what the span cuts off a longer term is none of the text's terms
                whole = set(cut(words[i]))
                cuts = [t for t in cuts if t in whole]
            if cuts:
                lo = max(0, i - CONTEXT)
                window = _window([words[j] for j in range(lo, min(len(words.starts), i + CONTEXT + 1))], i - lo)
                windows |= {(t, window) for t in cuts}
                if (kind, i) not in places:
                    places.add((kind, i))
                    beside.update((KINDS[kind], t) for t in cuts)
        yield f"{KINDS[kind]}:{text[start:end].lower()}", " ".join(sorted(terms)), sorted(windows)


_WINDOWS = pa.list_(pa.struct([("term", pa.string()), ("window", pa.int64())]))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of entity, context and windows; and with n the occurrences of a term (as context) in contexts of a kind (as entity)."""
    beside: Counter = Counter()

    def rows(found: list[tuple]) -> pa.RecordBatch:
        names, kinds = ["entity", "context", "windows", "n"], [pa.string(), pa.string(), _WINDOWS, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in enumerate(kinds)], names=names)

    for whole in batches:
        for lo in range(0, len(whole), ROWS):
            found = [m for text in whole.column(0).slice(lo, ROWS).to_pylist() for m in _mentions(text or "", beside)]
            yield rows([(e, c, [{"term": t, "window": w} for t, w in ws], None) for e, c, ws in found])
            if len(beside) > HELD:
                yield rows([(*k, None, n) for k, n in beside.items()])
                beside.clear()
    yield rows([(*k, None, n) for k, n in beside.items()])


def _occurrences(wanted, total: bool):
    """Of the wanted terms in whole texts, rows with a distinct window, within a task, or with n occurrences; without a term, n is of all terms.

    wanted is a broadcast of the terms that may disclose an entity, with the most windows that they may have then, and of those
    that may disclose a kind. A term with more windows in one task is settled, what else there is of it cannot change the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, common = wanted.value
        live, held, n, counts, of_all = set(most), {}, 0, Counter(), 0

        def rows(terms: list, windows: list, numbers: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(windows, pa.int64()), pa.array(numbers, pa.int64())], names=["term", "window", "n"])

        def windows() -> pa.RecordBatch:
            terms = [t for t, ws in held.items() for _ in ws]
            return rows(terms, [w for ws in held.values() for w in ws], [None] * len(terms))

        for batch in batches:
            for text in (t for lo in range(0, len(batch), ROWS) for t in batch.column(0).slice(lo, ROWS).to_pylist()):
                if not text:
                    continue
                cuts = cut(text)
                of_all += len(cuts)
                counts.update(t for t in cuts if t in common)
                if live.isdisjoint(cuts):
                    continue
                words = text.split()
                for i, word in enumerate(words):
                    window = None
                    for t in cut(word):
                        if t in live:
                            window = _window(words, i) if window is None else window
                            own = held.setdefault(t, set())
                            n -= len(own)
                            own.add(window)
                            n += len(own)
                            if len(own) > most[t]:
                                live.discard(t)
                if n > HELD:
                    yield windows()
                    held, n = {}, 0
        yield windows()
        yield rows([*counts, *[None] * total], [None] * (len(counts) + total), [*counts.values(), *[of_all] * total])

    return run


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, entity, joint, occurrences, certainty, bits of the terms beyond the thresholds, one row for each entity or kind they disclose.

    For an entity, named kind:text, joint counts its distinct contexts with the term, occurrences the term's distinct windows.
    For a kind joint counts its different entities beside the term, occurrences all of the term's. Null and empty texts hold
    nothing, and an empty table discloses nothing.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    raw = in_arrow(texts, _contexts, "entity string, context string, windows array<struct<term:string,window:bigint>>, n long")
    raw = materialize(raw.groupBy("entity", "context", "windows").agg(F.sum("n").alias("n")), "contexts")
    contexts, beside = raw.where("n is null"), raw.where("n is not null").select(F.col("entity").alias("kind"), F.col("context").alias("term"), F.col("n").alias("near"))
    distinct = contexts.select("entity", "context").distinct()
    per_entity = distinct.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    total = distinct.count()
    pairs = contexts.select("entity", "context", F.explode("windows").alias("w")).select("entity", "context", "w.term", "w.window")
    support = pairs.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= SUPPORT)
    near = pairs.select("entity", "term", "window").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("near"))
    joint = materialize(support.join(near, ["entity", "term"]), "joint")
    entities = pairs.select(F.substring_index("entity", ":", 1).alias("kind"), "term", "entity").distinct().groupBy("kind", "term").agg(F.count(F.lit(1)).alias("joint"))
    of_kinds = materialize(entities.where(F.col("joint") >= KIND_SUPPORT).join(beside, ["kind", "term"]), "of-kinds")
    wanted = joint.groupBy("term").agg(F.floor(F.max("near") / CERTAINTY).alias("most"), F.lit(False).alias("common"))
    wanted = wanted.unionByName(of_kinds.select("term", F.lit(None).cast("long").alias("most"), F.lit(True).alias("common")).distinct())
    # by the same words for any number of candidates: more than MOST_TERMS take a pass for each part of them
    parts = -(-wanted.count() // max(1, MOST_TERMS)) or 1
    found = None
    for k in range(parts):
        part = wanted.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()
        part = {r.term: r.most for r in part if not r.common}, frozenset(r.term for r in part if r.common)
        more = in_arrow(texts, _occurrences(docs.sparkSession.sparkContext.broadcast(part), k == 0), "term string, window long, n long")
        found = more if found is None else found.unionByName(more)
    found = materialize(found.groupBy("term", "window").agg(F.sum("n").alias("n")), "occurrences")
    counts = found.where("window is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    out = joint.join(counts, "term").join(per_entity, "entity")
    out = out.withColumn("certainty", F.col("near") / F.col("n_t")).withColumn("bits", F.log2(F.col("certainty") * F.lit(float(max(total, 1))) / F.col("n_e")))

    words = found.where("term is null").agg(F.sum("n").alias("n")).first().n or 1
    share = beside.groupBy("kind").agg((F.sum("near") / F.lit(words)).alias("p"))
    counts = found.where("term is not null and window is null").select("term", F.col("n").alias("n_t"))
    kinds = of_kinds.join(counts, "term").join(F.broadcast(share), "kind").select("term", F.col("kind").alias("entity"), "joint", "n_t", ((F.col("near") + SHRINK * F.col("p")) / (F.col("n_t") + SHRINK)).alias("certainty"), "p")
    kinds = kinds.withColumn("bits", F.log2(F.col("certainty") / F.col("p"))).drop("p")
    both = out.select("term", "entity", "joint", "n_t", "certainty", "bits").unionByName(kinds)
    return both.where((F.col("certainty") >= CERTAINTY) & (F.col("bits") >= BITS)).withColumnRenamed("n_t", "occurrences")


def _marked(text: str, revealing, keys) -> list[dict]:
    """All spans of a text; revealing are its terms to mark, keys those of them that give secrets away."""
    spans = base_spans(text)
    if revealing:
        low = text.lower()
        if _plain(text, low):
            terms = [(m.start(), 4, m.end(), m[0]) for m in TERM.finditer(low) if m[0] in revealing]
        else:
            terms = [(m.start(), 4, m.end(), t) for m in TERM.finditer(text) if (t := m[0].lower()) in revealing]
        secrets = identifiers(text, spans) if any(t[3] in keys for t in terms) else ()
        if secrets:
            words = _Words(text)
            secrets = [s for s in secrets if any(not keys.isdisjoint(cut(part)) for _, part in words.near(s[0], s[2]))]
        spans = sorted([*spans, *(t[:3] for t in terms), *secrets])
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _replaced(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    parts, done = [], 0
    for s in spans:
        if s["start"] >= done:
            parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join([*parts, text[done:]])


def _spans(terms, names: list[str], redacted: bool = False):
    """names are those of the result. The last column is the text; terms is a broadcast, or None if the column before it has each text's own terms. Adds the spans, or replaces the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = 1 if terms is not None else 2
        shared = (frozenset(terms.value), frozenset(t for t, secret in terms.value.items() if secret)) if terms is not None else None
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                batch = whole.slice(lo, ROWS)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                if shared:
                    out = [_marked(t or "", *shared) for t in texts]
                else:
                    own = [{r["term"]: r["secret"] for r in rows or ()} for rows in batch.column(batch.num_columns - 2).to_pylist()]
                    out = [_marked(t or "", r.keys(), {k for k, secret in r.items() if secret}) for t, r in zip(texts, own)]
                columns = batch.columns[:-more]
                if redacted:
                    changed = pa.array([_replaced(t, s) for t, s in zip(texts, out)], pa.string())
                    yield pa.RecordBatch.from_arrays([changed if n == "text" else c for n, c in zip(names, columns)], names=names)
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _SPANS)], names=names)

    return run


def _own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text's number and distinct term."""
    for whole in batches:
        for lo in range(0, len(whole), ROWS):
            batch = whole.slice(lo, ROWS)
            found = [(n, t) for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in set(cut(text))]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["_row", "term"])


def _searched(docs: DataFrame, redacted: bool) -> DataFrame:
    terms = materialize(disclosing_terms(docs).groupBy("term").agg(F.max(F.col("entity") == "secret").alias("secret")), "terms")
    kept = [F.col("text").cast("string").alias("text") if redacted and c == "text" else q for c, q in zip(docs.columns, named(docs))] if redacted else named(docs, "spans")
    added = [] if redacted else [F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("spans")]
    schema = docs.select(*kept, *added).schema
    own_text, row, own_terms = fresh(docs, "_text_to_search", "_row", "_terms")
    rows = docs.select(*kept, F.col("text").cast("string").alias(own_text))
    if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        return in_arrow(rows, _spans(docs.sparkSession.sparkContext.broadcast({r.term: r.secret for r in terms.collect()}), schema.names, redacted), schema)
    # too many to broadcast: each text is joined with its own disclosing terms
    number = F.xxhash64(own_text)
    own = in_arrow(rows.where(F.col(own_text).isNotNull()).select(number.alias("_row"), own_text), _own_terms, "_row long, term string").distinct()
    own = own.join(terms, "term").groupBy(F.col("_row").alias(row)).agg(F.collect_set(F.struct("term", "secret")).alias(own_terms))
    both = rows.withColumn(row, number).join(own, row, "left")
    both = both.select(*named(rows, own_text), own_terms, own_text)
    return in_arrow(both, _spans(None, schema.names, redacted), schema)


def find_spans(docs: DataFrame) -> DataFrame:
    """docs with a column spans: array of (kind, start, end) in code points, ordered by start and kind; one named spans before is replaced.

    Null texts are empty. An empty table gives an empty result. Extra columns stay.
    """
    return _searched(docs, False)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets, terms by [TERM]; overlapping spans become one, named after the first.

    Columns stay, and null texts. One pass finds and replaces, so that a task needs one Python worker and not two.
    """
    return _searched(docs, True)


def digest(spans: str = "spans"):
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, n_secret, n_spans, base_sha256, spans as text, one row for each of find_spans()'s."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    (own,) = fresh(found, "_base")
    base = found.withColumn(own, F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return base.select("doc_id", *(of(k) for k in KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(digest(own).cast("binary"), 256).alias("base_sha256"), digest().alias("spans"))
