import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trafficjobs.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_levenshtein_neighbourhood():
    rng = random.Random(5)
    terms = [("moron", False), ("trash", False), ("scum", False), ("idiot", False), ("réeux", True)]
    model = toxicity.Model(terms, [5.0] * 5)
    scorer = toxicity.Scorer(model)
    words = {"".join(rng.choice("moranidtscuhré") for _ in range(rng.randint(1, 8))) for _ in range(3000)} | {"moron", "mor0n", "moroon", "mron", "oron", "réeuxant", "rééuxant", "trashy", "trashes", "scumm"}
    for word in words:
        if not word.isalpha():
            continue
        hits = scorer.features([word])[1][0]
        want = any(word.startswith(t) if stem else distance(word, t) <= (1 if len(t) >= toxicity.FUZZY_FROM else 0) for t, stem in terms)
        assert bool(hits) == want, word


def test_context_tells_quotation():
    scorer = toxicity.Scorer(toxicity.Model([("idiot", False)], [5.0]))
    hits = scorer.features(['He said "what an idiot" again', "you idiot", ""])[1]
    assert hits[0][0][4] == 2 and hits[1][0][4:] == (0, 1) and hits[2] == []


def test_contractions_and_closed_quotes_are_no_quotation():
    scorer = toxicity.Scorer(toxicity.Model([("idiot", False)], [5.0]))
    told = {
        "I don’t care, you idiot, and I won’t stop": 0, "l’ami, idiot, n’est pas là": 0, 'a "word" then idiot and "more"': 0, "‘what an idiot’ it was": 1, "„so ein idiot“ war es": 1,
        "«un idiot» disait": 1, "»ein idiot« war": 1, "“closed” idiot “open": 0, '"opened idiot': 0, "the boys’ idiot and the girls’ one": 0,
    }
    for text, want in told.items():
        assert scorer.features([text])[1][0][0][4] == want, text


def plain_score(text, model):
    """The score of a text word by word, by edit distances."""
    hits, low = [], text.lower()
    for m in re.finditer(r"[^\W\d_]+", low):
        word, best = m[0], None
        for k, (term, stem) in enumerate(model.terms):
            most = 1 if len(term) >= toxicity.FUZZY_FROM and (model.loose_stems or not stem) else 0
            beginnings = [word[:n] for n in range(len(word) + 1)] if stem else [word]
            e = min(distance(w, term) for w in beginnings)
            if e <= most and (best is None or (e, k) < best):
                best = e, k
        if best and not (best[0] and word in model.harmless):
            before, after = text[max(0, m.start() - toxicity.CONTEXT) : m.start()], text[m.end() : m.end() + toxicity.CONTEXT]
            near = {w.lower() for w in re.findall(r"[^\W\d_]+", before[-30:] + " " + after[:30])}
            hits.append((*best, toxicity.quoted(before, after) or bool(near & toxicity.REPORTING), bool(near & toxicity.ADDRESS)))
    if not hits:
        return 1 / (1 + math.exp(-model.weights[0]))
    strength = [model.odds[k] * toxicity.FUZZY**e for e, k, _, _ in hits]
    abuse = [s for s, h in zip(strength, hits) if not h[2]]
    x = [
        math.log1p(sum(abuse)), math.log1p(sum(strength) - sum(abuse)), max(abuse, default=0.0) / 4, len({h[1] for h in hits if not h[2]}) ** 0.5,
        math.log1p(100 * sum(abuse) / (1 + text.count(" "))), math.log1p(sum(h[0] for h in hits)), math.log1p(sum(h[3] for h in hits)),
    ]
    return 1 / (1 + math.exp(-max(-30, min(30, model.weights[0] + sum(w * v for w, v in zip(model.weights[1:], x))))))


def test_scores_equal_a_plain_version(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in toxicity.score(docs, model).collect() if len(r.text or "") < 6000][:60]
    assert labels.count() and any(r.n_hits for r in rows) and model.terms
    for r in rows:
        assert abs(plain_score(r.text or "", model) - r.toxic_score) < 1e-9, r.doc_id


def test_toxicity_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, "calm words", 5, "a"), (2, None, 6, "b")], "doc_id long, text string, Toxic_Score int, `n.hits` string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.reject(docs, none)
    assert kept.columns == docs.columns and sorted(r[2] for r in kept.collect()) == [5, 6]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).select("doc_id", "toxic_score", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.toxic_score <= 1 for r in rows)
    toxic, clean = [r.toxic_score for r in rows if r.toxic], [r.toxic_score for r in rows if not r.toxic]
    area = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert area > 0.75 and sum(c >= toxicity.REJECT for c in clean) <= 0.02 * len(clean)
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, other).weights == model.weights


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "idiot " * 50_000, 7), (2, "", 7)], "doc_id long, text string, toxic_score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert model.terms == []
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "toxic_score", "n_hits", "n_quoted"] and out.count() == 4
    assert toxicity.reject(docs, none).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_lexicon_is_bounded_by_evidence_alone(spark):
    rng = random.Random(7)
    terms = sorted({"".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n)) for n in [3] * 5 + [7] * 65})
    plain = ["alpha", "house", "river", "green", "table", "stone"]
    docs = [(f"{t} {rng.choice(plain)} {rng.choice(plain)} {k}", 1) for t in terms for k in range(30)]
    docs += [(" ".join(rng.choice(plain) for _ in range(4)) + f" {k}", 0) for k in range(2500)]
    frame = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(docs)], "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert {t for t, _ in model.terms} >= set(terms) and len(terms) > 60


def test_stems_of_the_fitted_model_get_one_edit():
    scorer = toxicity.Scorer(toxicity.Model([("réeux", True), ("idiot", False)], [5.0, 5.0], loose_stems=True))
    for word, edits in [("réeuxant", 0), ("rééuxant", 1), ("réuxant", 1), ("réeeuxant", 1), ("rééuuxant", None), ("rant", None), ("idiots", 1), ("idioting", None)]:
        hits = scorer.features([word])[1][0]
        assert [h[3] for h in hits] == ([] if edits is None else [edits]), word


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predict(docs, language.fit(docs)).where(language.held_out()).where("lang is not null").collect()
    right = Counter(r.lang == r.lang_pred for r in rows)
    assert right[True] >= 0.97 * len(rows) and all(0 <= r.lang_score <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 +- !", "en"), (4, "😀 🙂", None), (5, "the other then", "en"), (6, "ñandú año niño", "es"), (7, "x" * 300_000, None), (8, "漢字", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4)] == ["und"] * 4 and len(out) == 8
    assert {out[k].lang_pred for k in (5, 7, 8)} <= {"en", "es"} and out[8].lang_rejected
    assert language.fit(docs.limit(0)) is None
    assert [r.lang_pred for r in language.predict(docs, None).collect()] == ["und"] * 8


def test_predictions_equal_a_plain_nearest_centroid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    vectors, got = language.Vectors(), {r.doc_id: r for r in language.predict(docs.where("doc_id % 7 = 0"), model).collect()}
    for i, r in got.items():
        counts = vectors.counts([r.text or ""])[0]
        x = [math.log1p(c) * w for c, w in zip(counts, model.idf)]
        size = math.sqrt(sum(v * v for v in x))
        best = {}
        for name, centre in zip(model.names, model.centroids):
            cosine = sum(v * c for v, c in zip(x, centre)) / size if size else 0
            best[name] = max(best.get(name, -1), cosine)
        name = max(best, key=lambda n: best[n]) if size else "und"
        assert r.lang_pred == name or abs(best[r.lang_pred] - best[name]) < 1e-9, i


def test_every_language_is_learned(spark):
    rng = random.Random(2)
    rows = []
    for k in range(230):  # more languages than any bound, each of letters of its own
        letters = [chr(0x4E00 + 20 * k + j) for j in range(8)]
        rows += [(len(rows) + j, " ".join("".join(rng.choices(letters, k=4)) for _ in range(12)), f"x{k}") for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(set(model.names)) == 230
    out = language.predict(docs, model)
    assert out.where("lang = lang_pred").count() > 0.8 * len(rows)


def test_language_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, "some text", "en", 4), (2, "más años", "es", 5)], "doc_id long, text string, lang string, LANG_PRED int")
    out = language.predict(docs, language.fit(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_rejected"] and out.count() == 2


@pytest.mark.parametrize("texts", [["a"], ["", "ab cd"], ["héé", "zz zz", "ß"]])
def test_ngram_counts(texts):
    counts = language.Vectors().counts(texts)
    for row, text in zip(counts, texts):
        padded = text + " "
        grams = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
        want = sum(1 for g in grams if (len(g) == 1 and g != " ") or (len(g) == 2 and g.strip()) or (len(g) == 3 and g[1] != " "))
        assert row.sum() == want
