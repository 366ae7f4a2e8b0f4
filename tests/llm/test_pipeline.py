"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from trafficjobs.llm import pii, toxicity

from .test_near_dedup import brute
from .test_records import leaks, plain_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]
    columns, table = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        table = spark.createDataFrame(stage(spark, table, SF).collect(), stage(spark, table.limit(0), SF).schema)
        assert name == "bpe" or table.columns == columns
        kept[name] = {r.doc_id: r for r in table.collect()}
    first = {r.doc_id: r.text for r in docs.collect()}

    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    mild = {i for i, t in first.items() if scorer.score(scorer.features([t or ""])[0])[0] < toxicity.REJECT}
    assert set(kept["toxicity"]) == mild and mild != set(first)
    single = {i for i, _, _, k in brute([(i, first[i]) for i in mild]) if k}
    assert set(kept["near_duplicates"]) == single
    leaked = {d for d, _ in leaks([(i, first[i]) for i in single], [(r.item_id, r.text) for r in items.collect()])}
    assert set(kept["decontamination"]) == single - leaked and leaked
    for i, r in kept["personal_data"].items():
        # the replaced text holds none of the base kinds, and a text without any stays
        assert not plain_spans(r.text or "") and r.n_chars == len(r.text or "")
        if not pii.base_spans(first[i] or "") and "[TERM]" not in (r.text or ""):
            assert r.text == first[i]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in kept["bpe"].items():
        ids = library.encode(kept["personal_data"][i].text or "", add_special_tokens=False).ids
        assert r.exact and r.n_tokens == len(ids) and np.frombuffer(bytes(r.ids), "<u4").tolist() == ids


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_nulls_and_repeats(spark, tmp_path):
    odd = ["n_tokens", "IDS", "exact", "decoded", "spans", "toxic_score", "kept", "bands", "t", "x.y", "_terms", "node"]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "plain text of some words here"), (1, "plain text of some words here"), (2, None), (None, "no id here at all my friend"), (3, ""), (4, long), (5, long + " end"), (6, "me@ex.org wrote")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, *range(len(odd))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in odd))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"out-{name}"))
        table = spark.read.parquet(str(tmp_path / f"out-{name}"))
    kept = {(r.doc_id, (r.text or "")[:20]): r for r in table.collect()}
    assert set(kept) == {(1, "plain text of some w"), (2, ""), (None, "no id here at all my"), (3, ""), (4, long[:20]), (6, "[EMAIL] wrote")}
    assert all(r.exact and r["x.y"] == odd.index("x.y") and r.decoded == odd.index("decoded") for r in kept.values()) and table.columns.count("n_tokens") == 1
