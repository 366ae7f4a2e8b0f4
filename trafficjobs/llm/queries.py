"""The queries op1_ to op13_: each applies its operator with production parameters to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficjobs.llm import bpe, chat, decontaminate, language, near_dedup, negatives, packing, pii, prefix_trie, sharding, token_counts, topk, toxicity


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    score = F.col("toxic_score")
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), score.alias("score"), (score >= toxicity.REJECT).cast("int").alias("predicted"), "n_hits", "n_quoted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path, counts = tokenizer_path(), ["n_before", "n_after", "n_chars_after", "n_reencoded"]
    counted = token_counts.count_tokens(docs.withColumn("edits", token_counts.derived_edits()), path, keep=True)
    # a second log goes on from the kept trees: what it does not touch is not encoded again
    kept = counted.withColumnsRenamed({c: f"first_{c}" for c in counts}).withColumn("edits", token_counts.derived_edits(first=3))
    again = token_counts.count_tokens(kept, path)
    return again.select("doc_id", *(F.col(f"first_{c}").alias(c) for c in counts), *(F.col(c).alias(f"later_{c}") for c in counts[1:]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    placed = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return placed.select("doc_id", language.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], table.schema)
    return chat.summary(table.unionByName(more))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path(), decoded="decoded").select("doc_id", "ids", "decoded")
    return coded.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=False))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.mislabelled(negatives.usable(_table(spark, sf_dir, "embeddings"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity, op2_decontamination, op3_token_counts, op4_language_id, op5_chat_formatting,
        op6_near_duplicates, op7_bpe, op8_sharding, op9_exact_top_k, op10_pii, op11_packing, op12_prefix_trie, op13_hard_negatives,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the result; the other operators have brute-force tests in tests/llm."""
    return {
        "op2_decontamination": decontaminate.FIND_SQL, "op5_chat_formatting": chat.SUMMARY_SQL,
        "op6_near_duplicates": near_dedup.NEAR_SQL, "op9_exact_top_k": topk.TOP_K_SQL, "op12_prefix_trie": prefix_trie.TRIE_SQL, "op13_hard_negatives": negatives.MINE_SQL,
    }
