"""Corpus pipeline: STAGES applied to documents one after the other, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficjobs.llm import bpe, decontaminate, near_dedup, pii, toxicity
from trafficjobs.llm.common import drop_tables, fresh, materialize, named, tables
from trafficjobs.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least the rejection threshold go. Null and empty texts stay, columns too, whatever their names."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id. Texts without words and rows without doc_id stay."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts and rows without doc_id stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced by their kind; n_chars follows the text. No row goes, null texts stay null."""
    out = pii.redact(docs)
    return out.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else q for c, q in zip(out.columns, named(out))))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, packed as little-endian unsigned 32-bit integers, their number, and whether decoding gives the text back.

    They are called ids, n_tokens and exact and replace columns of these names; the other columns stay. A null text has no
    ids and is exact.
    """
    docs = docs.select(*named(docs, "ids", "n_tokens", "exact"))
    (decoded,) = fresh(docs, "decoded")
    coded = bpe.encode(docs, tokenizer_path(), decoded=decoded)
    return coded.select(*named(docs), bpe.n_tokens().alias("n_tokens"), "ids", (F.col(decoded) == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", tokenize),
]

#: Learned scores and token ids can't be written in SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage takes empty tables, extra columns, repeated rows and very long texts as its docstring says.

    Once a stage is written, the tables that it made on its way and the rows that it read are dropped.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with tables() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        *inner, written = made
        drop_tables(spark, inner + read)
        read = [written]
    return STAGES[-1][1](spark, docs, sf_dir)
