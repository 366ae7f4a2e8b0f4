"""A store of ids in parts by hash with a Bloom filter beside each part, so that a batch reads only parts that may hold its ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficjobs.session import materialize, small

#: Parts of a store, bits of a part's filter (bitmaps of 4 KB, 8 MB for all parts) and hashes of an id. A filter of 20,000 ids
#: lets 0.5 % of others pass; with more it passes more, which costs reading and no result.
PARTS, BITS, HASHES = 256, 1 << 18, 4


def _part(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(PARTS)).cast("int")


def _bits(ids: DataFrame) -> DataFrame:
    """ids (id) with part, and a row for each hash: the bitmap and the bit in it that the hash names."""
    at = F.explode(F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(BITS)) + 1))
    rows = ids.withColumn("part", _part(F.col("id"))).withColumn("at", at)
    return rows.select("id", "part", F.bitmap_bucket_number("at").alias("bitmap_no"), F.bitmap_bit_position("at").alias("bit"))


def add(ids: DataFrame, path: str, id_: str = "event_id") -> None:
    """Append ids to the store at path; nulls are not stored. First their filter bits, then the ids: an id that a failure left out of the ids is new again."""
    fresh = materialize(ids.select(F.col(id_).cast("string").alias("id")).where("id is not null").distinct(), "ids")
    _bits(fresh).groupBy("part", "bitmap_no").agg(F.bitmap_construct_agg("bit").alias("bits")).write.mode("append").parquet(f"{path}/filters")
    fresh.withColumn("part", _part(F.col("id"))).repartition("part").write.mode("append").partitionBy("part").parquet(f"{path}/ids")


def maybe_stored(ids: DataFrame, path: str) -> DataFrame:
    """Those of ids (id), distinct, that the filters let pass, with their part: all that are stored and few others."""
    # at most PARTS * BITS / 32768 rows of 4 KB after the union
    filters = ids.sparkSession.read.schema("part int, bitmap_no long, bits binary").parquet(f"{path}/filters").groupBy("part", "bitmap_no").agg(F.bitmap_or_agg("bits").alias("bits"))
    met = _bits(ids).join(F.broadcast(filters), ["part", "bitmap_no"])
    byte = F.conv(F.hex(F.substring("bits", (F.expr("bit div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (F.col("bit") % 8).cast("int"))
    return met.groupBy("id", "part").agg(F.sum(held.cast("int")).alias("n")).where(F.col("n") == HASHES).select("id", "part")


def unseen(batch: DataFrame, path: str, id_: str = "event_id") -> tuple[DataFrame, list[int]]:
    """The rows of batch whose id is not in the store, as by an anti join, and the parts of the store that were read. Rows without an id are unseen."""
    spark: SparkSession = batch.sparkSession
    try:
        held = spark.read.schema("id string, part int").parquet(f"{path}/ids")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return batch, []
    asked = batch.select(F.col(id_).cast("string").alias("id")).where("id is not null").distinct()
    maybe = materialize(maybe_stored(asked, path), "maybe")
    parts = sorted(r.part for r in maybe.select("part").distinct().collect())  # PARTS at most
    known = materialize(maybe.join(held.where(F.col("part").isin(parts)), ["part", "id"], "left_semi").select(F.col("id").alias("_known")), "known")
    return batch.join(small(known), F.col(id_).cast("string") == F.col("_known"), "left_anti"), parts
