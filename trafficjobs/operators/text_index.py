"""A trigram index of records: a search reads the lists of its own trigrams, intersects them, and looks only at the records left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficjobs.operators.search import contains_text
from trafficjobs.session import materialize, small

#: Folders that the lists are dealt to by their trigram.
PARTS = 64


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of the lower-case text; none of a null or shorter text."""
    low = F.lower(text)
    n = F.char_length(low)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(low, i, F.lit(3)))))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def write(records: DataFrame, path: str, id_: str, raw: str) -> None:
    """Append the lists of records (id, raw) to an index at path. A batch of new records adds files; whole texts are indexed."""
    rows = records.select(F.col(id_).alias("id"), F.explode(trigrams(F.col(raw))).alias("gram")).withColumn("part", _part(F.col("gram")))
    # a trigram that all records have is spread by id; in a file the lists are sorted, so that readers skip the others
    rows = rows.repartition("part", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("part", "gram", "id")
    rows.write.mode("append").partitionBy("part").parquet(f"{path}/lists")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """id of the records that hold every trigram of the text, once each; None if it is too short to have one."""
    asked = spark.range(1).select(F.explode(trigrams(F.lit(text))).alias("gram")).withColumn("part", _part(F.col("gram"))).collect()  # as many as the text is long
    if not asked:
        return None
    lists = spark.read.parquet(f"{path}/lists").where(F.col("part").isin(sorted({r.part for r in asked})) & F.col("gram").isin([r.gram for r in asked]))
    return lists.groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(asked)).select("id")


def search(records: DataFrame, path: str, id_: str, raw: str, text: str) -> DataFrame:
    """The records whose raw text contains the text, whatever its case: those of search.contains_text. Texts under three characters are looked for in all records."""
    found = candidates(records.sparkSession, path, text)
    if found is not None:
        records = records.join(small(materialize(found.withColumnRenamed("id", id_), "candidates")), id_, "left_semi")
    return records.where(contains_text(F.col(raw), text))
