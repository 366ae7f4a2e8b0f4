"""Caps, splits and draws that give the same rows under any partitioning: order is by hash of id and seed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.session import materialize, small

SPLITS = ("train", "val", "test")
BITS = 60


def portable_hash(*parts: Column | str | int) -> Column:
    """A number of BITS bits from the MD5 of the parts' texts, joined by bars: other engines give the same. Null parts are left out."""
    texts = (F.lit(p).cast("string") if isinstance(p, (str, int)) else p.cast("string") for p in parts)
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, BITS // 4), 16, 10).cast("long")


def hash_order(id_: str = "id", seed: int = 42) -> Column:
    return portable_hash(F.col(id_), seed)


def cap_per_source(samples: DataFrame, most: int, id_: str = "id", seed: int = 42) -> DataFrame:
    """At most `most` rows of each label and source, those first in hash order; no cap if it is not positive. The window limits groups before the shuffle."""
    if most <= 0:
        return samples
    w = Window.partitionBy("label", "source").orderBy(hash_order(id_, seed), id_)
    return samples.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= most).drop("_no")


def stratified_split(samples: DataFrame, test: float = 0.2, val: float = 0.2, id_: str = "id", seed: int = 42, exact: bool = True, buckets: int = 1024) -> DataFrame:
    """samples with split. Exact: each label's rows in hash order, the first share test, the next val, sizes rounded.

    Ranks come from counts of hash buckets plus the rank in a bucket, so that a label of most rows is no single task. Not
    exact: the hash decides alone, without a shuffle.
    """
    h = hash_order(id_, seed)
    if not exact:
        at = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
        return samples.withColumn("split", F.when(at < test, "test").when(at < test + val, "val").otherwise("train"))
    marked = samples.withColumns({"_h": h, "_b": F.shiftright(h, BITS - buckets.bit_length() + 1).cast("int")})
    counts = marked.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("label", "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("label")).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("label", "_b").orderBy("_h", id_)) + F.col("_before")
    n_test, n_val = F.round(F.col("_all") * test), F.round(F.col("_all") * val)
    out = marked.join(small(materialize(counts, "counts")), ["label", "_b"]).withColumn("_rank", rank)
    split = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    return out.withColumn("split", split).drop("_h", "_b", "_before", "_all", "_rank")


def split_by_source(samples: DataFrame, test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """samples with split, so that a label's source is in one split only.

    The largest three sources go to the splits in turn, each other one to the split that lacks most of its share. Each choice
    hangs on those before, so a label's counts of sources are read by one task; they come sorted and pass one by one beside
    three sums, so that neither a row nor a task ever holds a label's sources. A label with fewer than three sources is an
    error. Rows without a label or source go.
    """
    counts = materialize(samples.where("label is not null and source is not null").groupBy("label", "source").agg(F.count(F.lit(1)).alias("n")), "sources")
    labels = materialize(counts.groupBy("label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sources")), "labels")
    if labels.where("sources < 3").take(1):
        raise ValueError("a split by source needs three sources of each label")
    share = lambda x: F.greatest(F.lit(1), F.bround(F.col("total") * x)).cast("long")
    labels = labels.select("label", share(val).alias("val"), share(test).alias("test"), "total")
    labels = labels.withColumn("train", F.greatest(F.lit(1).cast("long"), F.col("total") - F.col("val") - F.col("test"))).drop("total")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, no, have = None, 0, {}
        for batch in batches:
            splits = []
            for label, n, *want in zip(*(batch.column(c).to_pylist() for c in ("label", "n", *SPLITS))):
                if label != now:
                    now, no, have = label, 0, dict.fromkeys(SPLITS, 0)
                chosen = SPLITS[no] if no < 3 else max(((w - have[k]) / w, w - have[k], k) for k, w in zip(SPLITS, want))[2]
                have[chosen] += n
                no += 1
                splits.append(chosen)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("source"), pa.array(splits, pa.string())], names=["label", "source", "split"])

    ordered = counts.join(small(labels), "label").withColumns({"less": -F.col("n"), "h": portable_hash(F.col("source"), seed)})
    ordered = ordered.repartition("label").sortWithinPartitions("label", "less", "h", "source").select("label", "source", "n", *SPLITS)
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    plan = ordered.mapInArrow(deal, f"label {kinds['label']}, source {kinds['source']}, split string")
    return samples.join(small(materialize(plan, "plan")), ["label", "source"])


def balanced_resample(samples: DataFrame, draws: int, id_: str = "id", seed: int = 42) -> DataFrame:
    """About `draws` rows with replacement, each label equally often: every row is repeated by a Poisson number of mean draws / (labels x rows of its label)."""
    counts = samples.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    k = counts.count()
    mean = F.lit(float(draws)) / (F.lit(k) * F.col("_n"))
    u = (F.pmod(portable_hash(F.col(id_), seed, "draw"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    whole, part = F.floor(mean), mean - F.floor(mean)
    # the whole part always, the rest by the inverse of the Poisson distribution function of a mean under 1
    terms, total, times = F.exp(-part), F.exp(-part), F.lit(0)
    for i in range(1, 9):
        times = times + F.when(u > total, 1).otherwise(0)
        terms = terms * part / i
        total = total + terms
    return samples.join(small(materialize(counts, "counts")), "label").withColumn("_times", (whole + times).cast("int")).where("_times > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_n", "_times")


def triplets(samples: DataFrame, id_: str = "id", seed: int = 42) -> DataFrame:
    """anchor id and label with negative_id, a row of another label, or of the same if there is none; the positive is an augmented anchor.

    Rows of a label are numbered by buckets of the hash, and the drawn number is joined by equality.
    """
    buckets = 256
    marked = samples.select(F.col(id_).alias("id"), "label").withColumn("_h", portable_hash(F.col("id"), seed))
    marked = marked.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    counts = materialize(marked.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_n")), "counts")
    before = F.sum("_n").over(Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = materialize(counts.select("label", "_b", before.alias("_before")), "offsets")
    numbered = marked.join(small(offsets), ["label", "_b"]).withColumn("no", F.row_number().over(Window.partitionBy("label", "_b").orderBy("id")) + F.col("_before"))
    # the labels in order stand in a row; a draw is a place in the row of all others, found by its count before the own label
    sizes = counts.groupBy("label").agg(F.sum("_n").alias("n"))
    w = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)  # a row for each label
    ranges = materialize(sizes.select("label", "n", (F.sum("n").over(w) - F.col("n")).alias("from"), F.sum("n").over(Window.partitionBy()).alias("all")), "ranges")
    drawn = marked.join(small(ranges), "label").withColumn("others", F.col("all") - F.col("n"))
    # within a label's own rows only if there is no other
    pick = F.pmod("_h", F.greatest(F.col("others"), F.lit(1).cast("long")))
    place = F.when(F.col("others") == 0, F.pmod("_h", "n")).when(pick < F.col("from"), pick).otherwise(pick + F.col("n"))
    drawn = drawn.select("id", "label", place.alias("place"))
    pool = numbered.join(small(ranges), "label").select(F.col("label").alias("negative_label"), (F.col("no") - 1 + F.col("from")).alias("place"), F.col("id").alias("negative_id"))
    return drawn.join(pool, "place").select("id", "label", "negative_id", "negative_label")


def shuffled(samples: DataFrame, id_: str = "id", seed: int = 42) -> DataFrame:
    """In hash order; a range-partitioned sort, for output only."""
    return samples.orderBy(hash_order(id_, seed), id_)
