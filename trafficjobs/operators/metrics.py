"""Counts and quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficjobs.operators.correlate import CASE_STATES
from trafficjobs.operators.sketches import quantiles
from trafficjobs.session import materialize, small


def split_stats(samples: DataFrame) -> DataFrame:
    """split, label, source, n: counts of each split, split and label, split and source; null where a column is summed over."""
    return samples.groupingSets([["split"], ["split", "label"], ["split", "source"]], "split", "label", "source").agg(F.count(F.lit(1)).alias("n"))


def class_weights(samples: DataFrame) -> DataFrame:
    """samples with weight, 1 over the number of rows of the label."""
    counts = samples.groupBy("label").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return samples.join(small(materialize(counts, "label-counts")), "label")


def confusion(scored: DataFrame, truth: str = "label", guess: str = "predicted") -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy and the F1 of class 1."""
    one = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    counts = scored.agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(0, 0).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumns({"accuracy": F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), n), F.lit(0.0)), "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))})


def class_report(scored: DataFrame, truth: str = "label", guess: str = "predicted") -> DataFrame:
    """class, precision, recall, f1, support for each class, and the rows macro and weighted."""
    pairs = scored.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    per = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("is_t"), (F.col("t") == F.col("g")).cast("int").alias("hit"), "n"), F.struct(F.col("g").alias("c"), F.lit(0).alias("is_t"), F.lit(0).alias("hit"), "n"))).alias("x")).select("x.*")
    per = per.groupBy("c").agg(F.sum(F.col("n") * F.col("is_t")).alias("support"), F.sum(F.col("n") * F.col("hit")).alias("tp"), F.sum(F.col("n") * (1 - F.col("is_t"))).alias("guessed"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = per.select(F.col("c").cast("string").alias("class"), zero(F.try_divide("tp", "guessed")).alias("precision"), zero(F.try_divide("tp", "support")).alias("recall"), zero(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("guessed"))).alias("f1"), "support")
    mean = lambda c, w: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    rows = [per.agg(*(mean(c, w) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")).select(F.lit(name).alias("class"), "precision", "recall", "f1", "support") for name, w in (("macro", F.lit(1.0)), ("weighted", F.col("support")))]
    return per.unionByName(rows[0]).unionByName(rows[1])


def top_labels(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def conversion_counts(records: DataFrame, valid: str = "valid", source: str = "source") -> DataFrame:
    """source, saved, skipped; source is null in the total."""
    return records.rollup(source).agg(F.count_if(F.col(valid)).alias("saved"), F.count_if(~F.col(valid)).alias("skipped"))


def case_counts(cases: DataFrame) -> DataFrame:
    """status, n for every state, zero too."""
    states = cases.sparkSession.createDataFrame([(s,) for s in CASE_STATES], "status string")
    return F.broadcast(states).join(cases.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def task_stats(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("report").isNotNull()).alias("with_report"))


def capture_loss(beats: DataFrame, per: Sequence[str] = ("sensor_id",)) -> DataFrame:
    out = beats.groupBy(*per).agg(F.sum("received").alias("received"), F.sum("dropped").alias("dropped"))
    return out.withColumn("rate", F.when(F.col("received") > 0, F.col("dropped") / F.col("received")))


def triage_quality(cases: DataFrame) -> DataFrame:
    """One row over cases (status, disposition, created_us, closed_us): closed, escalated and false-positive shares, mean and median time to close in seconds."""
    took = F.col("closed_us") - F.col("created_us")
    (median,) = quantiles(cases.select(took.alias("took")), "took", [0.5])
    closed = F.count_if(F.col("status") == "closed")
    return cases.agg(
        F.count(F.lit(1)).alias("n_cases"), closed.alias("n_closed"), F.try_divide(F.count_if(F.col("status") == "escalated"), F.count(F.lit(1))).alias("escalation_rate"),
        F.try_divide(F.count_if((F.col("status") == "closed") & (F.col("disposition") == "false_positive")), closed).alias("false_positive_rate"), F.avg(took / 1_000_000).alias("mean_s"), (F.lit(median).cast("double") / 1_000_000).alias("median_s"),
    )


def verdicts_by_score(scored: DataFrame, buckets: int = 10, score: str = "prob") -> DataFrame:
    return scored.groupBy(F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("disposition") == "false_positive").alias("n_false"))


def latency_p95(delays: DataFrame, delay: str = "delay_us", least: int = 100, bound_us: int = 60_000_000) -> DataFrame:
    """One row: samples, 95th percentile, and whether there are enough and it holds the bound."""
    (p95,) = quantiles(delays, delay, [0.95])
    out = delays.agg(F.count(delay).alias("samples")).withColumn("p95_us", F.lit(p95).cast("double"))
    return out.withColumn("accepted", (F.col("samples") >= least) & (F.col("p95_us") <= bound_us))


def overview(alerts: DataFrame, newest: int = 8) -> DataFrame:
    """The newest alerts, each with the number of all; tie by alert_id."""
    n = alerts.agg(F.count(F.lit(1)).alias("matched"))
    return alerts.orderBy(F.desc("start_us"), "alert_id").limit(newest).join(F.broadcast(n))
