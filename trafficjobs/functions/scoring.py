"""Scores of flows and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Risk levels from these scores on.
LEVELS = ((0.9, "high"), (0.7, "medium"), (0.5, "low"))
NAMES = ("high", "medium", "low", "informational", "unknown")


class LogisticScorer:
    """Default scorer: a logistic function of four sums over a flow. Any object with score(frame) -> probabilities can take its place."""

    def __init__(self, weights: tuple[float, ...] = (-1.0, 0.002, -0.05, 0.3, 0.8)):
        self.weights = weights

    def score(self, frame: pd.DataFrame) -> np.ndarray:
        n = frame["sizes"].map(len).to_numpy(dtype=np.int64)
        sizes = np.concatenate([np.zeros(0), *frame["sizes"]])
        of = np.repeat(np.arange(len(n)), n)
        mean, back = (np.bincount(of, x, len(n)) / np.maximum(n, 1) for x in (np.abs(sizes), sizes < 0))
        offsets, ends = np.concatenate([np.zeros(0), *frame["offsets_us"]]), np.cumsum(frame["offsets_us"].map(len).to_numpy(dtype=np.int64))
        last = np.diff(ends, prepend=0) > 0
        span = np.zeros(len(n))
        span[last] = offsets[ends[last] - 1] / 1e6
        w = self.weights
        return 1 / (1 + np.exp(-(w[0] + w[1] * mean + w[2] * n + w[3] * back + w[4] * np.log1p(span))))


def score_flows(flows: DataFrame, scorer: Callable | object | None = None, column: str = "probability") -> DataFrame:
    """flows with a probability for each, scored in Arrow batches."""
    scorer = scorer or LogisticScorer()
    names = [c for c in flows.columns if c != column]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{column: scorer.score(frame)})

    return flows.select(*names).mapInPandas(run, flows.select(*names, F.lit(0.0).alias(column)).schema)


def risk_level(score: Column) -> Column:
    """high, medium, low or informational; unknown where the score is null or no number."""
    number = score.try_cast("double")
    out = F.when(number.isNull() | F.isnan(number), F.lit("unknown"))
    for least, name in LEVELS:
        out = out.when(number >= least, F.lit(name))
    return out.otherwise(F.lit("informational"))


def predicted(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)


def predicted_by_classes(benign: Column, malicious: Column) -> Column:
    """The class of the greater probability; a tie is benign."""
    return F.when(malicious > benign, 1).otherwise(0)


def top_candidates(scored: DataFrame, n: int, threshold: float = 0.5, score: str = "prob", ties: tuple[str, ...] = (), per: tuple[str, ...] = ()) -> DataFrame:
    """The n best rows of at least the threshold, over all or in each group of `per`, ties by the columns `ties`."""
    kept = scored.where(F.col(score) >= threshold)
    order = [F.desc(score), *(F.col(t) for t in ties)]
    if not per:
        return kept.orderBy(*order).limit(n)
    return kept.withColumn("_rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def run_summary(scored: DataFrame, threshold: float = 0.5, reported: int = 10, score: str = "prob") -> DataFrame:
    """One row: total, at least the threshold, reported of those, greatest score (0 if none), and a count for every level."""
    level = risk_level(F.col(score))
    above = F.count_if(F.col(score) >= threshold)
    return scored.agg(
        F.count(F.lit(1)).alias("total"), above.alias("above"), F.least(above, F.lit(reported)).alias("reported"), F.coalesce(F.max(score), F.lit(0.0)).alias("max_probability"),
        *(F.count_if(level == name).alias(f"n_{name}") for name in NAMES),
    )


def compare_producers(left: DataFrame, right: DataFrame, identity: tuple[str, ...], same: tuple[str, ...], score: str = "prob", tolerance: float = 1e-5) -> DataFrame:
    """One row: pairs, rows of one side only, unequal columns, greatest score error, and whether the sides agree.

    Rows that share an identity are paired in the order of their values.
    """
    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("_no", F.row_number().over(Window.partitionBy(*identity).orderBy(*same, score)))

    a, b = numbered(left).alias("a"), numbered(right).alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*identity, "_no")]
    both = a.join(b, on, "full_outer")
    paired = F.col("a._no").isNotNull() & F.col("b._no").isNotNull()
    error = F.abs(F.col(f"a.{score}") - F.col(f"b.{score}"))
    out = both.agg(
        F.count_if(paired).alias("pairs"), F.count_if(~paired).alias("one_sided"), *(F.count_if(paired & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"unequal_{c}") for c in same),
        F.coalesce(F.max(F.when(paired, error)), F.lit(0.0)).alias("max_error"),
    )
    clean = F.col("one_sided") == 0
    for c in same:
        clean &= F.col(f"unequal_{c}") == 0
    return out.withColumn("agree", clean & (F.col("max_error") <= tolerance))
