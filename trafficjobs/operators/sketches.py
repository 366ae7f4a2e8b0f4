"""Quantiles and distinct counts: exact by counted ranges, and by sketches that later batches add to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficjobs.session import materialize

#: Ranges that a round of exact selection counts.
RANGES = 4096
#: Size of quantile sketches, and the error in rank that they keep with a chance of 99 %.
KLL_K, RANK_ERROR = 200, 0.0165
#: Size of distinct sketches as a power of two, and the relative error that they keep with a chance of 99.7 %.
THETA_LG, DISTINCT_ERROR = 12, 3 / 2**6
_HOUR = 3_600_000_000


def _selected(rows: DataFrame, rank: int, lo: int, hi: int) -> int:
    """The value of that rank, from 0, among whole numbers x from lo to hi. Each round keeps the range that holds the rank."""
    below, all_ = 0, rows
    while lo < hi:
        width = -(-(hi - lo + 1) // RANGES)
        counts = rows.groupBy(F.expr(f"(x - {lo}L) div {width}L").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # at most RANGES rows
        for r in counts:
            if below + r.n > rank:
                lo, hi = lo + r.b * width, min(hi, lo + (r.b + 1) * width - 1)
                break
            below += r.n
        rows = all_.where(F.col("x").between(lo, hi))
    return lo


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a whole-number column with linear interpolation; null for a table without values.

    No task holds the values: a round counts them in RANGES equal ranges and goes on in one of these, so that two or three
    rounds do for times of days in microseconds, and a value that most rows have is one count. Null values do not count; the
    values must span less than 2^63.
    """
    rows = materialize(df.select(F.col(column).cast("long").alias("x")).where("x is not null"), "values")
    n, lo, hi = rows.agg(F.count("x"), F.min("x"), F.max("x")).first()
    out: list[float | None] = []
    for share in shares:
        if not n:
            out.append(None)
            continue
        at = (n - 1) * share
        value = _selected(rows, int(at), lo, hi)
        if at > int(at):
            up_to, after = rows.agg(F.count_if(F.col("x") <= value), F.min(F.when(F.col("x") > value, F.col("x")))).first()
            after = value if up_to > int(at) + 1 else after
            out.append((int(at) + 1 - at) * value + (at - int(at)) * after)
        else:
            out.append(float(value))
    return out


def quantile_sketches(rows: DataFrame, column: str, time: str, per: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """per, hour_us, n, sketch: a mergeable sketch of a whole-number column for each group and hour. Append it to a table, batch by batch; null values do not count."""
    hour = (F.col(time) - F.pmod(F.col(time), F.lit(_HOUR))).alias("hour_us")
    return rows.where(F.col(column).isNotNull()).groupBy(*per, hour).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(column).cast("long"), KLL_K).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, shares: Sequence[float], per: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """per, n and q0, q1, ... for each share, from all sketches of a group, whatever batch they come from. Their ranks are off by RANK_ERROR of n at most, nearly always."""
    merged = sketches.groupBy(*per).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(*per, "n", *(F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(s))).alias(f"q{k}") for k, s in enumerate(shares)))


def distinct_sketches(rows: DataFrame, column: str, per: Sequence[str]) -> DataFrame:
    """per, sketch: for each group a sketch of the distinct values of a column; sketches of batches and groups can be united and intersected."""
    return rows.where(F.col(column).isNotNull()).groupBy(*per).agg(F.theta_sketch_agg(column, THETA_LG).alias("sketch"))


def distinct_of_all(sketches: DataFrame) -> DataFrame:
    """One row, n: the distinct values of all groups together, within DISTINCT_ERROR of it nearly always."""
    return sketches.agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", THETA_LG)).alias("n"))


def met_again(sketches: DataFrame, per: str, step: int = 1) -> DataFrame:
    """per, n, n_again: distinct values of each group of whole number, and how many of them the group a step before had. The error of n_again is DISTINCT_ERROR of both groups together."""
    one = sketches.groupBy(per).agg(F.theta_union_agg("sketch", THETA_LG).alias("sketch"))
    before = one.select((F.col(per) + step).alias(per), F.col("sketch").alias("before"))
    joined = one.join(before, per, "left")
    again = F.coalesce(F.theta_sketch_estimate(F.theta_intersection("sketch", "before")), F.lit(0))
    return joined.select(per, F.theta_sketch_estimate("sketch").alias("n"), again.alias("n_again"))
