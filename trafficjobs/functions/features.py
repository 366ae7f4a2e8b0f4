"""Array expressions over the packets of a flow: tokens, padding, statistics, rule evidence, augmentation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficjobs.operators.sampling import portable_hash

MAX_LEN, MAX_SIZE, MAX_TIME = 128, 2000, 10.0
# Responder ports that are nothing unusual.
COMMON_PORTS = (22, 25, 53, 80, 110, 143, 389, 443, 445, 993, 995)
# Size of a nearly full packet, few packets, dense median and pause in seconds.
NEAR_MTU, FEW, DENSE, PAUSE = 1400, 4, 0.01, 1.0


def cut_length(sizes: Column, times: Column, max_len: int = MAX_LEN) -> Column:
    return F.least(F.size(sizes), F.size(times), F.lit(max_len))


def tokens(sizes: Column, times: Column, max_len: int = MAX_LEN, max_size: int = MAX_SIZE, max_time: float = MAX_TIME) -> Column:
    """struct(sizes, dirs, times): size min(|x|, max_size) + 1, direction 1 / 2 / 0 for positive / negative / zero, times clipped to 0..max_time."""
    n = cut_length(sizes, times, max_len)
    s, t = F.slice(sizes, 1, n), F.slice(times, 1, n)
    return F.struct(
        F.transform(s, lambda x: F.least(F.abs(x), F.lit(max_size)) + 1).cast("array<int>").alias("sizes"),
        F.transform(s, lambda x: F.when(x > 0, 1).when(x < 0, 2).otherwise(0)).alias("dirs"),
        F.transform(t, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(max_time))).alias("times"),
    )


def padded(encoded: Column, max_len: int = MAX_LEN) -> Column:
    """struct(sizes, dirs, times, mask) filled with zeros on the right to max_len; mask is true for real positions. Pad last, for model input only."""
    n = F.size(encoded["sizes"])
    fill = lambda a, zero: F.concat(a, F.array_repeat(F.lit(zero), F.lit(max_len) - n))
    return F.struct(
        fill(encoded["sizes"], 0).alias("sizes"), fill(encoded["dirs"], 0).alias("dirs"), fill(encoded["times"], 0.0).alias("times"),
        F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(max_len) - n)).alias("mask"),
    )


def long_enough(sizes: Column, times: Column, least: int = 3, rule: str = "before_cut", max_len: int = MAX_LEN) -> Column:
    """The packet minimum; logs test the sizes before they are cut, PPI records the cut length (rule `after_cut`)."""
    return (F.size(sizes) if rule == "before_cut" else cut_length(sizes, times, max_len)) >= least


def to_ppi(sizes: Column, times: Column, max_len: int = 30) -> Column:
    """[times, directions, absolute sizes] as three arrays of doubles."""
    n = cut_length(sizes, times, max_len)
    s = F.slice(sizes, 1, n)
    return F.array(F.slice(times, 1, n).cast("array<double>"), F.transform(s, lambda x: F.signum(x.cast("double"))), F.transform(s, lambda x: F.abs(x).cast("double")))


def parse_ppi(text: Column) -> Column:
    """struct(times, dirs, sizes) from a JSON or literal list of lists, an object under singular or plural names, or three printed rows; else null."""
    listed = F.from_json(F.translate(text, "()", "[]"), "array<array<double>>")
    named = F.from_json(F.translate(text, "'()", '"[]'), "iat array<double>, iats array<double>, dir array<double>, dirs array<double>, size array<double>, sizes array<double>")
    rows = F.transform(F.regexp_extract_all(F.regexp_replace(text, r"^\s*\[\s*\[", "["), F.lit(r"\[([^\[\]]*)\]")), lambda r: F.transform(F.split(F.trim(r), r"[\s,]+"), lambda x: x.try_cast("double")))
    three = lambda a: F.struct(a[0].alias("times"), a[1].alias("dirs"), a[2].alias("sizes"))
    whole = lambda a: a.isNotNull() & (F.size(a) >= 3) & ~F.exists(a, lambda r: r.isNull() | F.exists(r, lambda x: x.isNull()))
    field = lambda x, k: F.coalesce(x[f"{k}s"], x[k])
    from_object = lambda x: F.when(field(x, "iat").isNotNull() & field(x, "dir").isNotNull() & field(x, "size").isNotNull(), F.struct(field(x, "iat").alias("times"), field(x, "dir").alias("dirs"), field(x, "size").alias("sizes")))
    of_lists = lambda x: F.when(whole(x), three(x))
    # as the one item of an array a text is parsed once, not for every use of what it holds
    once = lambda a, read: F.transform(F.array(a), read)[0]
    return F.when(F.ltrim(text).startswith("{"), once(named, from_object)).otherwise(F.coalesce(once(listed, of_lists), once(rows, of_lists)))


def ppi_sample(ppi: Column, max_len: int = MAX_LEN, max_size: int = MAX_SIZE, max_time: float = MAX_TIME) -> Column:
    """Signed whole sizes of a parsed PPI record as tokens; null if an item is missing."""
    bad = lambda a: a.isNull() | F.exists(a, lambda x: x.isNull() | F.isnan(x))
    signed = F.zip_with(ppi["sizes"], ppi["dirs"], lambda s, d: F.signum(d).cast("int") * F.abs(s).cast("int"))
    return F.when(~(bad(ppi["times"]) | bad(ppi["dirs"]) | bad(ppi["sizes"])), tokens(signed, ppi["times"], max_len, max_size, max_time))


def time_stats(times: Column) -> Column:
    """struct(min, max, mean, median), zeros for an empty array."""
    n, ordered = F.size(times), F.array_sort(times)
    middle = (F.element_at(ordered, (F.floor((n + 1) / 2)).cast("int")) + F.element_at(ordered, (F.floor(n / 2) + 1).cast("int"))) / 2
    some = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    total = F.aggregate(times, F.lit(0.0), lambda a, x: a + x)
    return F.struct(some(F.array_min(times)).alias("min"), some(F.array_max(times)).alias("max"), some(total / n).alias("mean"), some(middle).alias("median"))


def direction_counts(sizes: Column) -> Column:
    of = lambda test: F.size(F.filter(sizes, test))
    return F.struct(of(lambda x: x > 0).alias("out"), of(lambda x: x < 0).alias("back"), of(lambda x: x == 0).alias("zero"))


def preview(values: Column, n: int = 16, digits: int | None = None) -> Column:
    first = F.slice(values, 1, n)
    return first if digits is None else F.transform(first, lambda x: F.round(x, digits))


def rule_evidence(sizes: Column, times: Column, responder_port: Column) -> Column:
    """Codes of the rules that hold, in order. The first, the counts, always does."""
    stats, n = time_stats(times), F.size(sizes)
    rules = [
        (F.lit(True), "counts"),
        (F.exists(sizes, lambda x: F.abs(x) >= NEAR_MTU), "near_mtu"),
        (n <= FEW, "few_packets"),
        ((stats["median"] < DENSE) & (n > FEW), "dense_times"),
        (stats["max"] >= PAUSE, "long_pause"),
        (~responder_port.isin(*COMMON_PORTS), "unusual_port"),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for test, code in rules)))


def _uniform(id_: Column, i: Column, salt: str, seed: int) -> Column:
    return (F.pmod(portable_hash(id_, i, salt, seed), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def noisy_times(times: Column, id_: Column, seed: int = 42, deviation: float = 0.005, max_time: float = MAX_TIME) -> Column:
    """Times with normal noise, clipped."""
    noise = lambda i: F.sqrt(-2 * F.log(_uniform(id_, i, "r", seed))) * F.cos(2 * math.pi * _uniform(id_, i, "a", seed)) * deviation
    return F.transform(times, lambda x, i: F.least(F.greatest(x + noise(i), F.lit(0.0)), F.lit(max_time)))


def augment(encoded: Column, id_: Column, seed: int = 42, drop: float = 0.15, deviation: float = 0.005, max_time: float = MAX_TIME) -> Column:
    """A noisy copy: with probability drop a size and direction become 0; times are noisy_times. The same row always gives the same copy."""
    gone = F.transform(encoded["sizes"], lambda _, i: _uniform(id_, i, "drop", seed) < drop)
    kept = lambda values, out: F.zip_with(values, out, lambda x, o: F.when(o, 0).otherwise(x))
    # as the one item of an array what is drawn is drawn once, for sizes and directions
    once = lambda out: F.struct(kept(encoded["sizes"], out).alias("sizes"), kept(encoded["dirs"], out).alias("dirs"), noisy_times(encoded["times"], id_, seed, deviation, max_time).alias("times"))
    return F.transform(F.array(gone), once)[0]


def seconds(micros: Column) -> Column:
    return F.transform(micros, lambda x: x / F.lit(1_000_000.0))


def encode(flows: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """flows with the column encoded, from sizes and offsets_us."""
    return flows.withColumn("encoded", tokens(F.col("sizes"), seconds(F.col("offsets_us")), max_len))
