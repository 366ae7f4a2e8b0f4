"""Analyst cases, reports and their quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.operators.correlate import CASE_STATES, SOURCES
from trafficjobs.session import materialize, small

# What a complete report mentions.
CHECKS = {
    "ai_alert_summary": (("alerts",), ("alert", "model", "AI 告警", "模型")),
    "wazuh_evidence": (("siem",), ("wazuh", "告警")),
    "network_context": (("conn", "ids"), ("zeek", "suricata", "连接", "上下文")),
    "rag_basis": (("knowledge",), ("rag", "知识", "playbook", "依据")),
    "limitations": ((), ("误报", "局限", "风险线索", "不能直接", "人工复核")),
}


def apply_decisions(cases: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases after their last valid decision (by decided_us, seq), and the rejected decisions.

    A decision sets status, disposition, owner and reason; closed_us is its time if it closes the case, else null. Of valid
    decisions alike in both, the one of the greatest status, disposition, owner and reason counts, in any order of rows.
    """
    valid = F.coalesce(F.col("status").isin(*CASE_STATES), F.lit(False))
    last = decisions.where(valid).groupBy("case_id").agg(F.max_by(F.struct("status", "disposition", "owner", "reason", "decided_us"), F.struct("decided_us", "seq", "status", "disposition", "owner", "reason")).alias("d"))
    out = cases.join(last, "case_id", "left")
    has = F.col("d").isNotNull()
    return out.select(
        "case_id", "alert_key", F.when(has, F.col("d.status")).otherwise(F.col("status")).alias("status"), F.col("d.disposition").alias("disposition"), F.col("d.owner").alias("owner"), F.col("d.reason").alias("reason"),
        "created_us", F.coalesce("d.decided_us", "created_us").alias("updated_us"), F.when(F.col("d.status") == "closed", F.col("d.decided_us")).alias("closed_us"),
    ), decisions.where(~valid)


def timeline(cases: DataFrame) -> DataFrame:
    """case_id, step, at_us: created; owned; decided; closed, as far as they took place."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    step = lambda name, at: F.struct(F.lit(name).alias("step"), F.col(at).alias("at_us"))
    steps = [step("created", "created_us"), F.when(filled("owner"), step("owned", "updated_us")), F.when(filled("disposition") | filled("reason"), step("decided", "updated_us")), F.when(F.col("closed_us").isNotNull(), step("closed", "closed_us"))]
    return cases.select("case_id", F.inline(F.array_compact(F.array(*steps))))


def task_lifecycle(events: DataFrame) -> DataFrame:
    """Of task events (task_id, status, at_us, report): the latest status, time queued and time running, and whether there is a report."""
    at = lambda s: F.min(F.when(F.col("status").isin(*s), F.col("at_us")))
    out = events.groupBy("task_id").agg(F.max_by("status", "at_us").alias("status"), at(["queued"]).alias("_q"), at(["running"]).alias("_r"), at(["succeeded", "failed"]).alias("_e"), F.max(F.col("report").isNotNull()).alias("has_report"))
    return out.select("task_id", "status", (F.col("_r") - F.col("_q")).alias("queued_us"), (F.col("_e") - F.col("_r")).alias("running_us"), "has_report")


def compact_events(events: DataFrame, per: Sequence[str] = (), ranges: int = 1024) -> DataFrame:
    """rank from 1 by falling prob, ties by alert_id; probability of four digits, endpoints as ip:port. Without `per` all events are one list.

    Ranks are counts of the higher ranges of prob plus the rank in the own range, so that a long list is no single task.
    Events without a prob come last.
    """
    rows = events.withColumn("_range", F.coalesce(-F.floor(F.col("prob") * ranges), F.lit(1)))
    counts = rows.groupBy(*per, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*per).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = (*per, "_range")
    counts = materialize(counts.select(*(F.col(c).alias(f"_key_{c}") for c in keys), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")), "range-counts")
    rows = rows.join(small(counts), [rows[c].eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("prob"), "alert_id")) + F.col("_before")
    end = lambda k: F.concat_ws(":", f"{k}_ip", F.col(f"{k}_port").cast("string")).alias(k)
    return rows.select(*per, "alert_id", rank.cast("int").alias("rank"), F.round("prob", 4).alias("probability"), end("src"), end("dst"))


def event_block() -> Column:
    """The lines of one event."""
    return F.format_string("### Event %d: %s -> %s\n\n- Risk: %s\n- Probability: %.4f\n- Alert: %s", "rank", "src", "dst", "risk", "probability", "alert_id")


def rule_report(events: DataFrame, run: str = "run_id", knowledge: DataFrame | None = None, most: int = 50) -> DataFrame:
    """run, markdown: totals of all events, a block for each of the first `most` in order of rank, knowledge titles, fixed actions and limits."""
    block = F.when(F.col("rank") <= most, F.struct("rank", event_block().alias("block")))
    blocks = events.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.max("probability").alias("top"), F.count_if(F.col("risk") == "high").alias("n_high"), F.transform(F.sort_array(F.collect_list(block)), lambda x: x["block"]).alias("blocks")
    )
    if knowledge is not None:
        blocks = blocks.join(knowledge.groupBy(run).agg(F.array_sort(F.collect_set("title")).alias("titles")), run, "left")
    else:
        blocks = blocks.withColumn("titles", F.array().cast("array<string>"))
    head = F.format_string("# Traffic triage report\n\n%d candidates, %d of high risk, highest probability %.4f.\n\n## Candidates\n\n", "n", "n_high", "top")
    known = F.concat(F.lit("\n\n## Knowledge\n\n"), F.array_join(F.transform(F.coalesce("titles", F.array().cast("array<string>")), lambda t: F.concat(F.lit("- "), t)), "\n"))
    tail = F.lit("\n\n## Actions\n\n- Review neighbouring connections of both hosts in the time window.\n- Check who owns the destination.\n\n## Limits\n\nA probability is a lead, no verdict; 误报 need manual review.\n")
    return blocks.select(run, F.concat(head, F.array_join("blocks", "\n\n"), known, tail).alias("markdown"))


def quality_checks(reports: DataFrame) -> DataFrame:
    """reports (markdown and the counts n_<source>) with passed_<check>, status and missing."""
    text = F.lower("markdown")
    tests = {}
    for name, (sources, words) in CHECKS.items():
        said = F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(text, w))
        there = F.lit(not sources)
        for s in sources:
            there |= F.coalesce(F.col(f"n_{s}"), F.lit(0)) > 0
        tests[name] = F.coalesce(said & there, F.lit(False))
    out = reports.withColumns({f"passed_{n}": t for n, t in tests.items()})
    missing = F.array_compact(F.array(*(F.when(~F.col(f"passed_{n}"), F.lit(n)) for n in tests)))
    return out.withColumn("missing", missing).withColumn("status", F.when(F.size("missing") == 0, "complete").otherwise("incomplete"))


def bundle_summary(bundle: DataFrame, sources: Sequence[str] = SOURCES, keep: Sequence[Column] = ()) -> DataFrame:
    """alert_id with the number of rows of each source, what is missing, and as errors the sources that could not be asked: their column is null. keep adds columns."""
    names = lambda test: F.array_compact(F.array(*(F.when(test(F.col(s)), F.lit(s)) for s in sources)))
    return bundle.select("alert_id", *keep, *(F.coalesce(F.size(s), F.lit(0)).alias(f"n_{s}") for s in sources), names(lambda c: F.coalesce(F.size(c), F.lit(0)) == 0).alias("missing"), names(lambda c: c.isNull()).alias("errors"))
