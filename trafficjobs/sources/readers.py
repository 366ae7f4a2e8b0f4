"""Readers of logs, records and knowledge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficjobs.functions import features
from trafficjobs.operators.flows import parse_vector
from trafficjobs.session import materialize, small

# Columns of a connection log without a header.
CONN_COLUMNS = (
    "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes conn_state local_orig local_resp "
    "missed_bytes history orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes tunnel_parents"
).split()
WRAPPERS = ("alerts", "events", "items", "data")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("_path"))


def flow_logs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated flow logs: ts, uid, endpoints, signed sizes and times as arrays (null if malformed) and source; rows of fewer than eight fields and comments are dropped."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", f).where(F.size("f") >= 8)
    at = lambda i, name, kind="string": F.col("f")[i].try_cast(kind).alias(name)
    return rows.select(at(0, "ts", "double"), at(1, "uid"), at(2, "orig_h"), at(3, "orig_p", "int"), at(4, "resp_h"), at(5, "resp_p", "int"), parse_vector(F.col("f")[6], "int").alias("sizes"), parse_vector(F.col("f")[7]).alias("times"), "source")


def ppi(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """PPI records of csv or jsonl files, gzip too: record, struct of three arrays or null, app and source. Invalid JSON lines are dropped."""
    if kind == "csv":
        rows = spark.read.option("recursiveFileLookup", "true").option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
        name = lambda n: next((F.col(f"`{c}`") for c in (n, n.lower()) if c in rows.columns), F.lit(None).cast("string"))
        return rows.select(features.parse_ppi(name("PPI")).alias("record"), name("APP").alias("app"), name("SOURCE").alias("source"))
    text = _lines(spark, path).withColumn("j", F.try_parse_json("value")).where(F.col("j").isNotNull())
    field = lambda n: F.coalesce(F.get_json_object("value", f"$.{n}"), F.get_json_object("value", f"$.{n.lower()}"))
    return text.select(features.parse_ppi(field("PPI")).alias("record"), field("APP").alias("app"), F.coalesce(field("SOURCE"), F.col("source")).alias("source"))


def conn_logs(spark: SparkSession, path: str) -> DataFrame:
    """Connection logs as maps of texts, by each file's #fields line or the default columns; short rows are filled with empty texts."""
    lines = _lines(spark, path)
    heads = lines.where(F.col("value").startswith("#fields")).groupBy("_path").agg(F.first(F.filter(F.split("value", "\t"), lambda _, i: i > 0)).alias("names"))
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    default = F.array(*(F.lit(c) for c in CONN_COLUMNS))
    out = rows.join(small(materialize(heads, "heads")), "_path", "left").withColumn("names", F.coalesce("names", default)).withColumn("f", F.split("value", "\t"))
    short = F.greatest(F.lit(0), F.size("names") - F.size("f"))
    return out.select(F.map_from_arrays("names", F.slice(F.concat("f", F.array_repeat(F.lit(""), short)), F.lit(1), F.size("names"))).alias("fields"), "source")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw lines that hold JSON; blank and malformed ones are dropped. For IDS events and SIEM alerts."""
    return _lines(spark, path).where(F.try_parse_json("value").isNotNull()).select(F.col("value").alias("raw"), "source")


def ids_events(spark: SparkSession, path: str) -> DataFrame:
    schema = "timestamp string, event_type string, src_ip string, dest_ip string, alert struct<signature:string,severity:int>"
    return json_lines(spark, path).withColumn("r", F.from_json("raw", schema)).select("r.*", "raw")


def _documents(spark: SparkSession, path: str) -> list[str]:
    """Files that are one JSON document: their first line with text begins an object or list, but is no object by itself."""
    lines = _lines(spark, path).where(F.trim("value") != "").select("_path", "value", F.monotonically_increasing_id().alias("no"))
    heads = lines.groupBy("_path").agg(F.min_by("value", "no").alias("head"))
    object_ = F.ltrim("head").startswith("{") & F.try_parse_json("head").isNotNull()
    return [r._path for r in heads.where(~object_ & F.regexp_like("head", F.lit(r"^\s*[\[{]"))).select("_path").collect()]


def alert_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects (raw) of files that are one JSON document or JSON lines, unwrapped from alerts, events, items or data; and one row with the number of invalid lines.

    Lines are read in splits. A file whose first line begins an object or list that it does not end is read as a whole; if it
    is no JSON document then, its lines count.
    """
    documents = _documents(spark, path)
    lines = _lines(spark, path).where(F.trim("value") != "").select("_path", "source", F.col("value").alias("raw"))
    if documents:
        whole = spark.read.text(documents, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source"), F.col("value").alias("raw"))
        whole = materialize(whole.where(F.try_parse_json("raw").isNotNull()), "documents")
        lines = lines.join(small(whole.select("_path")), "_path", "left_anti").unionByName(whole)
    lines = lines.withColumn("ok", F.try_parse_json("raw").isNotNull())
    inner = F.coalesce(*(F.from_json(F.get_json_object("raw", f"$.{k}"), "array<string>") for k in WRAPPERS), F.when(F.ltrim("raw").startswith("["), F.from_json("raw", "array<string>")), F.array("raw"))
    objects = lines.where("ok").select(F.explode(inner).alias("raw"), "source").where(F.ltrim("raw").startswith("{"))
    return objects, lines.agg(F.count_if(~F.col("ok")).alias("invalid"))


def unwrap_sensor_event(raw: Column, paths: Sequence[str] = ("$.data", "$.data.sensor")) -> Column:
    """The record itself or what is at the first of the paths in it, whichever first has an event_type."""
    inner = [raw, *(F.get_json_object(raw, p) for p in paths)]
    return F.coalesce(*(F.when(F.get_json_object(x, "$.event_type").isNotNull(), x) for x in inner))


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    texts, lists = ("title", "content", "recommendation", "severity_hint", "false_positive_notes"), ("tags", "evidence_required", "recommended_queries")
    schema = ", ".join([*(f"{t} string" for t in texts), *(f"{x} array<string>" for x in lists)])
    return spark.read.schema(schema).json(path).select(*(F.coalesce(t, F.lit("")).alias(t) for t in texts), *(F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in lists))


def closed_captures(spark: SparkSession, path: str, rotate_s: int, now_us: int | None = None) -> DataFrame:
    """Files of a spool folder, oldest first, without the newest unless it rested for rotate_s + 1 seconds: path, modified_us."""
    files = spark.read.format("binaryFile").load(path).select("path", F.unix_micros("modificationTime").alias("modified_us"))
    now = F.lit(now_us) if now_us is not None else F.unix_micros(F.current_timestamp())
    newest = files.agg(F.max_by("path", F.struct("modified_us", "path")).alias("newest"))
    rested = now - F.col("modified_us") > (rotate_s + 1) * 1_000_000
    return files.join(F.broadcast(newest)).where((F.col("path") != F.col("newest")) | rested).orderBy("modified_us", "path").drop("newest")
