"""Writers. Each refuses to overwrite unless it says so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficjobs.functions.features import to_ppi


def ppi_rows(samples: DataFrame, app: str | None = None, max_len: int = 30) -> DataFrame:
    """PPI as text of a list of lists, APP and SOURCE, of samples (sizes, times, app, source)."""
    return samples.select(F.to_json(to_ppi(F.col("sizes"), F.col("times"), max_len)).alias("PPI"), (F.lit(app) if app else F.col("app")).alias("APP"), F.col("source").alias("SOURCE"))


def write_ppi(samples: DataFrame, path: str, app: str | None = None, mode: str = "errorifexists") -> None:
    ppi_rows(samples, app).write.mode(mode).partitionBy("APP").option("header", "true").option("escape", '"').csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """Append one compact JSON object a line, by event type."""
    events.write.mode("append").partitionBy("event_type").json(path)


def write_knowledge_index(vectors: DataFrame, metadata: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").json(path)


def latest_status(status: DataFrame) -> DataFrame:
    """The newest row (by observed_us, event_id) of each sensor."""
    return status.groupBy("sensor_id").agg(F.max_by(F.struct(*status.columns), F.struct("observed_us", "event_id")).alias("s")).select("s.*")


def write_status(status: DataFrame, path: str) -> None:
    latest_status(status).write.mode("overwrite").json(path)


def assemble_experiment(local: DataFrame, malware: DataFrame, names: list[str], external: DataFrame | None = None) -> DataFrame:
    """PPI rows of local benign, chosen malware sources and external benign records."""
    out = ppi_rows(local, "benign").unionByName(ppi_rows(malware.where(F.col("source").isin(*names)), "malware"))
    return out if external is None else out.unionByName(external.withColumn("APP", F.lit("benign")), allowMissingColumns=True)


def labelled_union(malicious: DataFrame, benign: DataFrame) -> DataFrame:
    return malicious.withColumn("label", F.lit(1)).unionByName(benign.withColumn("label", F.lit(0)))
