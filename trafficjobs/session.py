"""Session with the settings the jobs expect."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a broadcast table at most, and bytes by the measured width of its values.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Paths that materialize has written: those of the process, inside tables() those of the scope.
_written: ContextVar[list[str]] = ContextVar("written", default=[])


def build(app: str = "trafficjobs", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow on. Keyword names use two underscores for dots: spark__sql__shuffle__partitions="8"."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for name, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset, as in tests, in a new local folder; not on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder, with a folder for each value of by, and read it back. It survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    _written.get().append(path)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tables() -> Iterator[list[str]]:
    """The paths that materialize writes inside, so that those of one result can be dropped alone. What is not dropped counts to the scope around."""
    own: list[str] = []
    token = _written.set(own)
    try:
        yield own
    finally:
        _written.reset(token)
        _written.get().extend(own)


def drop_tables(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete those tables that materialize has written, without paths all of the scope or process; their number.

    For when what reads them has been written itself.
    """
    hadoop, known = spark.sparkContext._jsc.hadoopConfiguration(), _written.get()
    gone = list(known if paths is None else paths)
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
    known[:] = [p for p in known if p not in set(gone)]
    return len(gone)


def _bytes(field: T.StructField) -> Column | int:
    """Bytes of a value, as a number where its type fixes them."""
    value, varied = F.col("`" + field.name.replace("`", "``") + "`"), (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        found = F.octet_length(value)
    elif isinstance(field.dataType, T.ArrayType) and not isinstance(field.dataType.elementType, varied):
        found = F.size(value) * 8
    elif isinstance(field.dataType, varied):
        found = F.octet_length(F.to_json(F.struct(value)))
    else:
        return 8
    return F.coalesce(found, F.lit(0)).cast("long") + 8


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most that many rows and bytes, else df as it is. Give it a materialized df.

    Both are summed where the rows are; values whose type fixes their width are counted but not read.
    """
    widths = [_bytes(f) for f in df.schema.fields]
    fixed, varied = sum(w for w in widths if isinstance(w, int)), [w for w in widths if not isinstance(w, int)]
    total = F.sum(sum(varied[1:], varied[0])) if varied else F.lit(0)
    n, read = df.agg(F.count(F.lit(1)), total).first()
    return F.broadcast(df) if n <= rows and n * fixed + (read or 0) <= size else df
