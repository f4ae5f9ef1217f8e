"""The table contract, its readers, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = (
    "demand",
    "demand_reg",
    "demand_unreg",
    "buy_contract",
    "buy_contract_reg",
    "sell_contract",
    "buy_spot",
    "sell_spot",
    "buy_auction",
)

HOURLY = T.StructType(
    [T.StructField("agent_id", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
)
AGENTS = T.StructType([T.StructField(c, T.StringType()) for c in ("agent_id", "name", "activity")])
PRICES = T.StructType(
    [T.StructField("day", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("contract", "spot", "scarcity")]
)
RESERVOIRS = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("useful_volume", T.DoubleType()),
        T.StructField("useful_capacity", T.DoubleType()),
    ]
)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 64,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Parallel JDBC scan, split on a time or numeric column.

    Without ``column`` and ``bounds`` the scan is a single task, which suits the
    small dimension and price tables only.
    """
    reader = spark.read.format("jdbc").option("url", url)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if column and bounds:
        reader = (
            reader.option("dbtable", f"({query}) src")
            .option("partitionColumn", column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    else:
        reader = reader.option("query", query)
    return reader.load()


def run_query(spark: SparkSession, text: str, **named) -> DataFrame:
    """One SQL statement with named parameters (``:start``) bound by value."""
    return spark.sql(text, args=named or None)


def between(facts: DataFrame, start: date | str, end: date | str, column: str = "ts") -> DataFrame:
    """Half-open time filter on the raw column, so that it reaches the scan."""
    return within(facts, [(start, end)], column)


def within(facts: DataFrame, spans: list[tuple[date, date]], column: str = "ts") -> DataFrame:
    """``between`` for any of a few half-open spans; those that overlap or touch are one."""
    stamp = facts.schema[column].dataType
    merged: list[tuple[str, str]] = []
    for start, end in sorted((str(a), str(b)) for a, b in spans):
        if merged and start <= merged[-1][1]:
            start, end = merged[-1][0], max(end, merged.pop()[1])
        merged.append((start, end))
    inside = [
        (F.col(column) >= F.lit(start).cast(stamp)) & (F.col(column) < F.lit(end).cast(stamp))
        for start, end in merged
    ]
    return facts.where(reduce(or_, inside))


def workspace(spark: SparkSession) -> str:
    """Shared folder for durable intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Stored tables of the run that is under way, if one is.
_RUN: ContextVar[list[str] | None] = ContextVar("stored_tables", default=None)


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what was stored within; save results before.

    Runs may be nested or go on side by side: each deletes its own tables only.
    """
    paths: list[str] = []
    token = _RUN.set(paths)
    try:
        yield paths
    finally:
        _RUN.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def durable(df: DataFrame, label: str, folder: str | None = None, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner the
    true size of the table, so that later joins broadcast it only when it really
    is under the broadcast threshold. ``options`` go to the parquet writer.
    """
    spark = df.sparkSession
    path = f"{(folder or workspace(spark)).rstrip('/')}/peerglass/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if (run := _RUN.get()) is not None:
        run.append(path)
    return spark.read.schema(df.schema).parquet(path)
