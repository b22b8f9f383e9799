"""All queries and their SQL. A query is registered with its SQL beside it; some have none and are tested by brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrubline.plans.ship import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TEXTS = ("documents", "conversations")  # work on these costs far more than reading them


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files are smaller than a split for each core, as a few row groups would keep most cores
    idle: small tables only, large ones are left as they are. Columns and filters still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * (32 << 20) else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in TEXTS else df


def checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir where the context has none yet; a local session without
    that setting has one in its warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable], Callable]:
    """Register f(t), where t(name) reads a table."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda table: read(spark, sf_dir, table))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add
