"""Reading tables and materialising intermediate results where every executor can see them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scrubline.plans.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir where the context has none yet."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile  # one machine: its own folder is shared

            shared = tempfile.mkdtemp(prefix="scrubline-")
        context.setCheckpointDir(shared)
    return context._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    return f"{_checkpoints(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
