"""Resuming, caching and isolating work on single rows, on tables instead of locks and threads."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def response_key(step: Column, model: Column, version: Column, temperature: Column, prompt: Column) -> Column:
    """SHA-256 over the lines step, model, version, temperature to three places, prompt."""
    return F.sha2(F.concat_ws("\n", step, model, version, F.format_string("%.3f", temperature.cast("double")), prompt), 256)


def run_stage(items: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, version: str, model: str, key: str = "item_id") -> DataFrame:
    """Results of all items. Those done before for this version and model aren't worked on again; new ones are appended
    to the table at path. Repeated keys are worked on once; items with a null key are left out."""
    spark = items.sparkSession
    todo = items.where(F.col(key).isNotNull()).dropDuplicates([key])
    same = (F.col("prompt_version") == version) & (F.col("model") == model)
    done = read_or_none(spark, path)
    if done is not None:
        todo = todo.join(done.where(same).select(key), key, "left_anti")
    work(todo).withColumns({"prompt_version": F.lit(version), "model": F.lit(model)}).write.mode("append").parquet(path)
    return spark.read.parquet(path).where(same).join(items.select(key).distinct(), key, "left_semi")


def through_cache(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """requests with response and cache_hit. requests: step, model, version, temperature, prompt and others. Equal
    requests are asked once: answer gets cache_key and the five columns, and gives cache_key and response; null responses
    (failures) aren't cached."""
    spark = requests.sparkSession
    own = ["step", "model", "version", "temperature", "prompt"]
    keyed = requests.withColumn("cache_key", response_key(*[F.col(c) for c in own]))
    known = read_or_none(spark, path)
    known = spark.createDataFrame([], "cache_key string, response string") if known is None else known.select("cache_key", "response")
    before = known.groupBy("cache_key").agg(F.min("response").alias("response")).persist()
    before.count()  # what is known now, before this call adds to the table
    asked = keyed.select("cache_key", *own).dropDuplicates(["cache_key"]).join(before, "cache_key", "left_anti")
    answer(asked).select("cache_key", "response").where("response is not null").write.mode("append").parquet(path)
    now = spark.read.parquet(path).groupBy("cache_key").agg(F.min("response").alias("response"))
    return keyed.join(now, "cache_key", "left").join(before.select("cache_key", F.lit(True).alias("_hit")), "cache_key", "left").withColumn("cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


class _Guard:
    """A child process that does one row's work at a time, and is replaced when a row takes too long."""

    def __init__(self, work: Callable[[dict], dict]):
        self.work, self.child = work, None

    def _serve(self, pipe: Connection) -> None:
        while (row := pipe.recv()) is not None:
            pipe.send(_tried(self.work, row))

    def stop(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.child = None

    def __call__(self, row: dict, limit: float) -> tuple[dict, str | None]:
        if self.child is None:
            fork = multiprocessing.get_context("fork")
            self.pipe, other = fork.Pipe()
            self.child = fork.Process(target=self._serve, args=(other,), daemon=True)
            self.child.start()
            other.close()
        try:
            self.pipe.send(row)
            if self.pipe.poll(limit):
                return self.pipe.recv()
            self.stop()
            return {}, f"timeout: no result after {limit:g} s"
        except (EOFError, BrokenPipeError) as e:  # the work ended its process
            self.stop()
            return {}, f"{type(e).__name__}: the row's process ended"


def _tried(work: Callable[[dict], dict], row: dict) -> tuple[dict, str | None]:
    try:
        return work(row), None
    except Exception as e:  # noqa: BLE001 - any failure of one row is that row's result
        return {}, f"{type(e).__name__}: {e}"


def map_isolated(docs: DataFrame, work: Callable[[dict], dict], result: StructType, limit: float | None = None, progress: Observation | None = None) -> DataFrame:
    """docs with the fields of result and error. A row whose work raises, gives values of another type or takes longer than
    limit seconds has null fields and says why in error; the others go on. The columns of docs pass through as they are. With a
    limit a task does its rows' work in a process of its own, which a row that takes too long loses. progress is told rows,
    failed and timeouts when the result has been computed."""
    names, kinds = result.fieldNames(), to_arrow_schema(result)

    def typed(found: dict, error: str | None) -> tuple[dict, str | None]:
        try:
            return {n: pa.scalar(found.get(n), kinds.field(n).type).as_py() for n in names}, error
        except (pa.ArrowException, TypeError, AttributeError, ValueError) as e:
            return {}, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard = _Guard(work)
        try:
            for batch in batches:
                rows = [typed(*(_tried(work, row) if limit is None else guard(row, limit))) for row in batch.to_pylist()]
                more = [pa.array([f.get(n) for f, _ in rows], kinds.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array([e for _, e in rows], pa.string())], names=[*batch.schema.names, *names, "error"])
        finally:
            guard.stop()

    out = docs.mapInArrow(run, StructType([*docs.schema.fields, *result.fields, StructField("error", StringType())]))
    if progress is None:
        return out
    return out.observe(progress, F.count("*").alias("rows"), F.count("error").alias("failed"), F.count(F.when(F.startswith("error", F.lit("timeout:")), 1)).alias("timeouts"))
