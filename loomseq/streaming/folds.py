"""Structured Streaming: folder source, micro-batches of a table, sinks of numbered versions, the end of a run."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomseq.sources.scratch import filesystem
from loomseq.streaming.state import Fold, run_fold


def folder_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 20, pattern: str = "*.parquet", ignore: str | None = None, recursive: bool = False) -> DataFrame:
    """Files already there first, then new ones, in batches of at most ``files_per_batch``.

    ``pattern`` is a glob on file names; rows of files whose path matches the regular expression ``ignore`` are left out.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern)
    rows = reader.option("recursiveFileLookup", recursive).parquet(path)
    return rows.where(~F.col("_metadata.file_path").rlike(ignore)) if ignore else rows


def micro_batches(rows: DataFrame, keys: list[str], order: list[str], at: str, cap: Column, idle: float = 2.0) -> DataFrame:
    """``rows`` plus ``batch`` per ``keys``: a batch ends after ``cap`` rows, or before a row that comes over ``idle`` seconds later."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col(at).cast("timestamp").cast("double") - F.lag(F.col(at).cast("timestamp").cast("double")).over(w)
    runs = rows.withColumn("_run", F.sum((F.coalesce(gap, F.lit(0.0)) > idle).cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)) - 1
    full = runs.withColumn("_k", F.floor(place / cap))
    return full.withColumn("batch", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_run", "_k"))).drop("_run", "_k")


def sink_versions(stream: DataFrame, base: str, every: str | None = None) -> StreamingQuery:
    """What a stream gives as versions ``base/out/v=<batch>``: a batch that runs again replaces what it wrote.

    ``every`` is a trigger's interval of processing time; without it all files there are are taken and the query ends.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/v={batch_id}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def await_rows(query: StreamingQuery, spark: SparkSession, base: str, rows: int, seconds: float = 120) -> None:
    """Wait until a running query has written ``rows`` rows; raise if it fails or takes longer than ``seconds``."""
    until = time.time() + seconds
    while True:
        if query.exception():
            raise query.exception()
        fs, p = filesystem(spark, f"{base}/out")
        done = [f"{base}/out/{s.getPath().getName()}" for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [d for d in done if fs.exists(filesystem(spark, f"{d}/_SUCCESS")[1])]
        if done and spark.read.parquet(*done).count() >= rows:
            return
        if time.time() > until:
            raise TimeoutError(f"under {rows} rows after {seconds} s")
        time.sleep(0.3)


def end_of_run(spark: SparkSession, base: str, arrival: StructType, fold: Fold) -> StreamingQuery:
    """One more batch, without rows, for a fold that lets go of what it holds: its state is stored like any other's.

    An empty file in ``base/in`` marks the end, so the flush has a batch number of its own; a later one finds nothing held.
    """
    spark.createDataFrame([], arrival).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return run_fold(folder_stream(spark, f"{base}/in", arrival, files_per_batch=1_000_000), base, fold)


def emitted(spark: SparkSession, base: str) -> DataFrame:
    """What all batches emitted, with the batch's number as ``v``."""
    return spark.read.parquet(f"{base}/out")
