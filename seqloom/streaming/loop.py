"""Incremental mining on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.runtime import shared_dir


def stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The files of a parquet table, a folder or a single file, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder, name = path.rstrip("/").rsplit("/", 1)
    # As a pattern, the name may be that of a file.
    return reader.parquet(f"{folder}/{{{name}}}")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(df: DataFrame, folder: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Every row that is there now through the query, batch by batch, with a checkpoint in the folder."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def distinct_keys(df: DataFrame, key: str, folder: str) -> DataFrame:
    """The keys of a stream, each when it first comes: state of the keys, appended results."""
    new = df.where(F.col(key).isNotNull()).select(key).dropDuplicates([key])
    q = new.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
    q.awaitTermination()
    return df.sparkSession.read.schema(new.schema).parquet(f"{folder}/out")


def mine(df: DataFrame, key: str, order: str, known: DataFrame, folder: str) -> DataFrame:
    """Each micro-batch: the first row of each key that was neither known nor in an earlier batch; key, order, batch.

    The keys are in the state store, each with the time of the batch that brought it, so a batch
    costs what it brings and not what came before. A batch writes the part of the table that has
    its own number, so one that is run again after a failure replaces what it wrote.
    """
    spark = df.sparkSession
    schema = df.select(key, F.col(order).cast("long").alias(order)).schema
    seen = known.where(F.col(key).isNotNull()).select(key).distinct()
    # The time of a batch is fixed when it is planned, also for a batch that is run again.
    stamped = df.where(F.col(key).isNotNull()).select(key, F.struct(F.current_timestamp().alias("t"), F.col(order).cast("long").alias("o")).alias("x"))
    first = stamped.groupBy(key).agg(F.min("x").alias("x"))
    new = first.where(F.col("x.t") == F.current_timestamp()).select(key, F.col("x.o").alias(order))

    def each(batch: DataFrame, n: int) -> None:
        batch.join(seen, key, "left_anti").write.mode("overwrite").parquet(f"{folder}/new/batch={n}")

    run_available(new, folder, "update", each)
    return _batches(spark, f"{folder}/new", schema).select(key, order, "batch")


def _batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What the batches wrote, with their numbers; an empty table before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch=*").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("int"))


def windowed(df: DataFrame, at: str, by: str, value: str, width: str, late: str, folder: str) -> DataFrame:
    """start, by, n, total per tumbling window, with a watermark; the table after all that is there.

    Each batch writes the windows it changed (update mode), so windows behind the watermark leave
    the state; the last batch of a window holds.
    """
    sums = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    out = sums.select(F.col("window.start").alias("start"), by, "n", "total")

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/batch={n}")

    run_available(out, folder, "update", each)
    written = _batches(df.sparkSession, f"{folder}/windows", out.schema)
    return written.groupBy("start", by).agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("start", by, "x.n", "x.total")
