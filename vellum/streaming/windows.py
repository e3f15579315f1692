"""Structured Streaming: windowed counts of late-arriving rows, run on what is there or kept running."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one where that is unset in local mode (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{top.rstrip('/')}/streams/{uuid.uuid4().hex}" if top else "file://" + tempfile.mkdtemp(prefix="vellum-stream-")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream: those of its own folder, or, where it is one file, that file of the folder."""
    path = f"{folder}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def window_counts(events: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    """Rows a tumbling window and key: since, key, n. State of windows older than the watermark is dropped in append mode."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    counted = timed.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("since"), key, "n")


def run_available(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now; its result as a table. Both state and result are in the shared folder, so a
    lost executor's tasks are run again from there."""
    spark = result.sparkSession
    folder = shared_folder(spark)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    running = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    running.awaitTermination()
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(out):
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
