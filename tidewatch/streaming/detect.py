"""Scoring of arriving rows: features and the fitted model are stateless, so batch and stream agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path


def read_new_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def detections(rows: DataFrame, features: Callable[[DataFrame], DataFrame], model, keep: list[str], normal: int = 0) -> DataFrame:
    """Prediction, confidence in it, and the probability that the row is an attack; batch or stream."""
    scored = model.transform(features(rows)).withColumn("__p", vector_to_array("probability"))
    return scored.select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        F.array_max("__p").alias("confidence"),
        (1 - F.get("__p", normal)).alias("attack_probability"),
    )


def write_available(stream: DataFrame, path: str, checkpoint: str | None = None) -> str:
    """Process everything that has arrived, then stop; a rerun with the same checkpoint goes on from there."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream")
    running = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    running.awaitTermination()
    return path
