"""Streams. Every operator that maps records works on a streaming DataFrame as it stands; here are the ones with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import calculate_hash


def read_records(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).json(path)


def first_of_content(stream: DataFrame, time_col: str, delay: str = "1 hour", algorithm: str = "sha256") -> DataFrame:
    """Only the first record of each content within the watermark; the state is the hashes of that span."""
    hashed = stream.withColumn("__hash", calculate_hash(F.col("content"), algorithm)).withWatermark(time_col, delay)
    return hashed.dropDuplicatesWithinWatermark(["__hash"]).drop("__hash")


def windowed_counts(stream: DataFrame, time_col: str, key_col: str, window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by window and key; late rows count until the watermark passes."""
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return stream.withWatermark(time_col, delay).groupBy(w, F.col(key_col)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key_col, "n")
