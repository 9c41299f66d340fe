"""Streams of pixels or events: windowed features with late data, and features of blocks as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from gridloom.operators import features


def windowed_features(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum, mean and deviation of a value by window and key; rows later than the watermark are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    v = F.col(value)
    grouped = stream.withWatermark(time, late).groupBy(window.alias("window"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def last_states(grouped: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The rows of a stream of aggregates at its present end.

    Each micro-batch writes the rows that it changed, as Parquet under ``path``; a batch that is replayed replaces its own
    files. Of each key the row of the last batch counts. Watermarks hold, and nothing passes through the driver.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = grouped.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = grouped.sparkSession
    try:
        rows = spark.read.schema(StructType([*grouped.schema, StructField("batch", IntegerType())])).parquet(f"{path}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # a stream without a batch
        return spark.createDataFrame([], grouped.schema)
    others = [c for c in grouped.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in others))


def append_features(stream: DataFrame, extractor: features.FeatureExtractor, keys: list[str], path: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Features of the objects of each micro-batch, appended as Parquet. A block comes whole in one batch, so no state is kept."""

    def each(batch: DataFrame, number: int) -> None:
        # a batch that is replayed replaces its own files
        (write or (lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")))(extractor.compute(batch, keys), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
