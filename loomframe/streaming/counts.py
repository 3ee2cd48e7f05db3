"""Histograms and files over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomframe.operators.hist import fill, parse_columns


def read_files(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_each: int = 1, **options) -> DataFrame:
    """A stream of a folder's files, so many for each batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_each).options(**options).load(folder)


def running_counts(stream: DataFrame, columns: str | Sequence[str], specs: dict | None = None) -> DataFrame:
    """The histogram so far; for the complete or update mode. Its state has one row for each filled bin."""
    return fill(stream, columns, specs).frame


def windowed_counts(stream: DataFrame, time: str, period: str, by: Sequence[str] = (), late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts in windows of event time; state goes when the watermark has passed."""
    at = F.window(F.col(time).cast("timestamp"), period, slide or period)
    rows = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    at = F.window("_at", period, slide or period)
    out = rows.groupBy(at.alias("window"), *by).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "count")


def accumulate(stream: DataFrame, columns: str | Sequence[str], table: str, specs: dict | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Keeps a parquet table of counts: each batch adds its rows under its number, so that a batch run again replaces itself."""
    names = parse_columns(columns)

    def one(batch: DataFrame, number: int) -> None:
        fill(batch, names, specs).frame.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def accumulated(spark: SparkSession, table: str, columns: str | Sequence[str]) -> DataFrame:
    """The sum of the batches of ``accumulate``."""
    return spark.read.parquet(table).groupBy(*parse_columns(columns)).agg(F.sum("count").alias("count"))


def for_each(stream: DataFrame, func: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(func).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
