"""Structured Streaming forms of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.common import fingerprint
from lodestone.operators.lines import Filter, apply
from lodestone.sources.tables import replace


def read(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Parquet files as they arrive below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def daily_usage(metrics: DataFrame, resent: str = "2 days") -> DataFrame:
    """Executions and tokens per day and command of everything that has arrived.

    Clocks may be far off, so no watermark is driven by them: rows sent twice are told
    within ``resent`` of their arrival, and a day's figures stay open, however late a row.
    That state has a row per day and command, whatever the number of executions. For
    :func:`write_whole`, as every figure may still change.
    """
    one, two = fingerprint(*[c for c in metrics.columns if c != "id"])
    arrived = metrics.withColumn("_a", one).withColumn("_b", two).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", resent)
    once = arrived.dropDuplicatesWithinWatermark(["_a", "_b"])
    return once.groupBy(F.to_date("timestamp").alias("day"), "command_name").agg(F.count("*").alias("executions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def filtered_output(logs: DataFrame, spec: Filter, text: str = "text") -> DataFrame:
    """Every log row with its filtered text: stateless."""
    return logs.withColumn("filtered", apply(spec, F.col(text)))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what has arrived, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def write_whole(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table equal to the whole result: each batch replaces it; then stop."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True)
    return writer.foreachBatch(lambda rows, _: replace(rows, path)).start()
