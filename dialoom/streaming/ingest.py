"""Structured Streaming ingestion of turns: late versions, deduplication by key, windowed counts.

The reference works on files at rest; this is its continuous form: a file stream of turn rows goes
through the same functions, and each micro-batch appends only keys that the table does not hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dialoom.functions.ids import turn_numbers
from dialoom.sources.files import write_missing


def turn_stream(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Turn rows of parquet files as they arrive, with the parsed id and an event time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)
    n = turn_numbers(F.col("dia_id"))
    return rows.withColumn("session", n["session"]).withColumn("turn", n["turn"]).withColumn("arrived", F.col("ingested_at").cast("timestamp"))


def deduplicated(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """The first row of each turn within the watermark; state is dropped behind it."""
    return stream.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["conversation_id", "session", "turn"])


def hourly_counts(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Turns per conversation kind and hour of arrival, late rows included up to the watermark."""
    return stream.withWatermark("arrived", lateness).groupBy(F.window("arrived", "1 hour"), "speaker").agg(F.count("*").alias("n_turns"))


def append_new(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append keys that the target does not hold; a replayed batch writes nothing twice."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: write_missing(batch.dropDuplicates([key]), target, key))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
