"""Distributions of triples that arrive as files of N-Triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.triples import distribution
from brindle.sources.text import parse_ntriples


def stream_triples(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Triples of the files under ``path``, new files as they come."""
    return parse_ntriples(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), "value")


def stream_distribution(triples: DataFrame, key: str = "subject") -> DataFrame:
    """Running counts by a column; the state has a row for each value."""
    return distribution(triples, key)


def windowed_distribution(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and value; windows are dropped from the state once ``late`` has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("cnt")).select("w.start", key, "cnt")


def write_counts(counts: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs what is there to an in-memory table, then stops."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
