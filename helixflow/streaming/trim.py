"""Streams of reads: the batch operators on ``readStream``, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import dna_view
from ..operators.kmers import count_kmers
from ..operators.trimming import trim_reads


def stream_reads(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of parquet files of reads, one file for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def trimmed_stream(reads: DataFrame, adapter: str) -> DataFrame:
    """Stateless: the same expressions as for a batch."""
    return trim_reads(reads, adapter)


def running_histogram(trimmed: DataFrame) -> DataFrame:
    """removed, reads so far; for update or complete mode."""
    return trimmed.where("removed > 0").groupBy("removed").agg(F.count("*").alias("reads"))


def running_kmers(seqs: DataFrame, k: int, ids: list[str]) -> DataFrame:
    """kmer, count so far."""
    return count_kmers(seqs, k, ids)


def windowed_events(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window, event_type, events, total: tumbling windows that close ``lateness`` behind the latest time seen."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


__all__ = ["dna_view", "stream_reads", "trimmed_stream", "running_histogram", "running_kmers", "windowed_events"]
