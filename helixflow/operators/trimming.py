"""Adapter trimming: stateless, so the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trim_reads(reads: DataFrame, adapter: str) -> DataFrame:
    """reads (with seq and qual) cut at the leftmost adapter, matched in upper case; with ``removed`` bases."""
    if not adapter or set(adapter.upper()) - set("ACGT"):
        raise ValueError("an adapter has the bases A, C, G and T alone")
    at = F.instr(F.upper("seq"), adapter.upper())
    keep = F.when(at > 0, at - 1).otherwise(F.length("seq"))
    return reads.withColumn("_keep", keep).withColumns({"removed": F.length("seq") - F.col("_keep"), "seq": F.expr("substring(seq, 1, _keep)"), "qual": F.expr("substring(qual, 1, _keep)")}).drop("_keep")


def trim_stats(trimmed: DataFrame) -> DataFrame:
    """One row of counters over all reads."""
    cut = F.col("removed") > 0
    return trimmed.agg(F.count("*").alias("reads"), F.count_if(cut).alias("trimmed"), F.count_if(F.length("seq") == 0).alias("emptied"), F.sum(F.length("seq") + F.col("removed")).alias("bases_in"), F.sum(F.length("seq")).alias("bases_out"))


def trim_histogram(trimmed: DataFrame) -> DataFrame:
    return trimmed.where("removed > 0").groupBy("removed").agg(F.count("*").alias("reads"))
