"""The given tables, read as the library's inputs: documents are the sequences, benchmark items the guide sources,
conversation turns the reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import matching


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, where its table has fewer files than cores; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def sequences(spark, sf_dir) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", dna.dna_view(F.col("text")).alias("seq"))


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", dna.dna_view(F.col("text")).alias("seq"))


def guides(spark, sf_dir) -> DataFrame:
    """The distinct spacers of all benchmark sites; a spacer is its own id."""
    sites = matching.pam_sites(items(spark, sf_dir), ["item_id"])
    return sites.select(F.col("site").substr(1, 20).alias("spacer")).distinct().select(F.col("spacer").alias("guide_id"), "spacer")


def reads(spark, sf_dir) -> DataFrame:
    seq = dna.dna_view(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", seq.alias("seq")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
