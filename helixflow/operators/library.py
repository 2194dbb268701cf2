"""Pooled libraries: owners of shared spacers, selection for each gene, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import canonical, gc_fraction, pack
from .kmers import held_kmers


def dedup_collisions(pools: DataFrame) -> DataFrame:
    """spacer, genes: spacers that two genes or more list. Repeats within a gene are combined before the shuffle."""
    return pools.select(F.upper("spacer").alias("spacer"), "gene").distinct().groupBy("spacer").agg(F.count("*").alias("genes")).where("genes >= 2")


def global_dedup(pools: DataFrame, wanted: int, strategy: str = "highest_score") -> DataFrame:
    """gene, place, spacer, score: the first ``wanted`` guides of each gene that no other gene owns.

    pools: gene, place (order within the gene), spacer, score. The owner of a spacer is the gene whose first listing of
    it scores highest (ties by name), or the first by name under ``alphabetical``.
    """
    if strategy not in ("highest_score", "alphabetical"):
        raise ValueError(f"unknown strategy {strategy!r}")
    listed = pools.withColumn("key", F.upper("spacer"))
    first = listed.groupBy("key", "gene").agg(F.min_by("score", "place").alias("score"))
    best = F.struct((-F.col("score") if strategy == "highest_score" else F.lit(0.0)).alias("s"), F.col("gene").alias("owner"))
    owner = first.groupBy("key").agg(F.min(best).alias("o")).select("key", "o.owner")
    own = listed.join(owner, "key").where(F.col("gene") == F.col("owner"))
    rank = F.row_number().over(Window.partitionBy("gene").orderBy("place"))
    return own.withColumn("rank", rank).where(F.col("rank") <= wanted).select("gene", "rank", "spacer", "score")


def balance(chosen: DataFrame, genes: DataFrame, wanted: int) -> DataFrame:
    """gene, selected, deficit, under_balanced for every gene."""
    n = chosen.groupBy("gene").agg(F.count("*").alias("selected"))
    rows = genes.select("gene").distinct().join(n, "gene", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    deficit = F.greatest(F.lit(wanted) - F.col("selected"), F.lit(0))
    return rows.select("gene", "selected", deficit.alias("deficit"), (deficit > 0).alias("under_balanced"))


def assemble(chosen: DataFrame, reports: DataFrame) -> DataFrame:
    """library_index (from 1, genes in order, then rank), gene, rank, spacer, notes. Indexes come from a running sum over
    genes, one small row each, not from a sort of all guides."""
    sizes = chosen.groupBy("gene").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("gene").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("gene", "before")
    note = F.when(F.col("under_balanced"), F.concat(F.lit("UNDER_BALANCED:deficit="), F.col("deficit").cast("string"))).otherwise("")
    rows = chosen.join(before, "gene").join(reports.select("gene", note.alias("notes")), "gene")
    return rows.select((F.col("before") + F.col("rank")).alias("library_index"), "gene", "rank", "spacer", "notes")


def control_candidates(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """candidate, spacer: 20 bases from SHA-256 over the seed and the number, two bits of each hex digit."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")).cast("binary"), 256), 1, 20)
    return spark.range(n).select(F.col("id").alias("candidate"), F.translate(digits, "0123456789abcdef", "ACGTACGTACGTACGT").alias("spacer"))


def non_targeting(candidates: DataFrame, seqs: DataFrame, low: float = 0.4, high: float = 0.6, most: int = 200_000) -> DataFrame:
    """The candidates (spacer; ``most`` at most, an error beyond) fit for controls: G and C from low to high, no TTTT, no
    base five times in a row, and no sequence that holds the spacer on either strand."""
    fit = candidates.where(gc_fraction(F.col("spacer")).between(low, high) & ~F.col("spacer").rlike("TTTT|A{5}|C{5}|G{5}|T{5}"))
    fit = fit.withColumn("packed", pack(canonical(F.col("spacer"))))
    wanted = [r["packed"] for r in fit.select("packed").distinct().limit(most + 1).collect()]
    if len(wanted) > most:
        raise ValueError(f"more than {most} candidates")
    return fit.join(held_kmers(seqs, wanted, 20), "packed", "left_anti").drop("packed")
