"""Guide design for targets: hits at the intended site and elsewhere, the context of an edit, ranked guides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import composite, exact_sum, guide_notes


def locus_hits(hits: DataFrame, targets: DataFrame, key: str = "label") -> tuple[DataFrame, DataFrame]:
    """(on, off) of hits (key, guide_id, chrom, start, strand, mismatches, others) for targets (key, chrom, start, end): without mismatch
    within the target's half-open range, and all others. Further perfect hits within the range are on-target too."""
    place = targets.select(key, F.col("chrom").alias("_chrom"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = (F.col("mismatches") == 0) & (F.col("chrom") == F.col("_chrom")) & (F.col("start") >= F.col("_start")) & (F.col("start") < F.col("_end"))
    marked = hits.join(place, key).withColumn("_on", F.coalesce(inside, F.lit(False))).drop("_chrom", "_start", "_end")
    return marked.where("_on").drop("_on"), marked.where("not _on").drop("_on")


def edit_context(seq: Column, start: Column, ref: Column, alt: Column, flank: int = 100) -> Column:
    """``before(ref/alt)after`` of an edit at a 0-based place of seq, with up to ``flank`` bases on both sides; ``-`` for an empty
    allele. A ref that seq does not hold there is an error."""
    first = F.greatest(start - flank, F.lit(0)).cast("int")
    before = seq.substr(first + 1, start.cast("int") - first)
    after = seq.substr((start + F.length(ref) + 1).cast("int"), F.lit(flank))
    held = F.upper(seq.substr((start + 1).cast("int"), F.length(ref))) == F.upper(ref)
    allele = lambda x: F.when(x == "", "-").otherwise(F.upper(x))
    text = F.concat(F.upper(before), F.lit("("), allele(ref), F.lit("/"), allele(alt), F.lit(")"), F.upper(after))
    return F.when(held, text).otherwise(F.raise_error(F.concat(F.lit("the sequence does not hold the edit's ref: "), ref)))


def ranked_guides(on: DataFrame, off: DataFrame | None, activity: DataFrame, key: str = "label", top: int = 10, low: float = 25, high: float = 75) -> DataFrame:
    """key, rank, guide_id, spacer, strand, chrom, start, gc, on_target_score, specificity, off_target_count, composite, notes: the best guides of each
    target by composite, then id.

    on, off: as of locus_hits, with ``spacer``; off has ``score`` as well. A guide stands at its first on-target site by position and
    strand. activity: guide_id, score; a guide without one has 0, and without off-targets specificity 100. Where off is None
    nothing was searched: specificity is NaN, the count -1, the activity alone counts, and notes say so. Scores are summed exactly
    by guide before anything is joined, and ranks are cut in the tasks."""
    from ..functions.dna import gc_percent

    first = on.groupBy(key, "guide_id").agg(F.min(F.struct("chrom", "start", "strand", "spacer")).alias("s")).select(key, "guide_id", "s.*")
    rows = first.join(activity.select("guide_id", F.col("score").alias("on_target_score")), "guide_id", "left").withColumn("on_target_score", F.coalesce("on_target_score", F.lit(0.0)))
    if off is None:
        rows = rows.withColumns({"specificity": F.lit(float("nan")), "off_target_count": F.lit(-1).cast("long"), "composite": F.round("on_target_score", 9)})
        notes = F.concat_ws(";", F.nullif(guide_notes(F.col("spacer"), low, high), F.lit("")), F.lit("NO_OFF_TARGET_SCAN"))
    else:
        sums = off.groupBy(key, "guide_id").agg(exact_sum(F.when(F.col("mismatches") > 0, F.col("score"))).alias("sum"), F.count("*").alias("off_target_count"))
        rows = rows.join(sums, [key, "guide_id"], "left").withColumns({"specificity": F.lit(10000.0) / (100.0 + 100.0 * F.coalesce("sum", F.lit(0.0))), "off_target_count": F.coalesce("off_target_count", F.lit(0))})
        rows = rows.withColumn("composite", F.round(composite(F.col("on_target_score"), F.col("specificity")), 9))
        notes = guide_notes(F.col("spacer"), low, high)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("composite"), "guide_id"))
    rows = rows.withColumn("gc", gc_percent(F.col("spacer"))).withColumn("notes", notes).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return rows.select(key, "rank", "guide_id", "spacer", "strand", "chrom", "start", "gc", "on_target_score", "specificity", "off_target_count", "composite", "notes")
