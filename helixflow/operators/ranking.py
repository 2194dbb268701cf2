"""Ranking of prime-editing guides: efficiencies, folding and off-target specificities of both spacers in one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prime import SCAFFOLD, rna
from .scoring import exact_sum

#: Weights of the off-target specificities of the guide and its nicking guide, and of the folding penalty (fixed values).
GUIDE_TERM, NICKING_TERM, FOLDING_TERM = 0.3, 0.15, 0.1
#: Kilocalories below which folding is a penalty, and hits of a bucket that count (fixed values).
TIGHT_FOLD, MOST_HITS = -25.0, 200


def folding_penalty(mfe: Column) -> Column:
    """Kilocalories below TIGHT_FOLD; 0 where unknown."""
    return F.when(mfe.isNull() | F.isnan(mfe), 0.0).otherwise(F.greatest(F.lit(0.0), -(mfe - TIGHT_FOLD)))


def composite(efficiency: Column, guide: Column, nicking: Column, mfe: Column) -> Column:
    """efficiency - 0.3 guide - 0.15 nicking (0 where null) - 0.1 folding penalty; NaN where the efficiency is unknown."""
    score = efficiency - GUIDE_TERM * guide - NICKING_TERM * F.coalesce(nicking, F.lit(0.0)) - FOLDING_TERM * folding_penalty(mfe)
    return F.when(efficiency.isNull() | F.isnan(efficiency), float("nan")).otherwise(score)


def spacers_of(candidates: DataFrame) -> DataFrame:
    """guide_id and spacer: each distinct spacer and nicking spacer once, so that none is searched twice."""
    both = candidates.select(F.explode(F.array("spacer", "nicking_spacer")).alias("spacer")).where("spacer is not null").distinct()
    return both.select(F.col("spacer").alias("guide_id"), "spacer")


def split_specificity(hits: DataFrame, flag: str, by: str = "guide_id", score: str = "score", most: int = MOST_HITS) -> DataFrame:
    """by, specificity and off_targets of hits outside ``flag``, paralog_specificity and paralog_hits of those inside:
    100 / (1 + sum), of the ``most`` highest scores of each. Hits without mismatch belong to neither; a bucket without
    hits has 100. Ranks are taken in groups of scores first, so a spacer with many hits is cut down before they meet."""
    off = hits.where("mismatches > 0").select(by, F.coalesce(F.col(flag), F.lit(False)).alias("_in"), F.col(score).alias("_score"))
    counted = off.groupBy(by, "_in", "_score").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by, "_in").orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, -1)
    some = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    taken = F.greatest(F.least(F.col("_n"), F.lit(most) - F.col("_before")), F.lit(0))
    sums = some.groupBy(by).agg(*[x for inside, name, count in ((False, "specificity", "off_targets"), (True, "paralog_specificity", "paralog_hits")) for x in (
        (F.lit(10000.0) / (100.0 + 100.0 * F.coalesce(exact_sum(F.when((F.col("_in") == inside) & (taken > 0), F.col("_score") * taken)), F.lit(0.0)))).alias(name),
        F.coalesce(F.sum(F.when(F.col("_in") == inside, F.col("_n"))), F.lit(0)).alias(count),
    )])
    rest = hits.select(by).distinct().join(sums, by, "left")
    whole = {"specificity": 100.0, "off_targets": 0, "paralog_specificity": 100.0, "paralog_hits": 0}
    return rest.select(by, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in whole.items()])


def pegrna_id(name: Column, scaffold: Column, strategy: Column, full: Column) -> Column:
    """``{name}_{nick}_{p or m}_pbs{n}_rtt{n}_{scaffold}_{strategy}_{first 8 digits of the RNA's SHA-1}``."""
    strand = F.when(F.col("strand") == "+", "p").otherwise("m")
    number = lambda c: F.col(c).cast("string")
    return F.concat_ws("_", name, number("nick"), strand, F.concat(F.lit("pbs"), number("pbs_length")), F.concat(F.lit("rtt"), number("rtt_length")), scaffold, strategy, F.substring(F.sha1(full.cast("binary")), 1, 8))


def full_rna(scaffold: str = SCAFFOLD) -> Column:
    return F.concat(rna(F.col("spacer")), F.lit(scaffold.upper().replace("T", "U")), F.col("rtt"), F.col("pbs"))


def ranked_pegrnas(candidates: DataFrame, off: DataFrame, group: str, top: int = 20, scaffold: str = SCAFFOLD, scaffold_name: str = "sgRNA") -> DataFrame:
    """The ``top`` best candidates of each ``group``, with specificity, off_targets, paralog_specificity and paralog_hits of the spacer, nicking_specificity
    and nicking_off_targets (null without a nicking spacer), composite, pegrna_id and rank.

    candidates: group, strand, spacer, nick, pbs, pbs_length, rtt, rtt_length, nicking_spacer (null: PE2, else PE3),
    efficiency and mfe; other columns pass. off: a row for each distinct spacer (``split_specificity``); spacers without a row have no
    hits. The highest score comes first and unknown ones last, then strand, nick, lengths, strategy and id. A group's rows are
    cut down in the tasks before they meet.
    """
    own = off.select(F.col("guide_id").alias("spacer"), "specificity", "off_targets", "paralog_specificity", "paralog_hits")
    nicking = off.select(F.col("guide_id").alias("nicking_spacer"), F.col("specificity").alias("nicking_specificity"), F.col("off_targets").alias("nicking_off_targets"))
    rows = candidates.join(own, "spacer", "left").join(nicking, "nicking_spacer", "left")
    pe3 = F.col("nicking_spacer").isNotNull()
    rows = rows.withColumns({
        "specificity": F.coalesce("specificity", F.lit(100.0)), "off_targets": F.coalesce("off_targets", F.lit(0)),
        "paralog_specificity": F.coalesce("paralog_specificity", F.lit(100.0)), "paralog_hits": F.coalesce("paralog_hits", F.lit(0)),
        "nicking_specificity": F.when(pe3, F.coalesce("nicking_specificity", F.lit(100.0))), "nicking_off_targets": F.when(pe3, F.coalesce("nicking_off_targets", F.lit(0))),
        "strategy": F.when(pe3, "PE3").otherwise("PE2"),
    })
    score = composite(F.col("efficiency"), F.col("specificity"), F.col("nicking_specificity"), F.col("mfe"))
    rows = rows.withColumn("composite", F.round(score, 9)).withColumn("pegrna_id", pegrna_id(F.col(group).cast("string"), F.lit(scaffold_name), F.col("strategy"), full_rna(scaffold)))
    unknown = F.isnan("composite")
    order = [unknown, F.when(unknown, 0.0).otherwise(-F.col("composite")), F.col("strand"), F.col("nick"), F.col("pbs_length"), F.col("rtt_length"), F.col("strategy"), F.col("pegrna_id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= top)
