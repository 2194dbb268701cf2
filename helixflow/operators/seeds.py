"""Seed search with mismatches: guides against the sites whose PAM-proximal seed is near theirs, and its roll-up by guide."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import hamming, pack
from .motifs import _fits, stranded_windows

#: Changed bases that one side of the search is expanded by; beyond, the other side is expanded as well.
MOST_ONE_SIDED = 2
_PAIRS = 0x5555555555555555


def protospacers(seqs: DataFrame, ids: list[str], pams: tuple[str, ...] | None = ("NGG",), length: int = 20) -> DataFrame:
    """ids, position (0-based start of the protospacer on the forward strand), strand, spacer (as its strand reads it) and
    pam (null where pams is None: then no PAM is asked for). PAMs are IUPAC patterns of one length; a site that several fit is
    one row. Spacer and PAM have the bases A, C, G and T alone."""
    pams = tuple(p.upper() for p in pams or ())
    if len({len(p) for p in pams}) > 1 or any(not p for p in pams):
        raise ValueError("PAMs must not be empty and must have one length")
    width = len(pams[0]) if pams else 0
    either = np.concatenate([*[_fits("N")] * length, *([np.logical_or.reduce([_fits(p) for p in pams])] if pams else [])])
    rows = stranded_windows(seqs, ids, length + width, either, "site")
    pam = F.col("site").substr(length + 1, width)
    if len(pams) > 1:  # places fit one by one, which allows mixtures of patterns
        rows = rows.where(F.exists(F.array(*[F.lit("^" + "".join(f"[{''.join(b for b in 'ACGT' if _fits(p)[i, ord(b)])}]" for i in range(width)) + "$") for p in pams]), lambda r: F.regexp(pam, r)))
    at = F.col("pos") + F.when(F.col("strand") == "-", width).otherwise(0)
    return rows.select(*ids, at.alias("position"), "strand", F.col("site").substr(1, length).alias("spacer"), (pam if pams else F.lit(None).cast("string")).alias("pam"))


def ball(length: int, radius: int) -> list[int]:
    """All values that, combined by exclusive or, change ``radius`` bases at most of a packed string of this length."""
    out = [0]
    for n in range(1, radius + 1):
        for places in combinations(range(length), n):
            out += [sum(c << 2 * p for c, p in zip(change, places, strict=True)) for change in product((1, 2, 3), repeat=n)]
    return out


def changed(x: Column, y: Column) -> Column:
    """One bit for each base that differs between two packed strings."""
    d = x.bitwiseXOR(y)
    return d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(_PAIRS))


def mismatch_positions(x: Column, y: Column, length: int) -> Column:
    """0-based places, from the left, at which two packed strings of this length differ."""
    d = changed(x, y)
    return F.filter(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.call_function("shiftright", d, 2 * (length - 1 - i)).bitwiseAND(F.lit(1)) == 1)


def seed_search(sites: DataFrame, guides: DataFrame, seed: int = 12, mismatches: int = 0) -> DataFrame:
    """guide_id, the columns of sites but spacer, seed, target_seed, seed_mismatches, seed_mismatch_positions and
    seed_hit_count (sites that have this target seed) for guides (guide_id, spacer) and sites of ``protospacers`` whose last
    ``seed`` bases differ in so many at most. Guides with other letters than A, C, G and T find nothing.

    The distinct seeds of the guides are expanded to all within 2 mismatches, and meet the distinct target seeds in an
    equality join; for more mismatches target seeds are expanded as well, and a pair belongs to the meeting place that
    has changed the guide's first differing bases. Sites are only joined with the pairs found, and target seeds counted before.
    """
    if not 1 <= seed <= 31 or not 0 <= mismatches <= min(4, seed):
        raise ValueError("seeds have 1 to 31 bases, mismatches are 0 to 4")
    near, far = min(mismatches, MOST_ONE_SIDED), max(mismatches - MOST_ONE_SIDED, 0)
    own = guides.where(F.col("spacer").rlike("^[ACGT]+$") & (F.length("spacer") >= seed)).select("guide_id", pack(F.expr(f"right(spacer, {seed})")).alias("own"))
    keyed = sites.withColumn("target", pack(F.expr(f"right(spacer, {seed})"))).drop("spacer")
    counts = keyed.groupBy("target").agg(F.count("*").alias("seed_hit_count"))

    def expanded(df: DataFrame, value: str, radius: int) -> DataFrame:
        if not radius:
            return df.withColumn("meet", F.col(value))
        return df.withColumn("meet", F.explode(F.transform(F.lit(ball(seed, radius)).cast("array<long>"), lambda m: F.col(value).bitwiseXOR(m))))

    pairs = expanded(own.select("own").distinct(), "own", near).join(expanded(counts, "target", far), "meet")
    mine, theirs = changed(F.col("own"), F.col("meet")), changed(F.col("meet"), F.col("target"))
    if far:
        # The guide's changes lie before the target's, and the target's begin only where the guide's are used up.
        lowest = mine.bitwiseAND(-mine)
        pairs = pairs.where((theirs == 0) | ((F.bit_count(mine) == near) & (lowest > theirs)))
    pairs = pairs.drop("meet").withColumn("seed_mismatches", hamming(F.col("own"), F.col("target")))
    found = keyed.join(pairs, "target").join(own, "own")
    text = lambda c: F.translate(F.lpad(F.conv(F.col(c).cast("string"), 10, 4), seed, "0"), "0123", "ACGT")
    rest = [c for c in keyed.columns if c != "target"]
    return found.select("guide_id", *rest, text("own").alias("seed"), text("target").alias("target_seed"), "seed_mismatches", mismatch_positions(F.col("own"), F.col("target"), seed).alias("seed_mismatch_positions"), "seed_hit_count")


def seed_rollup(guides: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """guide_id, seed_hit_count, exact_seed_hit_count, mismatched_seed_hit_count and references (sorted distinct ``name``s)
    for every guide, also those without hits. Hits are first summed by guide and name, so a guide with many is no one task's."""
    exact = F.count_if(F.col("seed_mismatches") == 0)
    per = hits.groupBy("guide_id", name).agg(F.count("*").alias("n"), exact.alias("exact"))
    sums = per.groupBy("guide_id").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"), F.array_sort(F.collect_list(name)).alias("references"))
    out = guides.select("guide_id").distinct().join(sums, "guide_id", "left")
    n, e = F.coalesce("n", F.lit(0)), F.coalesce("exact", F.lit(0))
    return out.select("guide_id", n.alias("seed_hit_count"), e.alias("exact_seed_hit_count"), (n - e).alias("mismatched_seed_hit_count"), F.coalesce("references", F.array().cast(hits.select(F.array(name)).schema[0].dataType)).alias("references"))


def design_guides(targets: DataFrame, references: DataFrame, ids: list[str], name: str, seed: int = 12, mismatches: int = 0, pam: str = "NGG") -> tuple[DataFrame, DataFrame]:
    """(candidates with reasons, hits): guides of targets that no rule rejects are searched in references (name, seq)
    by their seeds. guide_id is ids, position and strand."""
    from .motifs import guide_candidates

    length = 20
    every = guide_candidates(targets, ids, length, pam).withColumn("guide_id", F.concat_ws(":", *ids, "pos", "strand")).withColumn("spacer", F.col("guide").substr(1, length))
    passing = every.where(F.size("reasons") == 0)
    return every, seed_search(protospacers(references, [name], (pam,), length), passing.select("guide_id", "spacer"), seed, mismatches)
