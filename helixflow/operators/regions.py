"""Regions: CpG islands and tandem repeats. Scans give runs within blocks; only runs are joined across blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import Piece, scan, strings


def _rich(piece: Piece, width: int) -> np.ndarray:
    """Of each window: whether it is owned, half C and G or more, and has 0.6 of the expected CpGs or more."""
    on = piece.owns(width)
    if not len(on):
        return on
    sums = lambda x: np.r_[0, np.cumsum(x)]
    is_c, is_g = piece.bases == ord("C"), piece.bases == ord("G")
    c, g, cg = sums(is_c), sums(is_g), sums(is_c[:-1] & is_g[1:])
    n = len(on)
    c, g, cg = c[width:] - c[:n], g[width:] - g[:n], cg[width - 1 : width - 1 + n] - cg[:n]
    return on & (2 * (c + g) >= width) & (c > 0) & (g > 0) & (5 * width * cg >= 3 * c * g)


def _runs(on: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of True; no run goes past a place in ``breaks``."""
    before = np.r_[False, on[:-1]][: len(on)]
    before[breaks[breaks < len(on)]] = False
    new = on & ~before
    first = np.flatnonzero(new)
    # Places of each run, counted between the starts of runs.
    return first, np.diff(np.r_[0, np.cumsum(on)][np.r_[first, len(on)]])


def cpg_candidates(seqs: DataFrame, ids: list[str], width: int = 200) -> DataFrame:
    """ids, pos of every start of a window whose GC share is half or more and whose CpG count is at least 0.6 of the
    expected one. Other bases than C and G count as neither."""

    def kernel(piece):
        where = np.flatnonzero(_rich(piece, width))
        return where, piece.pos(where)

    return scan(seqs, ids, width, kernel, "pos long")


def joined_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, n of runs (keys, first, n, and others), where runs that follow each other without a gap are one. Of other
    columns, the one of the first run stays."""
    others = [c for c in runs.columns if c not in (*keys, "first", "n")]
    order = Window.partitionBy(*keys).orderBy("first")
    new = F.when(F.lag(F.col("first") + F.col("n")).over(order) == F.col("first"), 0).otherwise(1)
    rows = runs.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.sum("n").alias("n"), *[F.min_by(c, "first").alias(c) for c in others]).drop("_run")


def cpg_islands(seqs: DataFrame, ids: list[str], width: int = 200) -> DataFrame:
    """ids, start, end of each run of ``width`` consecutive candidates or more; the end is ``width`` past the last."""

    def kernel(piece):
        first, n = _runs(_rich(piece, width), piece.at)
        # A run that touches no end of its block and is too short is none.
        block = piece.block(first)
        keep = (n >= width) | (first == piece.at[block]) | (first + n == piece.at[block] + piece.owned[block])
        first, n = first[keep], n[keep]
        return first, piece.pos(first), n

    runs = joined_runs(scan(seqs, ids, width, kernel, "first long, n long"), ids).where(F.col("n") >= width)
    return runs.select(*ids, F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + width).alias("end"))


def tandem_candidates(seqs: DataFrame, ids: list[str], periods: range = range(1, 7), copies: int = 5) -> DataFrame:
    """ids, start, end, period, motif of each maximal run of ``copies`` whole repeats or more, for each period."""
    most = max(periods)
    padded = seqs.select(*ids, F.concat(F.lit(" " * most), F.col("seq")).alias("seq"))

    def kernel(piece):
        import pyarrow as pa

        # Window p is of the bases before pos p and the one at it.
        on = piece.owns(most + 1)
        n = len(on)
        last = piece.bases[most : most + n]
        at_end = piece.at[:-1] + piece.owned - 1
        found = []
        for q in periods:
            first, size = _runs(on & (last == piece.bases[most - q : most - q + n]), piece.at)
            # A run that touches no end of its block and is too short is none.
            block = piece.block(first)
            touches = (first == piece.at[block]) | (first + size - 1 == at_end[block])
            keep = touches | (size >= q * (copies - 1))
            first, size = first[keep], size[keep]
            found.append((first, piece.pos(first), size, np.full(len(first), q, np.int32), strings(piece.bases, first + most - q, q)))
        parts = list(zip(*found, strict=True))
        return *(np.concatenate(x) for x in parts[:4]), pa.concat_arrays(parts[4])

    keys = [*ids, "period"]
    runs = joined_runs(scan(padded, ids, most + 1, kernel, "first long, n long, period int, motif string"), keys).where(F.col("n") >= F.col("period") * (copies - 1))
    start = F.col("first") - F.col("period")
    whole = F.floor((F.col("n") + F.col("period")) / F.col("period")) * F.col("period")
    return runs.select(*ids, start.alias("start"), (start + whole).alias("end"), "period", "motif")


def tandem_repeats(candidates: DataFrame, ids: list[str]) -> DataFrame:
    """Candidates that a greedy pass keeps: by start, then longer, then shorter period, if they start past the last end.

    A candidate that starts past every end before it is kept whatever came before, so the pass is made for each stretch
    between such candidates, not for whole sequences."""
    order = Window.partitionBy(*ids).orderBy("start", F.desc("end"), "period")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = candidates.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.count("*").over(Window.partitionBy(*ids, "_stretch"))
    cut = cut.withColumn("_alone", alone == 1)
    listed = cut.where("not _alone").groupBy(*ids, "_stretch").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") - F.col("end")).alias("shorter"), "period", "end", "motif"))).alias("all"))
    empty = F.struct(F.lit(-1).cast("long").alias("end"), F.slice("all", 1, 0).alias("kept"))

    def step(acc, x):
        return F.when(x["start"] >= acc["end"], F.struct(x["end"].alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    kept = F.aggregate("all", empty, step, lambda acc: acc["kept"])
    cols = [*ids, "start", "end", "period", "motif"]
    return listed.select(*ids, F.explode(kept).alias("x")).select(*ids, "x.start", "x.end", "x.period", "x.motif").unionByName(cut.where("_alone").select(*cols))
