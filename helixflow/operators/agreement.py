"""Positional comparison of whole ordered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.storage import written

_LOCAL = (1 << 33) - 1  # of monotonically_increasing_id: the place within the partition


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with ``name``, the place of each row in the order, from 0 on; nulls first, equal rows in any order.

    Rows are dealt out by ranges and sorted there; a place is the place within its range and the sizes of the ranges before, of
    which one number each reaches the driver. No task sees more than its range, and ranges follow the data, so only rows that
    are equal in the whole order can pile up; add columns to the order to part them.
    """
    if not order or name in df.columns:
        raise ValueError("an order and a new name for the place are needed")
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = written(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))}))
    before, total = {}, 0
    for r in sorted(ranges.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        before[r["_range"]] = total
        total += r.n
    offsets = df.sparkSession.createDataFrame(list(before.items()), "_range int, _before long")
    return ranges.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def paired(left: DataFrame, right: DataFrame, order: list[str]) -> DataFrame:
    """place, l and r: the rows of both tables at each place, as structs; null past the end of one."""
    sides = [numbered(df, order, "_place").select(F.col("_place").alias("place"), F.struct(*df.columns).alias(name)) for df, name in ((left, "l"), (right, "r"))]
    return sides[0].join(sides[1], "place", "full")


def verdict(fraction, floor: float = 0.99):
    """PASS where all agree, DIVERGE from ``floor`` on, else FAIL."""
    return F.when(fraction >= 1.0, "PASS").when(fraction >= floor, "DIVERGE").otherwise("FAIL")


def record_agreement(left: DataFrame, right: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row: left_rows, right_rows, equal_rows (equal ``columns``, all by default, at the same place), fraction of the longer
    table and verdict. Nulls equal nulls; two empty tables have fraction 0 and FAIL, as nothing was compared."""
    columns = columns or left.columns
    same = F.col("l").isNotNull() & F.col("r").isNotNull()
    for c in columns:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    sums = paired(left.select(*dict.fromkeys([*order, *columns])), right.select(*dict.fromkeys([*order, *columns])), order).agg(F.count("l").alias("left_rows"), F.count("r").alias("right_rows"), F.count_if(same).alias("equal_rows"))
    most = F.greatest("left_rows", "right_rows")
    out = sums.withColumn("fraction", F.when(most > 0, F.col("equal_rows") / most).otherwise(0.0))
    return out.withColumn("verdict", verdict(F.col("fraction")))


def score_agreement(left: DataFrame, right: DataFrame, order: list[str], identity: list[str], score: str = "score", epsilon: float | None = None) -> DataFrame:
    """One row: records, identity_mismatches (places where the identity differs or one table has ended), beyond (scores
    further apart than epsilon; with None, scores that are not equal), max_abs_diff (null where nothing was compared) and
    equal. NaN is apart from all but NaN."""
    if epsilon is not None and not epsilon >= 0:
        raise ValueError("epsilon must be 0 or more")
    both = paired(left, right, order)
    same = F.col("l").isNotNull() & F.col("r").isNotNull()
    for c in identity:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    a, b = F.col(f"l.{score}"), F.col(f"r.{score}")
    gap = F.when(same & ~a.eqNullSafe(b), F.abs(a - b)).when(same, F.lit(0.0))
    far = same & ~a.eqNullSafe(b) & (F.lit(True) if epsilon is None else ~F.coalesce(F.abs(a - b) <= epsilon, F.lit(False)))
    sums = both.agg(F.count("*").alias("records"), F.count_if(~same).alias("identity_mismatches"), F.count_if(far).alias("beyond"), F.max(gap).alias("max_abs_diff"))
    return sums.withColumn("equal", (F.col("identity_mismatches") == 0) & (F.col("beyond") == 0))
