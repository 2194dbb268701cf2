"""Comparison of two result tables: equal as bags, with the first differences and a digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of left, with left_rows and right_rows, where the two tables hold a row a different number of times."""
    cols = left.columns
    rows = left.select(*cols, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*cols, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return rows.groupBy(*cols).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows")).where("left_rows <> right_rows")


def digest(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free checksum of all of them."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def compare(left: DataFrame, right: DataFrame, most: int = 20) -> dict:
    """equal, rows on both sides, and the first ``most`` differences in order."""
    a, b = digest(left).first(), digest(right).first()
    found = [r.asDict() for r in differences(left, right).orderBy(*left.columns).limit(most).collect()]
    return {"equal": not found, "left_rows": a["rows"], "right_rows": b["rows"], "left_checksum": a["checksum"], "right_checksum": b["checksum"], "differences": found}
