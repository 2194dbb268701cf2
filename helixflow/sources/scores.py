"""Tables of scored hits as tab-separated text: the nine columns of a hit and its score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hits

COLUMNS = (*hits.COLUMNS, "score")


def fixed(value: Column, digits: int = 6) -> Column:
    """A double with so many decimals, rounded from its exact binary value, ties to even, as C's ``%.6f`` does; for
    values under 1e9 in size, whose shortest digits tell them from all others at these decimals."""
    plain = F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    return F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(plain)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS of every row. A header, comments (``#``) and empty lines are skipped; rows of any other width than ten, or
    with fields that are no numbers where numbers belong, fail."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("guide_id\t") & (F.col("value") != "")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"), "value")
    kinds = hits.KINDS | {"score": "double"}
    whole = F.when(F.size("f") == len(COLUMNS), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not ten fields: "), "value")))
    return rows.select(whole.alias("f")).select(*[F.col("f")[i].cast(kinds.get(c, "string")).alias(c) if c not in kinds else F.coalesce(F.col("f")[i].try_cast(kinds[c]), F.raise_error(F.concat(F.lit(f"not a {c}: "), F.col("f")[i])).cast(kinds[c])).alias(c) for i, c in enumerate(COLUMNS)])


def score_line(digits: int = 6) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in hits.COLUMNS], fixed(F.col("score"), digits))


def write_scores(rows: DataFrame, path: str, digits: int = 6) -> None:
    """Sorted parts whose names follow the canonical order, each with the header, so that any part can be read alone."""
    order = [*hits.ORDER, *[c for c in hits.COLUMNS if c not in hits.ORDER]]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.select(score_line(digits).alias("\t".join(COLUMNS))).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\u0001").csv(path)
