"""Reports of ranked guides as tab-separated text and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import fixed


def cell(name: str, kind: str) -> Column:
    """A cell: ``gc`` with two decimals, other doubles with six, NaN and a count of -1 as NaN, null empty."""
    c = F.col(name)
    if kind in ("double", "float"):
        text = F.when(F.isnan(c), "NaN").otherwise(fixed(c.cast("double"), 2 if name == "gc" else 6))
    elif kind in ("int", "bigint"):
        text = F.when((c == -1) & F.lit(name.endswith(("count", "start", "end"))), "NaN").otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def report_lines(rows: DataFrame) -> DataFrame:
    """One column, named by the header, with a line for each row."""
    return rows.select(F.concat_ws("\t", *[cell(n, k) for n, k in rows.dtypes]).alias("\t".join(rows.columns)))


def report_json(rows: DataFrame) -> DataFrame:
    """value: a JSON object with sorted keys for each row; NaN and counts of -1 are null."""
    clean = []
    for name, kind in sorted(rows.dtypes):
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        elif kind in ("int", "bigint") and name.endswith(("count", "start", "end")):
            c = F.when(c != -1, c)
        clean.append(c.alias(name))
    return rows.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))
