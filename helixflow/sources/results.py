"""Result tables of prime-editing guides as tab-separated text and JSON lines, in an older and the present layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a table in their order, and their kinds (fixed values). A number that is unknown is NaN, one that does not apply is null.
#: The older layout ends before ``paralog_hit_count_pegrna``.
COLUMNS = {
    "pegrna_id": "str", "edit_notation": "str", "edit_position": "int", "edit_type": "str", "spacer_strand": "str", "spacer_seq": "str", "pam_seq": "str",
    "scaffold_variant": "str", "pbs_seq": "str", "pbs_length": "int", "rtt_seq": "str", "rtt_length": "int", "rt_product_seq": "str", "nick_site": "int",
    "full_pegrna_rna_seq": "str", "pe_strategy": "str", "nicking_spacer": "opt_str", "nicking_pam": "opt_str", "nicking_distance": "opt_int",
    "pridict_efficiency": "float", "pridict_edit_rate": "float", "pridict_confidence": "float", "mfe_kcal": "float", "scaffold_disruption": "float", "pbs_pairing_prob": "float",
    "cfd_aggregate_pegrna": "float", "off_target_count_pegrna": "int", "cfd_aggregate_nicking": "opt_float", "off_target_count_nicking": "opt_int",
    "composite_pridict": "float", "rank": "int", "notes": "list", "paralog_hit_count_pegrna": "int", "cfd_aggregate_paralog_pegrna": "float",
}
OLDER = 32
#: What older tables lack (fixed values).
ADDED = {"paralog_hit_count_pegrna": "0", "cfd_aggregate_paralog_pegrna": "100"}
TYPES = {"str": "string", "opt_str": "string", "int": "long", "opt_int": "long", "float": "double", "opt_float": "double", "list": "array<string>"}


def general(value: Column, digits: int = 6) -> Column:
    """A double with so many significant digits and no trailing zeros, as ``%.6g`` writes it; NaN is NA, null empty."""
    @F.pandas_udf("string")
    def one(v: pd.Series) -> pd.Series:
        return v.map(lambda x: format(x, f".{digits}g"))

    return F.when(value.isNull(), "").when(F.isnan(value), "NA").otherwise(one(F.coalesce(value, F.lit(0.0))))


def _cell(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "list":
        return F.concat_ws(",", c)
    return general(c) if kind.endswith("float") else F.coalesce(c.cast("string"), F.lit(""))


def result_lines(rows: DataFrame, older: bool = False) -> DataFrame:
    """One column, named by the header, with a line for each row."""
    names = list(COLUMNS)[: OLDER if older else None]
    return rows.select(F.concat_ws("\t", *[_cell(n, COLUMNS[n]) for n in names]).alias("\t".join(names)))


def write_results(rows: DataFrame, path: str, order: list[str], older: bool = False) -> None:
    """Sorted parts whose names follow the order, each with the header."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    result_lines(ranges, older).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("sep", "\u0001").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS of tables in either layout, file by file and row by row. Headers of other names, rows of other widths, and cells
    that don't fit their kind are errors; only the optional kinds may be empty, only floats NA."""
    names = list(COLUMNS)
    full, short = "\t".join(names), "\t".join(names[:OLDER])
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value")).where(F.col("value") != "")
    head = F.col("value").startswith("pegrna_id\t")
    bad_head = head & ~F.col("value").isin(full, short)
    f = F.split("value", "\t", -1)
    kept = F.when(bad_head, F.raise_error(F.lit("not a header of result tables")).cast("boolean")).otherwise(~head)
    wide = F.when(F.size(f) == len(names), f).when(F.size(f) == OLDER, F.concat(f, F.array(*[F.lit(ADDED[n]) for n in names[OLDER:]]))).otherwise(F.raise_error(F.concat(F.lit("neither 34 nor 32 cells: "), "value")))
    rows = lines.where(kept).select(wide.alias("f"))

    def cell(i: int, name: str) -> Column:
        kind, text = COLUMNS[name], F.col("f")[i]
        fail = F.raise_error(F.concat(F.lit(f"not a {kind} in {name}: "), text)).cast(TYPES[kind])
        if kind == "list":
            return F.filter(F.split(text, ","), lambda x: x != "")
        if kind in ("str", "opt_str"):
            return F.when(text == "NA", fail).when(F.lit(kind == "opt_str") & (text == ""), F.lit(None)).otherwise(text)
        value = F.coalesce(text.try_cast(TYPES[kind]), fail)
        if kind.endswith("float"):
            value = F.when(text == "NA", float("nan")).otherwise(value)
        return F.when(F.lit(kind.startswith("opt")) & (text == ""), F.lit(None)).otherwise(value)

    return rows.select(*[cell(i, n).alias(n) for i, n in enumerate(names)])


SCHEMA = ", ".join(f"{n} {TYPES[k]}" for n, k in COLUMNS.items())


def result_json(rows: DataFrame) -> DataFrame:
    """value: a JSON object for each row, with null for NaN and for null."""
    clean = [F.when(~F.isnan(n), F.col(n)).alias(n) if k.endswith("float") else F.col(n) for n, k in COLUMNS.items()]
    return rows.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def read_result_json(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS of JSON lines: null is NaN for floats, for optional ones where the strategy is PE3; null in other fields that
    must be there is an error."""
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)

    def field(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "float":
            return F.coalesce(c, F.lit(float("nan")))
        if kind == "opt_float":
            return F.when(c.isNull() & (F.col("pe_strategy") == "PE3"), float("nan")).otherwise(c)
        if kind == "list":
            return F.coalesce(c, F.array().cast("array<string>"))
        return c if kind.startswith("opt") else F.coalesce(c, F.raise_error(F.lit(f"no {name}")).cast(TYPES[kind]))

    return rows.select(*[field(n, k).alias(n) for n, k in COLUMNS.items()])
