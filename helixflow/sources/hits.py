"""Off-target hit tables as tab-separated text, in three dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("guide_id", "bulge_type", "crrna", "dna", "chrom", "start", "strand", "mismatches", "bulge_size")
KINDS = {"start": "long", "mismatches": "int", "bulge_size": "int"}
ORDER = ("chrom", "start", "mismatches", "guide_id", "strand")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS of every row. Nine fields are the full dialects; six (crRNA, chromosome, position, DNA, direction,
    mismatches) the legacy one, without bulges, named by the crRNA. Headers and ``##`` lines are skipped; a row of any
    other width, or with a strand other than + and -, fails."""
    rows = spark.read.text(path).where(~F.col("value").startswith("##") & (F.trim("value") != "")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))
    rows = rows.where(~F.lower(F.regexp_replace(F.col("f")[0], "^#", "")).isin("id", "guide_id", "crrna"))
    n = F.size("f")
    six = dict(zip(("crrna", "chrom", "start", "dna", "strand", "mismatches"), range(6), strict=True))
    nine = {c: i for i, c in enumerate(COLUMNS)}
    fixed = {"guide_id": F.col("f")[0], "bulge_type": F.lit("X"), "bulge_size": F.lit("0")}
    bad = F.raise_error(F.concat(F.lit("neither nine nor six fields: "), F.array_join("f", "|")))
    out = [F.when(n == 9, F.col("f")[nine[c]]).when(n == 6, F.col("f")[six[c]] if c in six else fixed[c]).otherwise(bad).cast(KINDS.get(c, "string")).alias(c) for c in COLUMNS]
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(F.raise_error(F.concat(F.lit("not a strand: "), F.coalesce("strand", F.lit("null")))))
    return rows.select(*out).withColumn("strand", strand)


def normalised(hits: DataFrame) -> DataFrame:
    """Hits in the canonical order, made total by the remaining columns."""
    return hits.orderBy(*ORDER, *[c for c in COLUMNS if c not in ORDER])


def hit_lines(hits: DataFrame) -> DataFrame:
    """value: the header, then one line for each hit, in order."""
    spark = hits.sparkSession
    head = spark.range(1).select(F.lit("\t".join(COLUMNS)).alias("value"), F.lit(0).alias("_part"), *[F.lit(None).cast(KINDS.get(c, "string")).alias(c) for c in COLUMNS])
    body = hits.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS]).alias("value"), F.lit(1).alias("_part"), *COLUMNS)
    return head.unionByName(body).orderBy("_part", *ORDER, *[c for c in COLUMNS if c not in ORDER]).select("value")
