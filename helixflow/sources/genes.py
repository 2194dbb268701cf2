"""Gene tables as text, in two dialects, lists of targets, and what symbols and coordinates stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.edits import target_fields

_INT = r"^\s*[+-]?\d+\s*$"


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """f (the fields between tabs) and place (file, start of the split, line in it) of every line that is not empty and no
    comment. Places order lines as the files do, though many tasks read them."""
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")).alias("place"))
    text = F.regexp_replace("value", "\r$", "")
    return rows.where((text != "") & ~text.startswith("#")).select(F.split(text, "\t").alias("f"), "place")


def _field(i: int) -> Column:
    return F.trim(F.try_element_at("f", F.lit(i + 1)))


def _number(i: int) -> Column:
    return F.when(F.try_element_at("f", F.lit(i + 1)).rlike(_INT), F.trim(F.try_element_at("f", F.lit(i + 1))).try_cast("long"))


def _first(rows: DataFrame, columns: list[str], *before: Column) -> DataFrame:
    """One row for each symbol: the least by ``before``, then the first line. Combined in tasks, so no symbol is one task's."""
    best = F.min_by(F.struct(*columns), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(before)], "place"))
    return rows.groupBy("symbol").agg(best.alias("g")).select("symbol", "g.*")


GENES = ["chrom", "start", "end", "strand", "refseq_id"]


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """symbol, chrom, start, end (1-based, both inside), strand, refseq_id of tables with these six columns: the first row of a
    symbol counts. A header, and rows that are short or have no numbers where positions belong, are skipped."""
    rows = ordered_lines(spark, path).where((F.size("f") >= 6) & _number(2).isNotNull() & _number(3).isNotNull())
    strand = F.coalesce(F.nullif(_field(4), F.lit("")), F.lit("+"))
    return _first(rows.select(F.upper(_field(0)).alias("symbol"), _field(1).alias("chrom"), _number(2).alias("start"), _number(3).alias("end"), strand.alias("strand"), _field(5).alias("refseq_id"), "place"), GENES)


def _browser_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = ordered_lines(spark, path).where((F.size("f") >= 13) & _number(4).isNotNull() & _number(5).isNotNull())
    strand = F.coalesce(F.nullif(_field(3), F.lit("")), F.lit("+"))
    ends = lambda i: F.transform(F.filter(F.split(_field(i), ","), lambda x: x.rlike(_INT)), lambda x: x.cast("long"))
    out = rows.select(F.upper(_field(12)).alias("symbol"), _field(2).alias("chrom"), (_number(4) + 1).alias("start"), _number(5).alias("end"), strand.alias("strand"), _field(1).alias("refseq_id"), ends(9).alias("exon_starts"), ends(10).alias("exon_ends"), "place")
    return out.where("symbol <> '' and chrom <> '' and not contains(chrom, '_') and not startswith(chrom, 'chrUn')")


def read_browser_genes(spark: SparkSession, path: str) -> DataFrame:
    """The same of genome browsers' tables of 13 columns or more (bin, name, chrom, strand, txStart, txEnd, ..., name2),
    0-based there: the row with the longest span counts, the first of equals. Contigs with ``_`` in their names and unplaced
    ones are left out."""
    return _first(_browser_rows(spark, path), GENES, -(F.col("end") - F.col("start")))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """refseq_id, symbol, chrom, start, end, strand, exon_starts, exon_ends (0-based, half-open) of browsers' tables: the first
    row of an accession counts."""
    rows = _browser_rows(spark, path).withColumnRenamed("symbol", "name").withColumn("symbol", F.col("refseq_id"))
    found = _first(rows, ["name", "chrom", "start", "end", "strand", "exon_starts", "exon_ends"])
    return found.select(F.col("symbol").alias("refseq_id"), F.col("name").alias("symbol"), "chrom", "start", "end", "strand", "exon_starts", "exon_ends")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Either dialect: a browser's table where any row is one, else the short one."""
    found = read_browser_genes(spark, path)
    return read_gene_list(spark, path) if found.isEmpty() else found


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """target (upper case) for each name in lists with one or more names a line, parted by commas; ``#`` lines are comments.
    Repeated names stay."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#")).select(F.explode(F.split("value", ",")).alias("t"))
    return rows.select(F.upper(F.trim(F.regexp_replace("t", r"\s", " "))).alias("target")).where("target <> ''")


def resolved(targets: DataFrame, genes: DataFrame, flank: int = 0, strict: bool = True) -> DataFrame:
    """targets (target, others) with chrom, start, end (0-based, half-open, widened by ``flank`` but not below 0), strand
    and label. ``chr1:1,001-2,000`` stands for itself, on +; any other text is a symbol, whatever its case. A target without a
    name, and with ``strict`` an unknown symbol, is an error; without, unknown symbols have nulls."""
    name = F.upper(F.trim("target"))
    rows = targets.withColumn("_symbol", F.when(~F.col("target").contains(":"), name))
    known = genes.select(F.col("symbol").alias("_symbol"), F.struct("chrom", F.greatest(F.col("start") - 1 - flank, F.lit(0)).alias("start"), (F.col("end") + flank).alias("end"), "strand").alias("_gene"))
    rows = rows.join(known, "_symbol", "left")
    here = target_fields(F.when(F.col("_symbol").isNull(), F.col("target")), flank)
    missing = F.raise_error(F.concat(F.lit("unknown gene symbol: "), F.coalesce("target", F.lit("null")))).cast("string")
    lost = F.col("_gene").isNull() & F.col("_symbol").isNotNull()
    bad = (lost if strict else F.lit(False)) | F.col("target").isNull() | (name == "")
    part = lambda c: F.when(F.col("_symbol").isNull(), here[c]).otherwise(F.col(f"_gene.{c}")).alias(c)
    strand = F.when(bad, missing).when(F.col("_symbol").isNull(), "+").otherwise(F.col("_gene.strand"))
    return rows.select(*targets.columns, part("chrom"), part("start"), part("end"), strand.alias("strand"), F.coalesce("_symbol", F.trim("target")).alias("label"))


def absolute(rows: DataFrame, targets: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """rows with ``columns``, positions within targets (key, chrom, start), shifted to positions of the chromosome; chrom is added."""
    shift = targets.select(key, F.col("chrom").alias("_chrom"), F.col("start").alias("_start"))
    return rows.join(shift, key).withColumns({c: F.col(c) + F.col("_start") for c in columns}).withColumn("chrom", F.col("_chrom")).drop("_chrom", "_start")
