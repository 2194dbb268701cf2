"""FASTA and FASTQ as DataFrames, read by Spark's own readers, so that any store Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom (first word of the header), seq (upper case) of every record. Records are split at ``\\n>``, so large files
    are dealt over tasks by record; text before the first header becomes a record, as the separator alone tells records apart."""
    rows = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.length(head) + 2, 2_000_000_000)).otherwise("")
    return rows.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("chrom"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


FASTQ = T.StructType().add("path", T.StringType()).add("place", T.LongType()).add("header", T.StringType()).add("read_id", T.StringType()).add("seq", T.StringType()).add("qual", T.StringType())


def read_fastq(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """path, place, header, read_id, seq, qual of every record; ``.gz`` files are unpacked. One task reads a file, as
    compressed files can't be split; blank lines before a header are skipped, unless ``strict``. Broken records fail."""
    import pyarrow as pa

    def records(name: str, data: bytes):
        import gzip

        text = (gzip.decompress(data) if name.endswith(".gz") else data).decode().replace("\r\n", "\n")
        lines = (text.rstrip("\n") if strict else text.removesuffix("\n")).split("\n")
        at = place = 0
        while at < len(lines) and lines != [""]:
            if not lines[at].strip() and not strict:
                at += 1
                continue
            part = lines[at : at + 4]
            if len(part) < 4 or not part[0].startswith("@") or not part[2].startswith("+") or len(part[1]) != len(part[3]):
                raise ValueError(f"broken record at line {at + 1} of {name}")
            header = part[0][1:]
            yield name, place, header, (header.split() or [""])[0], part[1], part[3]
            at, place = at + 4, place + 1

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(records(name, data))
                for k in range(0, len(found), 20_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(FASTQ.names, r, strict=True)) for r in found[k : k + 20_000]], schema=pa.schema([(f.name, pa.int64() if f.name == "place" else pa.string()) for f in FASTQ.fields]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FASTQ)


def fastq_lines(reads: DataFrame) -> DataFrame:
    """value: four lines for each read, for ``write.text``."""
    return reads.select(F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))
