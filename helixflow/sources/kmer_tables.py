"""k-mer counts as other tools keep them: fixed-width binary records, and FASTA with counts for headers."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.dna import unpack
from .splits import RangeReader, files_below, opened, registered

HEAD, RECORD = 8, 16
#: Records that are read or written at once.
CHUNK = 1 << 18


class KmerReader(RangeReader):
    """A file is the number of records and the records, packed k-mer and count, all unsigned 64-bit little-endian. A range has
    the records that start in it."""

    def read(self, part):
        import pyarrow as pa

        if not part.file:
            return
        system, inner = opened(part.file)
        with system.open_input_file(inner) as f:
            n = int(np.frombuffer(f.read(HEAD).ljust(HEAD, b"\0"), "<u8")[0])
            if f.size() != HEAD + RECORD * n:
                raise ValueError(f"{part.file} should have {HEAD + RECORD * n} bytes, not {f.size()}")
            first, stop = (max(-(-(at - HEAD) // RECORD), 0) for at in (part.start, part.end))
            f.seek(HEAD + RECORD * first)
            for at in range(first, stop, CHUNK):
                rows = np.frombuffer(f.read(RECORD * (min(at + CHUNK, stop) - at)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(rows)), pa.array(np.full(len(rows), part.start)), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["file", "byte_start", "packed", "count"])


@dataclass
class Part(WriterCommitMessage):
    temporary: str
    final: str


class KmerWriter(DataSourceArrowWriter):
    """One file for each task, named when the job commits, so that a task that is run again leaves no second one."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}"
        temporary = f"{self.path}/_temporary/{name}-{uuid.uuid4().hex}"
        system, inner = opened(temporary)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        n = 0
        # The number of records comes first, so they are kept aside until it is known.
        with system.open_output_stream(inner + ".rows") as f:
            for batch in batches:
                rows = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("packed", "count")], axis=1)
                f.write(np.ascontiguousarray(rows, "<i8").tobytes())
                n += len(rows)
        with system.open_output_stream(inner) as out, system.open_input_stream(inner + ".rows") as f:
            out.write(np.array([n], "<u8").tobytes())
            while data := f.read(RECORD * CHUNK):
                out.write(data)
        system.delete_file(inner + ".rows")
        return Part(temporary, f"{self.path}/{name}")

    def commit(self, messages):
        system, inner = opened(self.path)
        if self.overwrite:
            for file, _ in files_below(self.path):
                system.delete_file(opened(file)[1])
        for m in messages:
            system.move(opened(m.temporary)[1], opened(m.final)[1] + ("" if self.overwrite else f"-{uuid.uuid4().hex[:8]}"))
        system.delete_dir(f"{inner}/_temporary")

    def abort(self, messages):
        system, _ = opened(self.path)
        for m in messages:
            if m:
                system.delete_file(opened(m.temporary)[1])


class KmerSource(DataSource):
    @classmethod
    def name(cls):
        return "kmer_counts"

    def schema(self):
        return "file string, byte_start long, packed long, count long"

    def reader(self, schema):
        return KmerReader(self.options)

    def writer(self, schema, overwrite):
        return KmerWriter(self.options["path"], overwrite)


def _known(spark: SparkSession) -> SparkSession:
    registered(spark).dataSource.register(KmerSource)
    return spark


def read_kmer_blobs(spark: SparkSession, path: str, block_bytes: int = 32 << 20) -> DataFrame:
    """packed, count of all records, one plain file read by many tasks. Counts beyond 2**63 - 1 come out negative."""
    return _known(spark).read.format("kmer_counts").option("blockBytes", block_bytes).load(path).select("packed", "count")


def write_kmer_blobs(counts: DataFrame, path: str) -> None:
    """counts (packed, count) as files in the order of k-mers, each a blob of its own."""
    _known(counts.sparkSession)
    rows = counts.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("byte_start"), F.col("packed").cast("long").alias("packed"), F.col("count").cast("long").alias("count"))
    rows.repartitionByRange("packed").sortWithinPartitions("packed").write.format("kmer_counts").mode("append").save(path)


def kmer_fasta(counts: DataFrame, k: int) -> DataFrame:
    """value: ``>count``, a line end and the k-mer, for ``write.text``."""
    return counts.select(F.concat(F.lit(">"), F.col("count").cast("string"), F.lit("\n"), unpack(F.col("packed"), k)).alias("value"))


def read_kmer_fasta(spark: SparkSession, path: str) -> DataFrame:
    """kmer (upper case), count of each record; any split of a file begins at a ``>``. A header that is no number is an error."""
    rows = spark.read.text(path, lineSep=">").where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n", 2)
    count = F.coalesce(F.trim(lines[0]).try_cast("long"), F.raise_error(F.concat(F.lit("not a count: "), lines[0])).cast("long"))
    return rows.select(F.upper(F.regexp_replace(lines[1], r"\s", "")).alias("kmer"), count.alias("count"))
