"""FASTA and FASTQ by byte ranges: one plain file is read by many tasks, also inside a record or a line.

``fasta_segments`` and ``fastq_records`` are Python data sources. They open files through ``pyarrow.fs``, so a path is a local one or a
URI that it knows; ``sequences`` reads those that only Spark knows, by whole records. Filters on file and byte_start choose
the byte ranges that are opened at all.
"""

from __future__ import annotations

import gzip
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BLOCK_BYTES = 32 << 20
#: A header line is shorter than this, so a look back tells whether a range starts within one.
HEADER_BYTES = 1 << 16
#: Indexes with more ranges than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int  # of the file for one that can't be split


def files_below(path: str) -> list[tuple[str, int]]:
    """(file, size) of a file, or of all files below a folder whose names don't start with _ or a dot."""
    from pyarrow import fs

    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    kept = [f for f in found if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(inner) :].split("/"))]
    return sorted((path.rstrip("/") + f.path[len(inner.rstrip("/")) :], f.size) for f in kept)


def opened(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[6:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def reading(path: str):
    system, inner = opened(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


TESTS = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x}


class RangeReader(DataSourceReader):
    """Byte ranges of the files below a path; filters on ``file`` and ``byte_start`` leave some out."""

    def __init__(self, options):
        self.path = options["path"]
        self.block = int(options.get("blockbytes", options.get("blockBytes", BLOCK_BYTES)))
        self.index = str(options.get("index", "false")).lower() == "true"
        self.kept = []
        if self.block < 1:
            raise ValueError("blockBytes must be positive")

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and f.attribute in (("file",), ("byte_start",)):
                self.kept.append((f.attribute[0], type(f), f.value))
            yield f  # Spark tests it as well

    def partitions(self):
        out = []
        for file, size in files_below(self.path):
            step = size if file.endswith(".gz") else self.block
            out += [Range(file, at, min(at + step, size)) for at in range(0, size, max(step, 1))]
        return [r for r in out if all(TESTS[kind](r.file if name == "file" else r.start, value) for name, kind, value in self.kept)] or [Range("", 0, 0)]


class FastaReader(RangeReader):
    def read(self, part):
        import pyarrow as pa

        if not part.file:
            return
        names = ["file", "byte_start", "part", "contig", "size", "bases"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        for k, (contig, bases) in enumerate(fasta_segments(part.file, part.start, part.end)):
            row = [part.file, part.start, k, contig, len(bases), None if self.index else bases.decode("ascii")]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)


def fasta_segments(file: str, start: int, end: int):
    """(name, bases) of the sequences, or parts of one, that lie in the range; the name is None for what goes on from
    before. A range has the headers that start in it, and the bases whose bytes lie in it."""
    if file.endswith(".gz"):
        with gzip.open(reading(file)) as f:
            data = f.read()
        start = 0
    else:
        with reading(file) as f:
            back = min(start, HEADER_BYTES)
            f.seek(start - back)
            data = f.read(back + end - start)
            line = data.rfind(b"\n", 0, back) + 1  # where the line of the first byte starts
            inside = line < back and data[line : line + 1] == b">" and (line > 0 or start == back)
            last = data.rfind(b"\n") + 1
            if data[last : last + 1] == b">" and last >= back:
                data += f.readline(HEADER_BYTES)
                if not data.endswith(b"\n") and len(data) - last > HEADER_BYTES:
                    raise ValueError(f"a header of more than {HEADER_BYTES} bytes in {file}")
            if inside:
                stop = data.find(b"\n", back)
                back = len(data) if stop < 0 else stop + 1
            new_line = back == 0 or data[back - 1 : back] == b"\n"
            data = data[back:]
    if start == 0:
        new_line = True
    pieces = data.split(b"\n>")
    clean = lambda b: b.translate(None, b" \t\r\n\x0b\x0c").upper()
    first = pieces[0]
    if new_line and first.startswith(b">"):
        pieces[0] = first[1:]
    else:
        bases = clean(first)
        if bases and start == 0:
            raise ValueError(f"text before the first header of {file}")
        if bases:
            yield None, bases
        pieces = pieces[1:]
    for piece in pieces:
        head, _, body = piece.partition(b"\n")
        yield (head.split() or [b""])[0].decode(), clean(body)


class FastaSource(DataSource):
    @classmethod
    def name(cls):
        return "fasta_segments"

    def schema(self):
        return "file string, byte_start long, part int, contig string, size long, bases string"

    def reader(self, schema):
        return FastaReader(self.options)


class FastqReader(RangeReader):
    def read(self, part):
        import pyarrow as pa

        if not part.file:
            return
        rows = []
        schema = pa.schema([("file", pa.string()), ("byte_start", pa.int64()), ("byte_at", pa.int64()), *((c, pa.string()) for c in ("header", "read_id", "seq", "qual"))])
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for at, header, seq, qual in fastq_records(part.file, part.start, part.end):
            rows.append((part.file, part.start, at, header, (header.split() or [""])[0], seq, qual))
            if len(rows) == 10_000:
                yield pack()
                rows = []
        if rows:
            yield pack()


def fastq_records(file: str, start: int, end: int):
    """(offset, header, bases, qualities) of the records whose headers start in the range. Blank lines before a header are
    skipped, a broken record is an error. A line is a header if it starts with @ and the next but one with +: the next but
    one of a line of qualities has bases."""
    packed = file.endswith(".gz")
    with gzip.open(reading(file)) if packed else reading(file) as f:
        at = 0
        if start and not packed:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        held: list[bytes] = []  # lines read ahead

        def line(k: int) -> bytes:
            while len(held) <= k and (more := f.readline()):
                held.append(more)
            return held[k] if k < len(held) else b""

        if start and not packed:
            for k in range(8):
                if line(k)[:1] == b"@" and line(k + 2)[:1] == b"+":
                    at += sum(map(len, held[:k]))
                    del held[:k]
                    break
                if not line(k):
                    return  # the file ends first
            else:
                if at < end:
                    raise ValueError(f"no record found from byte {at} of {file} on")
        while (packed or at < end) and line(0):
            if not line(0).strip():
                at += len(held.pop(0))
                continue
            line(3)
            part = [x.rstrip(b"\r\n").decode() for x in held[:4]]
            if len(part) == 3 and not part[1]:
                part.append("")  # the last, empty line of the file
            if len(part) < 4 or part[0][:1] != "@" or part[2][:1] != "+" or len(part[1]) != len(part[3]):
                raise ValueError(f"broken record at byte {at} of {file}")
            yield at, part[0][1:], part[1], part[3]
            at += sum(map(len, held[:4]))
            del held[:4]


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq_records"

    def schema(self):
        return "file string, byte_start long, byte_at long, header string, read_id string, seq string, qual string"

    def reader(self, schema):
        return FastqReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session, with both sources known and filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastaSource, FastqSource):
        spark.dataSource.register(source)
    return spark


def read_fastq_ranges(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, byte_at, header, read_id, seq, qual of every record. Order by file and byte_at gives the order of the files."""
    return registered(spark).read.format("fastq_records").option("blockBytes", block_bytes).load(path).drop("byte_start")


def _segments(spark, path, block_bytes, index):
    return registered(spark).read.format("fasta_segments").option("blockBytes", block_bytes).option("index", str(index).lower()).load(path)


def fasta_index(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, byte_start, part, contig, start, size, goes_on (from the range before): which bases of which contig each segment
    holds. A row for each contig and range, without bases; the windows that carry a contig over ranges see two numbers a range."""
    rows = _segments(spark, path, block_bytes, True).drop("bases")
    tail, goes_on = F.max_by(F.struct("contig", "size"), "part"), F.max(F.when(F.col("contig").isNull(), F.col("size")))
    blocks = rows.groupBy("file", "byte_start").agg(tail.alias("tail"), goes_on.alias("goes_on"))
    before = Window.partitionBy("file").orderBy("byte_start").rowsBetween(Window.unboundedPreceding, -1)
    adds = F.when(F.col("tail.contig").isNotNull(), F.col("tail.size")).otherwise(F.coalesce("goes_on", F.lit(0)))
    blocks = blocks.withColumn("sum", F.coalesce(F.sum(adds).over(before), F.lit(0)))
    named = F.col("tail.contig").isNotNull()
    blocks = blocks.select("file", "byte_start", F.last("tail.contig", True).over(before).alias("carried"), (F.col("sum") - F.last(F.when(named, F.col("sum")), True).over(before)).alias("offset")).where("carried is not null")
    joined = rows.join(blocks, ["file", "byte_start"], "left")
    new = F.col("contig").isNotNull()
    return joined.select("file", "byte_start", "part", F.coalesce("contig", "carried").alias("contig"), F.when(new, 0).otherwise(F.col("offset")).cast("long").alias("start"), "size", (~new).alias("goes_on"))


def fasta_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, index: DataFrame | None = None) -> DataFrame:
    """contig, start, bases of every segment; give ``index`` where it is at hand (its block_bytes must be the same). Only segments that go on from another
    range need the index, and bases are shuffled only where it is large."""
    index = fasta_index(spark, path, block_bytes) if index is None else index
    carried = index.where("goes_on").select("file", "byte_start", F.lit(0).alias("part"), F.col("contig").alias("carried"), "start")
    if carried.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        carried = F.broadcast(carried)
    rows = _segments(spark, path, block_bytes, False).join(carried, ["file", "byte_start", "part"], "left")
    return rows.select(F.coalesce("carried", "contig").alias("contig"), F.coalesce("start", F.lit(0)).alias("start"), "bases")


def contig_slice(spark: SparkSession, path: str, index: DataFrame, contig: str, start: int, end: int, block_bytes: int = BLOCK_BYTES) -> str:
    """The bases [start, end) of a contig, from the ranges that hold them alone. An unknown contig, a range without bases or one
    past the end is an error; of equal names in several places the first counts."""
    if start < 0 or end <= start:
        raise ValueError(f"not a range: [{start}, {end})")
    own = index.where(F.col("contig") == contig)
    place = own.agg(F.min(F.struct("file", F.when(F.col("start") == 0, F.col("byte_start")).alias("at")))).first()[0]
    if place is None:
        raise ValueError(f"no contig {contig!r}")
    hit = own.where((F.col("file") == place.file) & (F.col("start") < end) & (F.col("start") + F.col("size") > start)).orderBy("byte_start", "part").collect()
    if not hit:
        raise ValueError(f"[{start}, {end}) is past the end of {contig!r}")
    rows = _segments(spark, path, block_bytes, False).where((F.col("file") == place.file) & F.col("byte_start").isin(sorted({r.byte_start for r in hit})))
    bases = {(r.byte_start, r.part): r.bases for r in rows.collect()}
    out, at = [], start
    for r in hit:
        if r.start <= at < r.start + r.size:
            out.append(bases[r.byte_start, r.part][at - r.start : end - r.start])
            at += len(out[-1])
    if at < end:
        raise ValueError(f"[{start}, {end}) is past the end of {contig!r}")
    return "".join(out)


def sliced(blocks: DataFrame, requests: DataFrame, width: int = 1 << 20) -> DataFrame:
    """requests (contig, start, end, others) with seq, the bases asked for; requests that reach past a contig's end, or ask for none, are
    left out. Blocks and requests meet in buckets of positions, each pair in its first common one."""
    first = lambda c: F.floor(F.col(c) / width)
    held = blocks.where(F.length("bases") > 0).select("contig", F.col("start").alias("_start"), "bases").withColumn("_end", F.col("_start") + F.length("bases"))
    held = held.withColumn("_bucket", F.explode(F.sequence(first("_start"), F.floor((F.col("_end") - 1) / width))))
    asked = requests.where("start >= 0 and end > start").withColumn("_bucket", F.explode(F.sequence(first("start"), F.floor((F.col("end") - 1) / width))))
    met = asked.join(held, ["contig", "_bucket"]).where((F.col("_start") < F.col("end")) & (F.col("_end") > F.col("start")) & (F.col("_bucket") == F.greatest(first("_start"), first("start"))))
    low = F.greatest("start", "_start")
    part = F.substring("bases", (low - F.col("_start") + 1).cast("int"), (F.least("end", "_end") - low).cast("int"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("s")))), lambda p: p["s"]), "")
    return met.groupBy(*requests.columns).agg(seq.alias("seq")).where(F.length("seq") == F.col("end") - F.col("start"))
