"""Byte ranges of FASTA and FASTQ files against readers of whole files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from helixflow.sources import sequences, splits


def fasta(seed, contigs=9, ends=("\n", "\r\n")):
    draw = random.Random(seed)
    text, seqs = "", {}
    for i in range(contigs):
        seq = "".join(draw.choice("acgtN") for _ in range(draw.choice([0, 1, 59, 60, 61, 400, 3000])))
        width, end = draw.choice([7, 60, 10_000]), draw.choice(ends)
        text += f">c{i} {'>' * draw.randrange(3)} note{end}" + "".join(seq[k : k + width] + end for k in range(0, len(seq), width)) + draw.choice(["", end])
        seqs[f"c{i}"] = seq.upper()
    return text, seqs


@pytest.mark.parametrize("block", [1, 13, 100, 1 << 20])
def test_fasta_ranges(tmp_path, block):
    """Whatever the ranges, segments put together give each sequence once."""
    for seed in range(6):
        text, seqs = fasta(seed)
        path = tmp_path / f"{seed}.fa"
        path.write_text(text, newline="")
        got = []
        for at in range(0, len(text), block):
            for contig, bases in splits.fasta_segments(str(path), at, min(at + block, len(text))):
                if contig is None:
                    got[-1][1] += bases.decode()
                else:
                    got.append([contig, bases.decode()])
        assert dict(map(tuple, got)) == seqs and len(got) == len(seqs)


def test_index_and_slices(spark, tmp_path):
    for seed in (1, 2):
        text, _ = fasta(seed)
        (tmp_path / f"{seed}.fa").write_text(text.replace(">c", f">s{seed}c"), newline="")
    want = {f"s{seed}{c}": s for seed in (1, 2) for c, s in fasta(seed)[1].items()}
    path, block = str(tmp_path), 150
    index = splits.fasta_index(spark, path, block).cache()
    sizes = {r.contig: r.n for r in index.groupBy("contig").agg(F.sum("size").alias("n")).collect()}
    assert sizes == {c: len(s) for c, s in want.items()}
    for r in splits.fasta_blocks(spark, path, block, index).collect():
        assert want[r.contig][r.start : r.start + len(r.bases)] == r.bases
    assert sum(len(r.bases) for r in splits.fasta_blocks(spark, path, block).collect()) == sum(map(len, want.values()))
    whole = {r.chrom: r.seq for r in sequences.read_fasta(spark, path).collect()}
    assert whole == want
    long = max(want, key=lambda c: len(want[c]))
    for start, end in ((0, 1), (100, 1200), (len(want[long]) - 5, len(want[long]))):
        assert splits.contig_slice(spark, path, index, long, start, end, block) == want[long][start:end]
    for contig, start, end in (("none", 0, 5), (long, 5, 5), (long, -1, 5), (long, 0, len(want[long]) + 1), (long, 10**9, 10**9 + 1)):
        with pytest.raises(ValueError):
            splits.contig_slice(spark, path, index, contig, start, end, block)
    asked = [(i, c, len(s) // 3, 2 * len(s) // 3) for i, (c, s) in enumerate(want.items())] + [(99, long, 0, 10**6), (98, "none", 0, 5)]
    found = splits.sliced(splits.fasta_blocks(spark, path, block, index), spark.createDataFrame(asked, "id int, contig string, start long, end long"), 64)
    assert {r.id: r.seq for r in found.collect()} == {i: want[c][a:b] for i, c, a, b in asked if c in want and a < b <= len(want[c])}


def test_only_asked_ranges_are_opened(spark, tmp_path):
    text = ">a\n" + "ACGT" * 5000 + "\n>b\n" + "GGCC" * 5000 + "\n"
    (tmp_path / "x.fa").write_text(text)
    rows = splits._segments(spark, str(tmp_path), 1000, False)
    assert rows.rdd.getNumPartitions() == -(-len(text) // 1000)
    some = rows.where(F.col("byte_start").isin(3000, 7000))
    assert some.rdd.getNumPartitions() == 2 and sorted(r.byte_start for r in some.collect()) == [3000, 7000]
    assert rows.where("byte_start > 10000000").collect() == []
    (tmp_path / "y.fa").write_text("ACGT\n>c\nA\n")
    with pytest.raises(Exception, match="before the first header"):
        splits.fasta_index(spark, str(tmp_path)).collect()


def fastq(seed, n):
    draw = random.Random(seed)
    text, rows = "", []
    for i in range(n):
        size = draw.choice([0, 1, 30, 70])
        seq = "".join(draw.choice("ACGTN") for _ in range(size))
        qual = "".join(draw.choice("@+I#") for _ in range(size))
        end = "\n" if seed % 2 else "\r\n"
        rows.append((len(text), f"r{i} x@", seq, qual))
        text += f"@r{i} x@{end}{seq}{end}+{draw.choice(['', 'r'])}{end}{qual}{end}"
        if size and draw.random() < 0.2:
            text += end
            rows[-1] = rows[-1][:1] + rows[-1][1:]
    return text, rows


@pytest.mark.parametrize("block", [1, 17, 256, 1 << 20])
def test_fastq_ranges(tmp_path, block):
    for seed in range(4):
        text, rows = fastq(seed, 40)
        path = tmp_path / f"{seed}.fastq"
        path.write_text(text, newline="")
        got = [r for at in range(0, len(text), block) for r in splits.fastq_records(str(path), at, min(at + block, len(text)))]
        assert got == rows


def test_fastq_source(spark, tmp_path):
    text, rows = fastq(1, 500)
    (tmp_path / "a.fastq").write_text(text, newline="")
    with gzip.open(tmp_path / "b.fastq.gz", "wt", newline="") as f:
        f.write(text)
    df = splits.read_fastq_ranges(spark, str(tmp_path), 1000)
    assert df.rdd.getNumPartitions() == -(-len(text) // 1000) + 1
    got = sorted((r.file.endswith("gz"), r.byte_at, r.header, r.seq, r.qual) for r in df.collect())
    assert got == sorted((z, *r) for r in rows for z in (False, True))
    old = sequences.read_fastq(spark, str(tmp_path / "a.fastq")).select("header", "read_id", "seq", "qual")
    new = splits.read_fastq_ranges(spark, str(tmp_path / "a.fastq"), 777).select("header", "read_id", "seq", "qual")
    assert old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()
    (tmp_path / "bad.fastq").write_text("@r\nACG\n+\nII\n")
    with pytest.raises(Exception, match="broken record"):
        splits.read_fastq_ranges(spark, str(tmp_path / "bad.fastq")).collect()
    with pytest.raises(Exception, match="none"):
        splits.read_fastq_ranges(spark, str(tmp_path / "none")).collect()
