"""Sources, sinks, verification and streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixflow.jobs import verify
from helixflow.operators import trimming
from helixflow.sources import hits, sequences
from helixflow.streaming import trim


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 first\nacgt\nNN\n>chr2\n\n>chr3\r\nAC\r\nGT\r\n")
    got = sorted(tuple(r) for r in sequences.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("chr1", "ACGTNN"), ("chr2", ""), ("chr3", "ACGT")]


def test_fastq_round_trip(spark, tmp_path):
    text = "@r1 x\nACGT\n+\n@III\n\n@r2\n\n+\n\n"
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@r3\r\nAC\r\n+\r\nII\r\n")
    df = sequences.read_fastq(spark, str(tmp_path))
    assert sorted((r.read_id, r.seq, r.qual) for r in df.collect()) == [("r1", "ACGT", "@III"), ("r2", "", ""), ("r3", "AC", "II")]
    lines = sorted(r.value for r in sequences.fastq_lines(df).collect())
    assert lines[0] == "@r1 x\nACGT\n+\n@III"
    (tmp_path / "bad.fastq").write_text("@r\nACG\n+\nII\n")
    with pytest.raises(Exception, match="broken record"):
        sequences.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()


def test_hit_dialects(spark, tmp_path):
    full = "guide_id\tbulge_type\tcrrna\tdna\tchrom\tstart\tstrand\tmismatches\tbulge_size\ng\tX\tAC\tAc\tchr2\t5\t+\t1\t0\n"
    (tmp_path / "a.tsv").write_text("##note\n" + full)
    (tmp_path / "b.tsv").write_text("AC\tchr1\t7\tAC\t-\t0\n")
    df = hits.read_hits(spark, str(tmp_path))
    assert [r.guide_id for r in hits.normalised(df).collect()] == ["AC", "g"]
    lines = [r.value for r in hits.hit_lines(df.where("chrom = 'chr2'")).collect()]
    assert "\n".join(lines) + "\n" == full
    (tmp_path / "c.tsv").write_text("a\tb\n")
    with pytest.raises(Exception, match="neither nine nor six"):
        hits.read_hits(spark, str(tmp_path)).collect()


def test_verify(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert verify.compare(a, a)["equal"]
    out = verify.compare(a, b)
    assert not out["equal"] and [(d["k"], d["v"], d["left_rows"], d["right_rows"]) for d in out["differences"]] == [(1, "x", 2, 1), (2, "y", 1, 0), (2, "z", 0, 1)]


def test_streams_equal_batches(spark, tmp_path):
    reads = spark.createDataFrame([("ACGTTTACTGG", "I" * 11), ("GGTTACT", "I" * 7), ("AC", "II")] * 3, "seq string, qual string")
    folder = str(tmp_path / "in")
    reads.repartition(3).write.parquet(folder)
    stream = trim.trimmed_stream(trim.stream_reads(spark, folder, reads.schema), "TTACT")

    def finish(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.table(name).collect())

    batch = trimming.trim_reads(reads, "TTACT")
    assert finish(stream, "append", "trimmed") == sorted(tuple(r) for r in batch.collect())
    assert finish(trim.running_histogram(stream), "complete", "histogram") == sorted(tuple(r) for r in trimming.trim_histogram(batch).collect())


def test_windowed_events(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    folder = str(tmp_path / "events")
    events.repartition(2).write.parquet(folder)
    stream = trim.windowed_events(trim.stream_reads(spark, folder, events.schema), "3650 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("events")).first()[0] == events.count()
