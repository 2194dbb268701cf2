"""Streams of chunks against whole sequences, scores on streams."""

import random

import pytest
from pyspark.sql import functions as F

from helixflow.operators import scoring, windows
from helixflow.streaming import carry


@pytest.mark.parametrize("k", [1, 2, 7, 15])
def test_parts_in_any_order(k):
    draw = random.Random(k)
    for _ in range(60):
        seq = "".join(draw.choice("ACGTN") for _ in range(draw.randrange(60)))
        cuts = sorted(draw.randrange(len(seq) + 1) for _ in range(draw.randrange(9)))
        parts = list(enumerate(seq[a:b] for a, b in zip([0, *cuts], [*cuts, len(seq)], strict=True)))
        todo = parts + draw.sample(parts, min(2, len(parts)))
        draw.shuffle(todo)
        state, got = (0, 0, "", []), []
        while todo:
            n = draw.randrange(1, len(todo) + 1)
            state, out = carry.advanced(state, todo[:n], k)
            todo = todo[n:]
            got += [(at + i, text[i : i + k]) for at, text in out for i in range(len(text) - k + 1)]
        assert got == [(i, seq[i : i + k]) for i in range(len(seq) - k + 1)] and len(state[2]) <= k - 1 and not state[3]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    """Every sequence split over batches, some parts early, one twice; a window may lie in three chunks."""
    draw = random.Random(6)
    seqs = {i: "".join(draw.choice("ACGT" if draw.random() < 0.97 else "N") for _ in range(draw.randrange(200))) for i in range(25)}
    rows = []
    for i, seq in seqs.items():
        cuts = sorted(draw.randrange(len(seq) + 1) for _ in range(6))
        rows += [(i, p, seq[a:b]) for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(seq)], strict=True))]
    rows += rows[:5]
    draw.shuffle(rows)
    for b in range(3):
        spark.createDataFrame(rows[b::3], "seq_id int, part int, bases string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq_id int, part int, bases string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = carry.chunk_windows(stream, 9).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.table("carried")
    whole = spark.createDataFrame(list(seqs.items()), "seq_id int, seq string")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, windows.kmers(whole, 9, ["seq_id"]).select("seq_id", "pos", "kmer").collect()))
    counts = lambda df: sorted(map(tuple, df.collect()))
    assert counts(found.groupBy("kmer").count()) == counts(windows.kmers(whole, 9, ["seq_id"]).groupBy("kmer").count())


def test_scores_on_a_stream(spark, tmp_path):
    draw = random.Random(7)
    rows = [(i, "".join(draw.choice("ACGT") for _ in range(20)), "".join(draw.choice("ACGT") for _ in range(20)) + "AGG") for i in range(30)]
    for b in range(2):
        spark.createDataFrame(rows[b::2], "id int, spacer string, site string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, spacer string, site string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = carry.scored_stream(stream).writeStream.format("memory").queryName("scored_hits").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = spark.createDataFrame(rows, "id int, spacer string, site string").withColumn("score", scoring.mismatch_score(F.col("spacer"), F.col("site")))
    assert sorted(map(tuple, spark.table("scored_hits").collect())) == sorted(map(tuple, want.collect()))
