"""Places of whole tables, agreement of records and scores, score tables."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from helixflow.operators import agreement
from helixflow.sources import scores


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places(spark, n):
    draw = random.Random(n)
    rows = [(draw.choice([None, *range(40)]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "a int, b long").repartition(7)
    got = sorted((r.place, r.a, r.b) for r in agreement.numbered(df, ["a", "b"]).collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r[1:] for r in got] == want and [r[0] for r in got] == list(range(n))
    with pytest.raises(ValueError):
        agreement.numbered(df, [])


def test_records(spark):
    df = lambda rows: spark.createDataFrame(rows, "k long, v string, place string")
    left = [(i, f"v{i % 7}" if i % 5 else None, "") for i in range(1000)]
    one = lambda a, b, **k: agreement.record_agreement(df(a), df(b), ["k"], ["k", "v"], **k).first()
    r = one(left, left)
    assert (r.left_rows, r.right_rows, r.equal_rows, r.fraction, r.verdict) == (1000, 1000, 1000, 1.0, "PASS")
    r = one(left, [(k, "x" if k == 17 else v, p) for k, v, p in left])
    assert (r.equal_rows, r.verdict) == (999, "DIVERGE")
    r = one(left, left[1:])  # all places are shifted
    assert (r.right_rows, r.equal_rows, r.verdict) == (999, 0, "FAIL")
    r = one(left, left[:-3])
    assert (r.equal_rows, r.fraction, r.verdict) == (997, 0.997, "DIVERGE")
    assert one([], []).verdict == "FAIL" and one([], left).equal_rows == 0


def test_scores(spark):
    df = lambda rows: spark.createDataFrame(rows, "k long, score double")
    left = [(i, i / 7) for i in range(100)] + [(100, None), (101, math.nan)]
    run = lambda b, e=None: agreement.score_agreement(df(left), df(b), ["k"], ["k"], epsilon=e).first()
    r = run(left)
    assert (r.records, r.identity_mismatches, r.beyond, r.max_abs_diff, r.equal) == (102, 0, 0, 0.0, True)
    moved = [(k, s + 1e-7 if k == 3 else s) for k, s in left]
    assert not run(moved).equal and run(moved, 1e-6).equal and run(moved, 1e-6).max_abs_diff == pytest.approx(1e-7, rel=1e-3)
    assert run(left[:-1]).identity_mismatches == 1 and run([(k, 0.0 if k > 99 else s) for k, s in left], 9.0).beyond == 2
    with pytest.raises(ValueError):
        run(left, -1.0)


def test_fixed_is_exact(spark):
    draw = random.Random(5)
    values = [0.0, -0.0, 0.5, 5e-7, 1.5e-6, 2.5e-6, 0.0000005, 1 / 64, 3 / 128, -1234567.0000015, 123456789.1234565, *[draw.uniform(-2, 2) for _ in range(500)]]
    values += [k / 2**20 for k in range(200)] + [struct.unpack("d", struct.pack("Q", draw.getrandbits(62)))[0] % 1e9 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", scores.fixed(F.col("v")).alias("t"))
    assert [(r.v, r.t) for r in df.collect() if r.t != "%.6f" % r.v] == []


def test_score_tables(spark, tmp_path):
    rows = [(f"g{i}", "X", "ACGT", "ACgT", f"chr{i % 3}", i * 7 % 50, "+-"[i % 2], i % 4, 0, i / 13) for i in range(60)]
    df = spark.createDataFrame(rows, "guide_id string, bulge_type string, crrna string, dna string, chrom string, start long, strand string, mismatches int, bulge_size int, score double").repartition(5)
    scores.write_scores(df, f"{tmp_path}/out")
    back = scores.read_scores(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect())) == sorted((*r[:9], float("%.6f" % r[9])) for r in rows)
    parts = [[line for line in f.read_text().splitlines() if not line.startswith("guide_id")] for f in sorted((tmp_path / "out").glob("part*"))]
    lines = [line for p in parts for line in p]
    assert lines == sorted(lines, key=lambda x: (x.split("\t")[4], int(x.split("\t")[5]), int(x.split("\t")[7]), x.split("\t")[0]))
    order = ["chrom", "start", "mismatches", "guide_id", "strand"]
    assert agreement.score_agreement(df, back, order, order, epsilon=1e-6).first().equal
    for text in ("a\tb\n", "\t".join("gXaacx+00") + "\t0.5\n"):
        (tmp_path / "bad.tsv").write_text(text)
        with pytest.raises(Exception, match="not ten fields|not a start"):
            scores.read_scores(spark, f"{tmp_path}/bad.tsv").collect()
