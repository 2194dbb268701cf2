"""Guide design against plain Python, contexts of edits, reports."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from helixflow.operators import design
from helixflow.sources import reports

HIT = "label string, guide_id string, spacer string, chrom string, start long, strand string, mismatches int, score double"


def hits(draw):
    out = []
    for _ in range(300):
        g = draw.randrange(6)
        out.append((draw.choice(["a", "b"]), f"g{g}", "ACGT"[g % 4] * 12 + "CGTAACGT", draw.choice(["c1", "c2"]), draw.randrange(40), draw.choice("+-"), draw.choice([0, 0, 1, 3]), draw.random()))
    return sorted(set(out))


def test_ranking(spark):
    draw = random.Random(2)
    rows = hits(draw)
    targets = {"a": ("c1", 5, 25), "b": ("c2", 0, 10), "c": ("c1", 0, 9)}
    activity = {f"g{i}": draw.random() for i in range(4)}
    on, off = design.locus_hits(spark.createDataFrame(rows, HIT), spark.createDataFrame([(k, *v) for k, v in targets.items()], "label string, chrom string, start long, end long"))
    inside = lambda r: r[6] == 0 and r[3] == targets[r[0]][0] and targets[r[0]][1] <= r[4] < targets[r[0]][2]
    assert sorted(map(tuple, on.collect())) == [r for r in rows if inside(r)] and sorted(map(tuple, off.collect())) == [r for r in rows if not inside(r)]
    table = spark.createDataFrame(list(activity.items()), "guide_id string, score double")
    for searched in (True, False):
        got = design.ranked_guides(on, off if searched else None, table, top=3).collect()
        want = {}
        for label, g in {(r[0], r[1]) for r in rows if inside(r)}:
            first = min((r[3], r[4], r[5], r[2]) for r in rows if inside(r) and r[:2] == (label, g))
            elsewhere = [r for r in rows if not inside(r) and r[:2] == (label, g)]
            spec = 100 / (1 + sum(r[7] for r in elsewhere if r[6] > 0))
            score = round(0.5 * activity.get(g, 0.0) + 0.5 * spec / 100, 9) if searched else round(activity.get(g, 0.0), 9)
            want.setdefault(label, []).append((-score, g, first[:3], len(elsewhere) if searched else -1))
        assert {(r.label, r["rank"]): (pytest.approx(-r.composite), r.guide_id, (r.chrom, r.start, r.strand), r.off_target_count) for r in got} == {(k, i + 1): x for k, v in want.items() for i, x in enumerate(sorted(v)[:3])}
        assert all(r.notes.endswith("NO_OFF_TARGET_SCAN") and math.isnan(r.specificity) for r in got) or searched


def test_contexts(spark):
    one = lambda *r: spark.createDataFrame([r], "s string, at long, r string, a string").select(design.edit_context(F.col("s"), F.col("at"), F.col("r"), F.col("a"), 4)).first()[0]
    assert one("aacgtacgtt", 4, "T", "G") == "AACG(T/G)ACGT" and one("AACGT", 1, "AC", "") == "A(AC/-)GT" and one("AACGT", 5, "", "gg") == "ACGT(-/GG)" and one("AACGT", 0, "A", "T") == "(A/T)ACGT"
    with pytest.raises(Exception, match="does not hold"):
        one("AACGT", 0, "C", "T")


def test_reports(spark):
    rows = [("g1", 1, 41.666666, 0.12345678, 3, None), ("g2", 2, 50.0, math.nan, -1, "x")]
    df = spark.createDataFrame(rows, "guide_id string, rank int, gc double, specificity double, off_target_count long, notes string")
    lines = reports.report_lines(df)
    assert lines.columns == ["guide_id\trank\tgc\tspecificity\toff_target_count\tnotes"]
    assert [r[0] for r in lines.collect()] == ["g1\t1\t41.67\t0.123457\t3\t", "g2\t2\t50.00\tNaN\tNaN\tx"]
    back = [json.loads(r.value) for r in reports.report_json(df).collect()]
    assert list(back[0]) == sorted(df.columns) and back[1]["specificity"] is None and back[1]["off_target_count"] is None and back[0]["off_target_count"] == 3
