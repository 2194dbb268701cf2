"""Prime-editing ranking against plain Python."""

import hashlib
import math
import random

from helixflow.operators import ranking
from helixflow.operators.prime import SCAFFOLD


def test_split_specificity(spark):
    draw = random.Random(3)
    hits = [(f"g{draw.randrange(4)}", draw.randrange(3), draw.choice([True, False, None]), draw.choice([0.5, 0.25, draw.random()])) for _ in range(600)] + [("only", 0, False, 1.0)]
    got = {r.guide_id: r for r in ranking.split_specificity(spark.createDataFrame(hits, "guide_id string, mismatches int, inside boolean, score double"), "inside", most=40).collect()}
    for g in {h[0] for h in hits}:
        for inside, names in ((False, ("specificity", "off_targets")), (True, ("paralog_specificity", "paralog_hits"))):
            scores = sorted((h[3] for h in hits if h[0] == g and h[1] > 0 and bool(h[2]) == inside), reverse=True)
            assert math.isclose(got[g][names[0]], 100 / (1 + sum(scores[:40]))) and got[g][names[1]] == len(scores)
    assert (got["only"].specificity, got["only"].off_targets) == (100.0, 0)


def test_ranking(spark):
    draw = random.Random(5)
    rna = lambda n: "".join(draw.choice("ACGU") for _ in range(n))
    spacers = [f"{i}".rjust(20, "A").replace("0", "C").replace("1", "G") for i in (10, 11, 100)]
    rows = []
    for i in range(120):
        p, r = draw.randrange(8, 16), draw.randrange(10, 30)
        rows.append((draw.randrange(3), draw.choice("+-"), draw.choice(spacers), draw.randrange(5), rna(p), p, rna(r), r, draw.choice([None, spacers[0]]), draw.choice([math.nan, 50.0, 60.0, None]), draw.choice([math.nan, None, -10.0, -25.0, -40.0]), "x"))
    off = [(spacers[0], 40.0, 7, 90.0, 1), (spacers[1], 80.0, 2, 100.0, 0)]
    c = spark.createDataFrame(rows, "item int, strand string, spacer string, nick long, pbs string, pbs_length int, rtt string, rtt_length int, nicking_spacer string, efficiency double, mfe double, note string")
    o = spark.createDataFrame(off, "guide_id string, specificity double, off_targets long, paralog_specificity double, paralog_hits long")
    got = ranking.ranked_pegrnas(c, o, "item", top=15).collect()
    table = {s: x for s, *x in off}
    want = {}
    for item, strand, spacer, nick, pbs, p, rtt, r, nicking, eff, mfe, _ in rows:
        guide = table.get(spacer, [100.0])[0]
        nick_term = table.get(nicking, [100.0])[0] if nicking else 0.0
        fold = 0.0 if mfe is None or math.isnan(mfe) else max(0.0, -(mfe + 25))
        score = math.nan if eff is None or math.isnan(eff) else round(eff - 0.3 * guide - 0.15 * nick_term - 0.1 * fold, 9)
        strategy = "PE3" if nicking else "PE2"
        full = spacer.replace("T", "U") + SCAFFOLD.replace("T", "U") + rtt + pbs
        name = f"{item}_{nick}_{'p' if strand == '+' else 'm'}_pbs{p}_rtt{r}_sgRNA_{strategy}_{hashlib.sha1(full.encode()).hexdigest()[:8]}"
        want.setdefault(item, []).append((math.isnan(score), 0.0 if math.isnan(score) else -score, strand, nick, p, r, strategy, name))
    assert {(r.item, r["rank"]): r.pegrna_id for r in got} == {(i, k + 1): x[-1] for i, v in want.items() for k, x in enumerate(sorted(v)[:15])}
    assert {r.spacer for r in ranking.spacers_of(c).collect()} == set(spacers)
