"""Seed search against a brute-force comparison of all pairs."""

import random

import pytest

from helixflow.operators import seeds

RC = str.maketrans("ACGTN", "TGCAN")


def brute_sites(name, seq, pams, length):
    out = []
    width = len(pams[0]) if pams else 0
    codes = {"N": "ACGT", "R": "AG", **{b: b for b in "ACGT"}}
    for i in range(len(seq) - length + 1):
        spacer = seq[i : i + length]
        if set(spacer) - set("ACGT"):
            continue
        for strand, text, pam in (("+", spacer, seq[i + length : i + length + width]), ("-", spacer.translate(RC)[::-1], seq[i - width : i].translate(RC)[::-1] if i >= width else "")):
            if not pams or len(pam) == width and any(all(b in codes[c] for b, c in zip(pam, p)) for p in pams):
                out.append((name, i, strand, text, pam if pams else None))
    return out


def sequences(seed, n=6, size=300):
    draw = random.Random(seed)
    return [(f"s{i}", "".join(draw.choice("ACGT" if draw.random() < 0.98 else "N") for _ in range(size))) for i in range(n)] + [("empty", ""), ("short", "ACGT"), ("null", None)]


@pytest.mark.parametrize("pams,length", [(("NGG",), 20), (("NGG", "NAG"), 20), (("RGA", "TGN"), 9), (None, 12)])
def test_protospacers(spark, pams, length):
    rows = sequences(1)
    got = seeds.protospacers(spark.createDataFrame(rows, "name string, seq string"), ["name"], pams, length).collect()
    assert sorted(map(tuple, got), key=str) == sorted((s for n, q in rows if q for s in brute_sites(n, q, pams, length)), key=str)


@pytest.mark.parametrize("seed,mismatches", [(12, 0), (8, 1), (8, 2), (7, 3), (6, 4)])
def test_seed_search_against_all_pairs(spark, seed, mismatches):
    rows = sequences(2)
    sites = [s for n, q in rows if q for s in brute_sites(n, q, ("NGG",), 20)]
    draw = random.Random(3)
    guides = [(f"g{i}", s[3]) for i, s in enumerate(draw.sample(sites, 12))] + [("twin", sites[0][3]), ("odd", "N" * 20), ("null", None)]
    found = seeds.seed_search(seeds.protospacers(spark.createDataFrame(rows, "name string, seq string"), ["name"]), spark.createDataFrame(guides, "guide_id string, spacer string"), seed, mismatches)
    count = {}
    for s in sites:
        count[s[3][-seed:]] = count.get(s[3][-seed:], 0) + 1
    want = []
    for g, spacer in guides:
        for s in sites if spacer and "N" not in spacer else ():
            at = [i for i, (x, y) in enumerate(zip(spacer[-seed:], s[3][-seed:])) if x != y]
            if len(at) <= mismatches:
                want.append((g, s[0], s[1], s[2], s[4], spacer[-seed:], s[3][-seed:], len(at), at, count[s[3][-seed:]]))
    assert sorted(map(tuple, found.collect())) == sorted(want) and (mismatches == 0 or any(r[7] for r in want))


def test_rollup_and_design(spark):
    rows = spark.createDataFrame(sequences(2), "name string, seq string")
    every, hits = seeds.design_guides(rows.where("name = 's1'"), rows, ["name"], "name", 8, 1)
    every, hits = every.collect(), hits.collect()
    passing = {r.guide_id for r in every if not r.reasons}
    assert passing and {r.guide_id for r in hits} <= passing < {r.guide_id for r in every}
    guides = spark.createDataFrame([(g,) for g in sorted(passing)] + [("none",)], "guide_id string")
    got = {r.guide_id: r for r in seeds.seed_rollup(guides, spark.createDataFrame(hits), "name").collect()}
    for g in passing:
        own = [h for h in hits if h.guide_id == g]
        assert (got[g].seed_hit_count, got[g].exact_seed_hit_count) == (len(own), sum(h.seed_mismatches == 0 for h in own)) and got[g].references == sorted({h.name for h in own})
        assert got[g].mismatched_seed_hit_count == len(own) - got[g].exact_seed_hit_count
    assert (got["none"].seed_hit_count, got["none"].references) == (0, [])


def test_bad_arguments(spark):
    df = spark.createDataFrame([("a", "ACGT")], "name string, seq string")
    for pams in (("NGG", "NG"), ("",), ("XGG",)):
        with pytest.raises(ValueError):
            seeds.protospacers(df, ["name"], pams)
    with pytest.raises(ValueError):
        seeds.seed_search(df, df, 12, 5)
