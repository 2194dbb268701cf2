"""Guide search while sequences are scanned, against brute force, and the queries on it against their SQL on odd inputs."""

import random

import numpy as np
import pytest

from helixflow.jobs import catalog
from helixflow.operators import matching, regions, windows

from .test_operators import rc
from .test_queries import shaped

ODD = ((0, "ab"), (3, ""), (4, None), (None, "as it was"), (7, "twice"), (7, "and again"), (9, "Zz zz"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def mutated(r, text, changes, letters="ACGT"):
    out = list(text)
    for _ in range(changes):
        out[r.randrange(len(out))] = r.choice(letters)
    return "".join(out)


@pytest.fixture(scope="module")
def planted():
    r = random.Random(5)
    long = "".join(r.choice("ACGGT") for _ in range(2500))
    guides = {mutated(r, long[p : p + 20], r.randrange(7)) for p in (r.randrange(2400) for _ in range(40))} | {"G" * 20, "C" * 20}
    texts = [(0, long), (1, rc(long) + "N" + long[:800]), (2, "G" * 300), (3, ""), (4, None), (None, long[:900]), (5, long[:22])]
    return texts, sorted(guides)


@pytest.mark.parametrize("m", [0, 1, 2, 3, 4, 5, 6])
def test_guide_hits_meet_every_pair(spark, planted, monkeypatch, m):
    texts, guides = planted
    monkeypatch.setattr(windows, "BLOCK", 700)
    seqs = spark.createDataFrame(texts, "id long, seq string")
    g = spark.createDataFrame([(f"g{i}", x) for i, x in enumerate(guides)] + [("bad", "N" * 20), ("short", "ACGT"), ("none", None)], "guide_id string, spacer string")
    brute = [(i, p, st, x) for i, s in texts if s for p in range(len(s) - 22) for st, x in (("+", s[p : p + 23]), ("-", rc(s[p : p + 23]))) if x.endswith("GG") and set(x) <= set("ACGT")]
    sites = np.array([list(x[:20].encode()) for *_, x in brute])
    expected = sorted((str(i), p, st, brute_site, f"g{k}", x, int(d)) for k, x in enumerate(guides) for (i, p, st, brute_site), d in zip(brute, (sites != list(x.encode())).sum(axis=1), strict=True) if d <= m)
    as_text = lambda df: sorted((str(x[0]), *x[1:]) for x in df.select("id", "start", "strand", "site", "guide_id", "spacer", "mismatches").collect())
    assert as_text(matching.guide_hits(seqs, ["id"], g, m)) == expected
    if m in (0, 3, 4):  # too many guides for a task: the join
        monkeypatch.setattr(matching, "MOST_NEIGHBOURS", 1)
        assert as_text(matching.guide_hits(seqs, ["id"], g, m)) == expected


def test_pairs_are_compared_a_part_at_a_time(monkeypatch):
    r = np.random.default_rng(3)
    x, spacers = r.integers(0, 1 << 40, 50), r.integers(0, 1 << 40, 30)
    x[:20] = spacers[:20] ^ 3
    whole = sorted(zip(*map(np.concatenate, zip(*matching.Neighbours(spacers, 4).near(x), strict=True)), strict=True))
    monkeypatch.setattr(matching, "PAIRS", 1)
    parts = [p for p in matching.Neighbours(spacers, 4).near(x)]
    assert sorted(zip(*map(np.concatenate, zip(*parts, strict=True)), strict=True)) == whole and len(parts) >= 20 and len(whole) >= 20


def test_no_guides_find_nothing(spark):
    seqs = spark.createDataFrame([(1, "ACGT" * 20 + "GG")], "id long, seq string")
    assert matching.guide_hits(seqs, ["id"], spark.createDataFrame([], "guide_id long, spacer string"), 4).collect() == []


def test_first_piece_is_found_by_bits(spark):
    """A filter on mismatches must not put a test of lists in front of that of the mismatches."""
    g = spark.createDataFrame([("A" * 20, "A" * 20)], "guide_id string, spacer string")
    sites = matching.pam_sites(spark.createDataFrame([(1, "A" * 20 + "TGG")], "id long, seq string"), ["id"])
    found = matching.off_targets(sites, g, 4).where("mismatches > 0 or site is not null")
    assert "arrays_zip" not in plan(found) and [r.mismatches for r in found.collect()] == [0]


def tables(spark, folder, ids):
    """Documents that hold benchmark passages, changed a little or not at all, with ids of a generator that may repeat or be null."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(8)
    items = ["".join(r.choice("bcbcad ") for _ in range(300)) for _ in range(4)]
    texts = [*ODD, (None, " ".join(items))]
    for k in range(60):
        texts.append((ids(r, k), mutated(r, r.choice(items), r.choice([0, 0, 2, 5, 9]), "abcd") + " " + "".join(r.choice("abcd") for _ in range(300))))
    docs = spark.createDataFrame([(k, t, "en", "web") for k, t in texts], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    return folder, con


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("odd")), lambda r, k: r.choice([None, 1, 2, k]))


@pytest.fixture(scope="module")
def some_null(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("null")), lambda r, k: r.choice([None, None, 100 + k]))


def equals_sql(spark, odd, name):
    import pandas as pd

    folder, con = odd
    want = shaped(con.sql(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(shaped(catalog.QUERIES[name](spark, folder).toPandas()), want, check_exact=False, rtol=1e-9)
    return want


def test_on_off_split_counts_each_hit_once(spark, odd):
    want = equals_sql(spark, odd, "on_off_split")
    assert want.on_targets.max() > 1 and want.off_targets.max() > 1
    assert "Join" not in plan(catalog.on_off_split(spark, odd[0]))


def test_top_offtargets_without_ids_come_last(spark, some_null):
    want = equals_sql(spark, some_null, "top_offtargets")
    assert len(want) > 50 and want.top.str.contains(";").any()
    assert not {"Join", "arrays_zip"} & set(plan(catalog.top_offtargets(spark, some_null[0])).replace("(", " ").split())


def test_specificity_top_split_meets_no_pieces(spark, some_null):
    want = equals_sql(spark, some_null, "specificity_top_split")
    assert len(set(want.in_island)) == 2
    assert "arrays_zip" not in plan(catalog.specificity_top_split(spark, some_null[0]))


def test_islands_send_no_short_runs(spark, monkeypatch):
    """Runs too short for an island stay in their task, unless they touch an end of their block."""
    monkeypatch.setattr(windows, "BLOCK", 150)
    r = random.Random(9)
    texts = [(k, "".join(r.choice(r.choice(["CG", "CCGG", "ACGT"])) for _ in range(r.randrange(2000)))) for k in range(8)] + [(8, "CG" * 400), (9, "CG" * 30 + "A" * 90 + "GC" * 35)]
    sent = []
    joined = regions.joined_runs
    monkeypatch.setattr(regions, "joined_runs", lambda runs, keys: sent.append(runs.collect()) or joined(runs, keys))
    got = sorted(map(tuple, regions.cpg_islands(spark.createDataFrame(texts, "id long, seq string"), ["id"], 40).collect()))
    assert all(x.n >= 40 or x.first % 150 == 0 or (x.first + x.n) % 150 == 0 for x in sent[0])
    want = []
    for i, s in texts:
        rich = [2 * ((c := w.count("C")) + (g := w.count("G"))) >= 40 and c > 0 and g > 0 and 200 * w.count("CG") >= 3 * c * g for w in (s[p : p + 40] for p in range(len(s) - 39))] + [False]
        start = None
        for p, x in enumerate(rich):
            if x and start is None:
                start = p
            elif not x and start is not None:
                if p - start >= 40:
                    want.append((i, start, p - 1 + 40))
                start = None
    assert got == sorted(want) and len(want) > 5
