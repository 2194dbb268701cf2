"""Operators against plain-Python definitions on seeded strings, and block-split invariance."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixflow.functions import dna
from helixflow.operators import kmers, library, matching, motifs, regions, scoring, trimming, windows

RC = str.maketrans("ACGTN", "TGCAN")


def rc(s):
    return s.translate(RC)[::-1]


def strings():
    r = random.Random(11)
    out = ["", "A", "ACG", "A" * 60, "ACGT" * 20 + "CAG" * 12 + "A" * 30 + "N" + "AT" * 20, "N" * 40]
    out += ["".join(r.choice("ACGT") for _ in range(n)) for n in (14, 15, 16, 900, 3000)]
    out += ["".join(r.choice("ACGTACGTACGTACGTACGTN") for _ in range(n)) for n in (500, 2500)]
    out.append("".join(r.choice("CCGGGCAT") for _ in range(1500)))
    return list(enumerate(out))


@pytest.fixture(autouse=True)
def short_blocks(monkeypatch):
    """Blocks so short that the strings span several."""
    monkeypatch.setattr(windows, "BLOCK", 700)


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(strings(), "id long, seq string").cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_windows_do_not_depend_on_blocks(seqs, monkeypatch):
    whole = rows(windows.kmers(seqs, 7, ["id"], valid=False))
    assert whole == sorted((i, p, s[p : p + 7]) for i, s in strings() for p in range(len(s) - 6))
    assert rows(windows.blocks(seqs, 3, ["id"]).select("id", "start"))[0] == (1, 0)


def test_kmer_counts(seqs):
    c = Counter()
    for _, s in strings():
        c.update(min(k, rc(k)) for k in (s[p : p + 15] for p in range(len(s) - 14)) if set(k) <= set("ACGT"))
    assert dict(rows(kmers.count_kmers(seqs, 15, ["id"]))) == dict(c)
    top = [tuple(r) for r in kmers.top_kmers(kmers.count_kmers(seqs, 15, ["id"]), 2, 5).collect()]
    assert top == sorted(((k, n) for k, n in c.items() if n > 1), key=lambda x: (-x[1], x[0]))[:5]


def brute_minimizers(s, k, w):
    out, run = set(), []
    for p in range(len(s) - k + 1):
        x = s[p : p + k]
        if set(x) <= set("ACGT"):
            run.append((min(x, rc(x)), p))
            if len(run) >= w:
                m, q = min(run[-w:])
                out.add((q, m))
        else:
            run = []
    return out


def test_minimizers(seqs):
    for k, w in ((15, 10), (5, 4)):
        assert rows(kmers.minimizers(seqs, k, w, ["id"])) == sorted((i, *m) for i, s in strings() for m in brute_minimizers(s, k, w))


def brute_cpg(s, w):
    on = []
    for p in range(len(s) - w + 1):
        x = s[p : p + w]
        c, g, cg = x.count("C"), x.count("G"), sum(x[i : i + 2] == "CG" for i in range(w - 1))
        if c and g and 2 * (c + g) >= w and 5 * w * cg >= 3 * c * g:
            on.append(p)
    return on


def test_cpg(seqs):
    for w in (20, 200):
        assert rows(regions.cpg_candidates(seqs, ["id"], w)) == sorted((i, p) for i, s in strings() for p in brute_cpg(s, w))
    found = rows(regions.cpg_islands(seqs, ["id"], 20))
    expected = []
    for i, s in strings():
        run = []
        for p in [*brute_cpg(s, 20), 10**9]:
            if run and p != run[-1] + 1:
                if len(run) >= 20:
                    expected.append((i, run[0], run[-1] + 20))
                run = []
            run.append(p)
    assert found == sorted(expected)


def brute_tandem(s, copies):
    found = []
    for q in range(1, 7):
        p = q
        while p < len(s):
            n = 0
            while p + n < len(s) and s[p + n] == s[p + n - q]:
                n += 1
            if n >= q * (copies - 1):
                start = p - q
                found.append((start, start + (n + q) // q * q, q, s[start : start + q]))
            p += n + 1
    found.sort(key=lambda x: (x[0], x[0] - x[1], x[2]))
    kept, last = [], -1
    for x in found:
        if x[0] >= last:
            kept.append(x)
            last = x[1]
    return found, kept


def test_tandem(seqs):
    candidates = regions.tandem_candidates(seqs, ["id"], copies=3)
    assert rows(candidates) == sorted((i, *x) for i, s in strings() for x in brute_tandem(s, 3)[0])
    assert rows(regions.tandem_repeats(candidates, ["id"])) == sorted((i, *x) for i, s in strings() for x in brute_tandem(s, 3)[1])


def test_motifs(seqs):
    assert rows(motifs.primer_hits(seqs, "ACGT", ["id"])) == sorted((i, p, 0) for i, s in strings() for p in range(len(s) - 3) if s[p : p + 4] == "ACGT")
    assert rows(motifs.pam_hits(seqs, "NRN", ["id"])) == sorted((i, p, 0) for i, s in strings() for p in range(len(s) - 2) if s[p] in "ACGT" and s[p + 1] in "AG" and s[p + 2] in "ACGT")
    got = motifs.methylation_contexts(seqs, ["id"]).collect()
    assert all(r.motif[0] == "C" for r in got)
    plus = Counter(r.context for r in got if r.strand == "+")
    back = motifs.methylation_contexts(seqs.withColumn("seq", dna.reverse_complement(F.col("seq"))), ["id"]).collect()
    assert plus == Counter(r.context for r in back if r.strand == "-")
    with pytest.raises(ValueError):
        dna.iupac_regex("NGZ")
    with pytest.raises(ValueError):
        motifs.primer_hits(seqs, "ACGN", ["id"])


def test_pigeonhole_meets_every_pair(spark, seqs):
    r = random.Random(2)
    long = strings()[10][1]
    guides = set()
    for _ in range(30):
        p = r.randrange(len(long) - 20)
        g = list(long[p : p + 20])
        for _ in range(r.randrange(5)):
            g[r.randrange(20)] = r.choice("ACGT")
        guides.add("".join(g))
    g = spark.createDataFrame([(x, x) for x in guides], "guide_id string, spacer string")
    sites = matching.pam_sites(seqs, ["id"])
    all_sites = [tuple(x) for x in sites.select("id", "start", "strand", "site").collect()]
    brute = [(i, p, st, x) for i, s in strings() for p in range(len(s) - 22) for st, x in (("+", s[p : p + 23]), ("-", rc(s[p : p + 23]))) if x.endswith("GG") and set(x) <= set("ACGT")]
    assert sorted(all_sites) == sorted(brute)
    for m in (0, 3, 4):
        expected = sorted((x, i, p, st, d) for x in guides for i, p, st, site in brute if (d := sum(a != b for a, b in zip(x, site))) <= m)
        assert rows(matching.off_targets(sites, g, m).select("guide_id", "id", "start", "strand", "mismatches")) == expected


def test_band_and_spans(spark):
    r = random.Random(4)
    a = [(r.randrange(2), r.randrange(1000)) for _ in range(80)]
    b = [(r.randrange(2), r.randrange(1000)) for _ in range(80)]
    left, right = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k int, y int")
    assert rows(matching.band_join(left, right, ["k"], "x", "y", 40, 100)) == sorted((k, x, y) for k, x in a for q, y in b if k == q and 40 <= abs(x - y) <= 100)
    spans = spark.createDataFrame([(k, x, x + 50) for k, x in a[:20]] + [(0, 5, 5)], "k int, start int, end int")
    got = rows(matching.flag_in_spans(right, spans, ["k"], "y", "inside", 64))
    assert got == sorted((k, y, any(q == k and s <= y < s + 50 for q, s in a[:20])) for k, y in b)


def test_chains(spark):
    hits = [("q", "r", i * 10, 1000 + i * 10) for i in range(8)] + [("q", "r", 5, 90_000), ("q", "r", 300, 1200)]
    out = matching.chain_seeds(spark.createDataFrame(hits, "a string, b string, query_pos long, ref_pos long"), ["a", "b"]).collect()
    assert [(x.score, x.query_start, x.query_end, x.ref_start, x.ref_end, x.diagonal) for x in out] == [(8, 0, 70, 1000, 1070, 1000)]


def test_scores(spark):
    df = spark.createDataFrame([("A" * 20, "A" * 20 + "TGG"), ("A" * 20, "A" * 19 + "C" + "TGG"), ("A" * 20, "C" + "A" * 14 + "C" + "AAAA" + "TGG")], "spacer string, site string")
    got = [r[0] for r in df.select(scoring.mismatch_score(F.col("spacer"), F.col("site"))).collect()]
    assert got == [1.0, 0.0, 0.583 * 0.0]
    assert len(scoring.activity_weights()) == 70
    one = spark.createDataFrame([("ACGT" * 8,)], "c string").select(scoring.activity_score(F.col("c").substr(1, 30))).first()[0]
    assert 0 < one < 1
    hits = spark.createDataFrame([("g", 0, 1.0), ("g", 1, 0.5), ("g", 2, 0.5), ("h", 0, 1.0)], "guide_id string, mismatches int, score double")
    assert rows(scoring.specificity(hits)) == [("g", 50.0, 2), ("h", 100.0, 0)]


def test_library(spark):
    pools = spark.createDataFrame([("a", 1, "S1", 5), ("a", 2, "S2", 3), ("b", 1, "S1", 9), ("b", 2, "S3", 1), ("c", 1, "s1", 9)], "gene string, place int, spacer string, score int")
    assert rows(library.global_dedup(pools, 2)) == [("a", 1, "S2", 3), ("b", 1, "S1", 9), ("b", 2, "S3", 1)]
    assert rows(library.global_dedup(pools, 2, "alphabetical")) == [("a", 1, "S1", 5), ("a", 2, "S2", 3), ("b", 1, "S3", 1)]
    assert rows(library.dedup_collisions(pools)) == [("S1", 3)]
    assert rows(library.balance(library.global_dedup(pools, 2), pools, 2)) == [("a", 1, 1, True), ("b", 2, 0, False), ("c", 0, 2, True)]


def test_trim(spark):
    df = spark.createDataFrame([("ACGTTTACTGG", "IIIIIIIIIII"), ("ttact", "IIIII"), ("AC", "II"), ("", "")], "seq string, qual string")
    out = trimming.trim_reads(df, "TTACT")
    assert [tuple(r) for r in out.collect()] == [("ACGT", "IIII", 7), ("", "", 5), ("AC", "II", 0), ("", "", 0)]
    assert tuple(trimming.trim_stats(out).first()) == (4, 2, 2, 18, 6)
    with pytest.raises(ValueError):
        trimming.trim_reads(df, "")


def test_codecs(spark):
    from helixflow.functions import codecs

    for s in ("", "A", "ACGT", "ACGTA", "T" * 33):
        assert codecs.unpack_one(codecs.pack_one(s), len(s)) == s
    assert codecs.pack_one("ACGT") == bytes([0b00011011])
    with pytest.raises(ValueError):
        codecs.pack_one("ACN")
    with pytest.raises(ValueError):
        codecs.unpack_one(b"\x00", 9)
    df = spark.createDataFrame([("ACGTA",), (None,)], "s string")
    assert [r[0] for r in df.select(codecs.unpack_dna(codecs.pack_dna("s"), F.length("s"))).collect()] == ["ACGTA", None]
    assert [r[0] for r in df.select(dna.unpack(dna.pack(F.col("s")), 5)).collect()] == ["ACGTA", None]


def test_smoke_score(spark):
    import hashlib

    got = spark.createDataFrame([("a", 5)], "x string, y int").select(scoring.smoke_score([F.col("x"), F.col("y")], 7)).first()[0]
    assert got == int.from_bytes(hashlib.sha256((7).to_bytes(8, "little") + b"a|5").digest()[:8], "little") / float(1 << 64)


def test_edit_notations_and_errors(spark):
    from helixflow.functions.edits import edit_fields, target_fields
    from helixflow.operators.prime import applied_edits

    given = ["c>u at s1:2", "CG>TT at s1:2..3", "insTT at s1:1", "del s1:2..4", "s1:g.2C>A", "s1:g.2_3delinsA", "s1:g.2dup", None]
    rows = spark.createDataFrame([(x,) for x in given], "n string").select("n", edit_fields(F.col("n")).alias("e"))
    seqs = spark.createDataFrame([("s1", "ACGTA")], "name string, seq string")
    got = {r["n"]: r["edited"] for r in applied_edits(rows.select("n", "e.*"), seqs, "name").collect()}
    assert got == {given[0]: "ATGTA", given[1]: "ATTTA", given[2]: "TTACGTA", given[3]: "AA", given[4]: "AAGTA", given[5]: "AATA", given[6]: "ACCGTA"}
    for wrong in ("", "C>T", "CG>TT at s1:2..4", "del s1:4..2", "s1:g.2_3inv", "insA at s1:0", "ins" + "A" * 51 + " at s1:1"):
        with pytest.raises(Exception, match="edit"):
            spark.createDataFrame([(wrong,)], "n string").select(edit_fields(F.col("n")).alias("e")).collect()
    with pytest.raises(Exception, match="ref"):
        applied_edits(spark.createDataFrame([("G>T at s1:2",)], "n string").select(edit_fields(F.col("n")).alias("e")).select("e.*"), seqs, "name").collect()
    targets = spark.createDataFrame([("chr1:1,001-2,000",), ("x:5-5",), (None,)], "t string").select(target_fields(F.col("t"), 10).alias("f")).collect()
    assert [tuple(r["f"]) if r["f"] else None for r in targets] == [("chr1", 990, 2010), ("x", 0, 15), None]
    for wrong in ("chr1", "chr1:0-5", "chr1:6-5"):
        with pytest.raises(Exception, match="target"):
            spark.createDataFrame([(wrong,)], "t string").select(target_fields(F.col("t")).alias("f")).collect()


def test_controls_nicks_and_pair_scores(spark):
    from helixflow.operators import library, prime, scoring

    pool = library.control_candidates(spark, 300, 7)
    fit = {r["spacer"] for r in library.non_targeting(pool, spark.createDataFrame([], "id long, seq string")).collect()}
    ok = lambda s: 8 <= sum(c in "GC" for c in s) <= 12 and "TTTT" not in s and not any(c * 5 in s for c in "ACGT")
    assert fit == {r["spacer"] for r in pool.collect() if ok(r["spacer"])}
    some = sorted(fit)[0]
    held = "ACG" + some.translate(str.maketrans("ACGT", "TGCA"))[::-1] + "NN"
    assert fit - {r["spacer"] for r in library.non_targeting(pool, spark.createDataFrame([(1, held)], "id long, seq string")).collect()} == {some}
    nicks = spark.createDataFrame([(1, "+", 100, 150, 160)], "id long, strand string, nick long, edit_start long, edit_end long")
    site = "ACGT" * 5 + "TGG"
    sites = spark.createDataFrame([(1, 100 + d - 6, "-", site) for d in (39, 40, 50, 59, 60, 100, 101, -40)] + [(1, 133, "+", site)], "id long, start long, strand string, site string")
    got = [(r["nicking_site"], r["distance"], r["rank"]) for r in prime.nicking_guides(nicks, sites, ["id"]).orderBy("rank").collect()]
    assert got == [(60, 40, 1), (140, 40, 2), (160, 60, 3), (200, 100, 4)]
    pair = spark.createDataFrame([("G" + "A" * 18 + "T", "A" * 19 + "C" + "TAG")], "a string, b string")
    score = lambda m: pair.select(scoring.pair_score(F.col("a"), F.col("b"), m).alias("s"), scoring.pam_weight(F.col("b")).alias("p")).first()
    assert tuple(score({"GT1": 0.5, "UG20": 0.25})) == (0.125, 0.259259259)
    with pytest.raises(Exception, match="no weight for UG20"):
        score({"GT1": 0.5})
