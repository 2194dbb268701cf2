"""Gene tables in file order, symbols and coordinates, variants on transcripts."""

import random

import pytest
from pyspark.sql import functions as F

from helixflow.operators import transcripts
from helixflow.sources import genes


def test_short_tables(spark, tmp_path):
    text = "# note\nSymbol\tchrom\tstart\tend\tstrand\trefseq\nbrca1\tchr17\t100\t200\t-\tNM_1\nBRCA1\tchr1\t1\t900\t+\tNM_2\nshort\tchr1\t5\n\nbad\tchr1\tx\t9\t+\tNM_3\n tp53 \tchr17\t 7 \t9\t\tNM_4\r\n"
    (tmp_path / "g.tsv").write_text(text, newline="")
    got = sorted(map(tuple, genes.read_gene_list(spark, str(tmp_path)).collect()))
    assert got == [("BRCA1", "chr17", 100, 200, "-", "NM_1"), ("TP53", "chr17", 7, 9, "+", "NM_4")]
    assert sorted(map(tuple, genes.read_genes(spark, str(tmp_path)).collect())) == got


def browser(name, chrom, strand, a, b, symbol, exons=()):
    starts, ends = (",".join(str(e[k]) for e in exons) + "," for k in (0, 1))
    return "\t".join(map(str, [0, name, chrom, strand, a, b, a, b, len(exons), starts, ends, 0, symbol, "cmpl", "cmpl", ""]))


def test_browser_tables_over_many_splits(spark, tmp_path):
    """The longest span, the first of equals in the order of the lines, however they are read."""
    draw = random.Random(2)
    lines = [browser(f"NM_{i}", draw.choice(["chr1", "chr2", "chrUn_1", "chr1_alt", "chr3"]), draw.choice("+-"), 10 * i, 10 * i + draw.choice([5, 50, 500]), f"gene{draw.randrange(40)}") for i in range(3000)]
    lines += ["#bin", "short\trow", browser("NM_x", "chr1", "+", "a", 5, "bad"), browser("NM_y", "chr1", "+", 1, 5, "")]
    want = {}
    for line in lines:
        f = line.split("\t")
        if len(f) < 13 or not f[4].isdigit() or not f[12] or "_" in f[2]:
            continue
        if f[12].upper() not in want or want[f[12].upper()][1] < int(f[5]) - int(f[4]):
            want[f[12].upper()] = ((f[2], int(f[4]) + 1, int(f[5]), f[3], f[1]), int(f[5]) - int(f[4]))
    (tmp_path / "genes.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.symbol: (r.chrom, r.start, r.end, r.strand, r.refseq_id) for r in genes.read_genes(spark, str(tmp_path)).collect()}
            assert got == {s: g for s, (g, _) in want.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_targets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# genes\nbrca1, tp53\n\n Myc\nbrca1\n")
    assert sorted(r.target for r in genes.read_targets(spark, str(tmp_path / "t.txt")).collect()) == ["BRCA1", "BRCA1", "MYC", "TP53"]
    table = spark.createDataFrame([("BRCA1", "chr17", 101, 200, "-", "NM_1"), ("TP53", "chr17", 5, 9, "+", "NM_2")], "symbol string, chrom string, start long, end long, strand string, refseq_id string")
    ask = lambda rows, **k: sorted((r.id, r.chrom, r.start, r.end, r.strand, r.label) for r in genes.resolved(spark.createDataFrame(rows, "id int, target string"), table, **k).collect())
    assert ask([(1, " brca1"), (2, "tp53"), (3, "chr2:1,001-2,000")], flank=10) == [(1, "chr17", 90, 210, "-", "BRCA1"), (2, "chr17", 0, 19, "+", "TP53"), (3, "chr2", 990, 2010, "+", "chr2:1,001-2,000")]
    assert ask([(1, "nope")], strict=False) == [(1, None, None, None, None, "NOPE")]
    for bad in ("nope", "chr1:5-4", "chr1:x-9", "", None):
        with pytest.raises(Exception, match="unknown gene|not a target"):
            ask([(1, bad)])
    hits = spark.createDataFrame([("BRCA1", 5), ("BRCA1", 9)], "label string, pos long")
    found = genes.absolute(hits, genes.resolved(spark.createDataFrame([(1, "brca1")], "id int, target string"), table), "label", ("pos",)).collect()
    assert sorted((r.chrom, r.pos) for r in found) == [("chr17", 105), ("chr17", 109)]


def fields(spark, notations):
    df = spark.createDataFrame([(n,) for n in notations], "n string")
    return [tuple(r.v) if r.v else None for r in df.select(transcripts.variant_fields(F.col("n")).alias("v")).collect()]


def test_notations(spark):
    got = fields(spark, ["chr7:g.100C>T", "g.5a>u", "NM_007294.4:c.5266dupC", "m.8_9del", "chr1:g.3_4delACinsTTT", "NM_1:c.7delinsG", "chr2:g.9_11dup", None])
    assert got == [
        ("substitution", "chr7", "g", 100, 100, "C", "T"), ("substitution", "chr1", "g", 5, 5, "A", "T"), ("duplication", "NM_007294", "c", 5266, 5266, "C", ""), ("deletion", "chrM", "m", 8, 9, None, ""),
        ("replacement", "chr1", "g", 3, 4, "AC", "TTT"), ("replacement", "NM_1", "c", 7, 7, None, "G"), ("duplication", "chr2", "g", 9, 11, None, ""), None,
    ]
    for bad in ("chr1:g.5_9inv", "chr1:g.[5A>C;7del]", "NM_1:c.(5_9)del", "NC_1.1:g.5A>C", "c.5A>C", "chr1:g.0A>C", "chr1:g.9_5del", "chr1:g.5_7delACdup", "chr1:g.5_7delAC", "chr1:g.1_51del", "hello"):
        with pytest.raises(Exception, match="not a variant|out of range"):
            fields(spark, [bad])


def test_every_transcript_position(spark):
    """Spliced positions, both strands, against the transcript written out."""
    draw = random.Random(3)
    rows, variants, want = [], [], {}
    for t in range(8):
        cuts = sorted(draw.sample(range(1, 200), 8))
        exons = [(cuts[k], cuts[k + 1]) for k in range(0, 8, 2)]
        draw.shuffle(exons)
        strand = "+-"[t % 2]
        place = [p for a, b in sorted(exons) for p in range(a, b)]
        place = place[::-1] if strand == "-" else place
        rows.append((f"NM_{t}.{t + 1}", f"chr{t}", cuts[0] + 1, cuts[-1], strand, [a for a, _ in exons], [b for _, b in exons]))
        for p in range(len(place)):
            last = min(p + draw.randrange(3), len(place) - 1)
            if abs(place[last] - place[p]) == last - p:
                variants.append((len(variants), f"NM_{t}.9:c.{p + 1}_{last + 1}delinsAAG"))
                low = min(place[p], place[last])
                want[len(variants) - 1] = (f"chr{t}", low, low + last - p + 1, "CTT" if strand == "-" else "AAG")
    rows.append(("NM_50", "chr9", 1001, 2000, "-", None, None))
    variants += [(9001, "NM_50.1:c.5266dupC"), (9002, "NM_50:c.1A>G"), (9003, "chr4:g.7_8del"), (9004, "m.3A>C")]
    want |= {9001: ("chr9", 2000 - 5266, 2000 - 5265, ""), 9002: ("chr9", 1999, 2000, "C"), 9003: ("chr4", 6, 8, ""), 9004: ("chrM", 2, 3, "C")}
    table = spark.createDataFrame(rows, "refseq_id string, chrom string, start long, end long, strand string, exon_starts array<long>, exon_ends array<long>")
    df = lambda v: spark.createDataFrame(v, "id int, n string").withColumn("v", transcripts.variant_fields(F.col("n")))
    got = {r.id: (r.chrom, r.start, r.end, r.alt) for r in transcripts.on_genome(df(variants), table).collect()}
    assert got == want
    for bad in ("NM_77:c.5A>C", "NM_0:c.5000A>C"):
        with pytest.raises(Exception, match="no exon holds"):
            transcripts.on_genome(df([(1, bad)]), table).collect()
    across = next(f"NM_0:c.{p + 1}_{p + 2}del" for p in range(500) for e in [sorted(zip(rows[0][5], rows[0][6]))] if p + 1 == e[0][1] - e[0][0])
    with pytest.raises(Exception, match="no exon holds"):
        transcripts.on_genome(df([(1, across)]), table).collect()


def test_transcripts_are_read(spark, tmp_path):
    (tmp_path / "t.txt").write_text(browser("NM_1", "chr1", "-", 10, 90, "abc", [(10, 20), (50, 90)]) + "\n" + browser("NM_1", "chr2", "+", 0, 500, "abc") + "\n")
    row = genes.read_transcripts(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in row] == [("NM_1", "ABC", "chr1", 11, 90, "-", [10, 50], [20, 90])]
