"""Result tables in both layouts, k-mer tables of other tools."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixflow.operators import kmers
from helixflow.sources import kmer_tables, results


def table(spark, n=40):
    draw = random.Random(1)
    number = lambda: draw.choice([math.nan, 0.0, 1e-7 * draw.random(), draw.random(), 123456.5, 1234567.0 * draw.random(), -2.5e9])
    make = {"str": lambda: draw.choice(["a", "b c", 'q"x']), "int": lambda: draw.randrange(-5, 10**9), "float": number, "opt_str": lambda: draw.choice([None, "ACGT"]), "opt_int": lambda: draw.choice([None, 7]), "list": lambda: draw.choice([[], ["one"], ["one", "two"]])}
    rows = []
    for i in range(n):
        r = {c: make[k]() for c, k in results.COLUMNS.items() if k != "opt_float"}
        r |= {"pegrna_id": f"p{i:03d}", "pe_strategy": "PE3" if i % 2 else "PE2", "cfd_aggregate_nicking": number() if i % 2 else None}
        rows.append(tuple(r[c] for c in results.COLUMNS))
    return spark.createDataFrame(rows, results.SCHEMA), rows


def rounded(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.6g}") if isinstance(v, float) else v for v in row)


def test_tables_round_trip(spark, tmp_path):
    df, rows = table(spark)
    results.write_results(df.repartition(4), f"{tmp_path}/new", ["pegrna_id"])
    back = results.read_results(spark, f"{tmp_path}/new")
    assert back.dtypes == df.dtypes and [rounded(r) for r in back.orderBy("pegrna_id").collect()] == [rounded(r) for r in rows]
    text = [x for f in sorted((tmp_path / "new").glob("part*")) for x in f.read_text().splitlines() if not x.startswith("pegrna_id")]
    assert [x.split("\t")[0] for x in text] == [r[0] for r in rows]
    want = ["" if v is None else ",".join(v) if isinstance(v, list) else ("NA" if math.isnan(v) else format(v, ".6g")) if isinstance(v, float) else str(v) for v in rows[3]]
    assert text[3].split("\t") == want
    results.write_results(df, f"{tmp_path}/old", ["pegrna_id"], older=True)
    old = results.read_results(spark, f"{tmp_path}/old").orderBy("pegrna_id").collect()
    assert [rounded(r)[:32] for r in old] == [rounded(r)[:32] for r in rows] and {tuple(r)[32:] for r in old} == {(0, 100.0)}
    both = results.read_results(spark, [f"{tmp_path}/old", f"{tmp_path}/new"])
    assert both.count() == 2 * len(rows)


def test_bad_tables(spark, tmp_path):
    df, _ = table(spark, 1)
    line = results.result_lines(df).first()[0]
    head = "\t".join(results.COLUMNS)
    cells = line.split("\t")
    for name, text in {"a": head.replace("rank", "order"), "b": "\t".join(cells[:33]), "c": "\t".join([*cells[:2], "x", *cells[3:]]), "d": "\t".join([*cells[:2], "NA", *cells[3:]]), "e": "\t".join([*cells[:19], "", *cells[20:]])}.items():
        (tmp_path / name).write_text(text + "\n")
        with pytest.raises(Exception, match="not a|neither"):
            results.read_results(spark, f"{tmp_path}/{name}").collect()


def test_json_round_trip(spark, tmp_path):
    df, rows = table(spark)
    results.result_json(df).write.text(f"{tmp_path}/j")
    back = results.read_result_json(spark, f"{tmp_path}/j").orderBy("pegrna_id").collect()
    same = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)
    assert len(back) == len(rows) and all(same(x, y) for a, b in zip(back, rows, strict=True) for x, y in zip(a, b, strict=True))
    (tmp_path / "bad.json").write_text('{"pegrna_id": null}\n')
    with pytest.raises(Exception, match="no pegrna_id"):
        results.read_result_json(spark, f"{tmp_path}/bad.json").collect()


def test_kmer_blobs(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.getrandbits(62), draw.randrange(1, 10**12)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "packed long, count long")
    kmer_tables.write_kmer_blobs(df, f"{tmp_path}/k")
    files = sorted((tmp_path / "k").glob("part*"))
    whole = np.concatenate([np.frombuffer(f.read_bytes()[8:], "<u8").reshape(-1, 2) for f in files])
    assert whole.tolist() == sorted(map(list, rows)) and not (tmp_path / "k/_temporary").exists()
    for block in (7, 100, 1 << 20):
        some = kmer_tables.read_kmer_blobs(spark, str(files[0]) if block == 7 else f"{tmp_path}/k", block if block > 7 else 4000)
        n = int(np.frombuffer(files[0].read_bytes()[:8], "<u8")[0])
        got = sorted(map(tuple, some.collect()))
        assert got == (sorted(map(tuple, whole[:n].tolist())) if block == 7 else sorted(rows))
    (tmp_path / "bad").write_bytes(np.array([2, 5, 6], "<u8").tobytes())
    (tmp_path / "empty").write_bytes(np.array([0], "<u8").tobytes())
    assert kmer_tables.read_kmer_blobs(spark, f"{tmp_path}/empty").count() == 0
    with pytest.raises(Exception, match="should have 40 bytes"):
        kmer_tables.read_kmer_blobs(spark, f"{tmp_path}/bad").collect()


def test_kmer_fasta(spark, tmp_path):
    seqs = spark.createDataFrame([(1, "ACGTACGTTTGACGT"), (2, "GGGACGTACC")], "id int, seq string")
    counts = kmers.packed_counts(seqs, 5, ["id"])
    kmer_tables.kmer_fasta(counts, 5).write.text(f"{tmp_path}/f")
    back = kmer_tables.read_kmer_fasta(spark, f"{tmp_path}/f")
    want = counts.select(kmer_tables.unpack(F.col("packed"), 5).alias("kmer"), "count")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    (tmp_path / "bad.fa").write_text(">x\nACG\n")
    with pytest.raises(Exception, match="not a count"):
        kmer_tables.read_kmer_fasta(spark, f"{tmp_path}/bad.fa").collect()
