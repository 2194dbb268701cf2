"""Runs against a brute-force search of all periods; the digests of the query; edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from helixflow.llm import periodic_runs
from helixflow.llm.periodic_runs import RunOptions

DOC = "doc_id long, text string, comp string, runs string"


def brute_runs(words, least=12):
    """(start, length, period) of each stretch with smallest period q, by q: words q apart are equal."""
    names = {}
    w = np.array([names.setdefault(x, len(names)) for x in words], np.int64)
    found = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.r_[False, w[q:] == w[:-q], False]
        start, end = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            e += q
            if e - s >= max(least, 2 * q) and (s, e) not in found:  # periods ascend, so the smallest stays
                found[s, e] = q
    return sorted((s, e - s, q) for (s, e), q in found.items())


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row(doc_id, text):
    words = rewritten(doc_id, (text or "").encode().split())
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(kept))


def digests(df):
    return [(r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in df.collect()]


def test_query_against_all_periods(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = dict(digests(periodic_runs.op12_periodic_runs(spark, sf_dir)))
    assert got == {r.doc_id: row(r.doc_id, r.text) for r in docs}
    assert sum(v[0] for v in got.values()) > 10


def texts(seed):
    """Words of few letters, periodic stretches of all sorts, Fibonacci words and repeats of repeats."""
    draw = random.Random(seed)
    for size in (1, 2, 3, 5):
        for n in (0, 1, 11, 12, 13, 40, 90, 200):
            yield [b"%d" % draw.randrange(size) for _ in range(n)]
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(9):
        a, b = b, b + a
    yield b
    for _ in range(60):
        out = []
        while len(out) < draw.choice([30, 120, 400]):
            root = [b"%d" % draw.randrange(draw.choice([2, 4, 50])) for _ in range(draw.randrange(1, 30))]
            out += root * draw.randrange(1, 9) + root[: draw.randrange(len(root) + 1)]
            if draw.random() < 0.3:
                out += out[-draw.randrange(1, len(out) + 1) :]
        yield out


@pytest.mark.parametrize("options", [RunOptions(), RunOptions(least=2), RunOptions(least=7, expand=5), RunOptions(least=30)])
def test_runs_of_many_texts(options):
    many = list(texts(options.least))
    for part in (many, *([t] for t in many[:20])):
        for words, (s, n, q) in zip(part, periodic_runs.text_runs(part, options), strict=True):
            assert list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)) == brute_runs(words, options.least)


def test_suffixes_and_lcp():
    words = [b"%d" % random.Random(3).choice([i % 7, i % 5]) for i in range(300)]
    coded = np.r_[0, np.array([int(w) + 1 for w in words]), 99]
    for least in (1, 3, 4):
        suffix, lcp = periodic_runs.sorted_suffixes(coded, least)
        tail = [tuple(coded[i:].tolist()) for i in suffix]
        assert tail == sorted(tail) and len(set(suffix.tolist())) == len(suffix)
        for k in range(1, len(tail)):
            same = next(i for i, (x, y) in enumerate(zip(tail[k - 1], tail[k])) if x != y)
            assert lcp[k] == (same if same >= least else 0)


def test_edges(spark):
    long = " ".join(["x y"] * 40_000 + ["end"])
    rows = [(1, "a a " * 9), (1, "a a " * 9), (None, "b " * 20), (3, None), (4, ""), (5, "\t\n "), (6, "Ab aB " * 7 + "Ab"), (7, " ".join(f"p{i % 977} q" for i in range(20_000)))]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows] + [(8, long, "c", "d")], DOC)
    out = periodic_runs.periodic_runs(df).collect()
    got = sorted(((r.doc_id or 0), [tuple(x) for x in r.runs], r.text) for r in out)
    assert got[0] == (0, [(0, 20, 1)], "b") and got[1] == got[2] == (1, [(0, 18, 1)], "a")
    assert got[3:6] == [(3, [], ""), (4, [], ""), (5, [], "")] and got[6] == (6, [(0, 15, 2)], "Ab aB")
    assert got[7][1] == [(0, 40_000, 1954)] and got[8][1:] == ([(0, 80_000, 2)], "x y end")
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
