"""SimHash classes against all pairs, the covering property of the anchors, edge cases."""

import random

import numpy as np
import pytest
import xxhash

from helixflow.llm import simhash
from helixflow.llm.simhash import SimHashOptions

DOC = "doc_id long, text string, comp string, id string"


def brute_print(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_classes(prints, bits=4):
    """{id: least id reachable} of {id: fingerprint}."""
    ids = sorted(prints)
    fp = np.array([prints[i] for i in ids], np.uint64)
    comp = {}
    for start in range(len(ids)):
        if ids[start] in comp:
            continue
        todo = [start]
        comp[ids[start]] = ids[start]
        while todo:
            at = todo.pop()
            for k in np.flatnonzero(np.bitwise_count(fp ^ fp[at]) <= bits):
                if ids[k] not in comp:
                    comp[ids[k]] = ids[start]
                    todo.append(int(k))
    return comp


def test_query_against_all_pairs(spark, sf_dir):
    docs = {r.doc_id: brute_print(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op13_simhash(spark, sf_dir).collect()}
    comp = brute_classes(docs)
    assert got == {i: (f"{fp:016x}", comp[i]) for i, fp in docs.items()}
    assert len(set(comp.values())) < len(docs)


@pytest.mark.parametrize("blocks", [(23, 3, 3, 3), (23, 7, 1, 1), (23, *[1] * 9), (15, 15, 1, 1), (7, 7, 7, 7, 3, 1), (1,) * 32])
def test_homes_meet_all_within_the_threshold(blocks):
    rng = np.random.default_rng(7)
    options = SimHashOptions(blocks=blocks)
    x = rng.integers(-(2**63), 2**63, 40)
    for n in range(5):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in x], np.uint64)
        y = (x.view(np.uint64) ^ flips).view(np.int64)
        row, anchor, home = simhash.visits(x, options)
        assert (np.bincount(row[home], minlength=len(x)) == 2).all() and anchor.max() < 2 << options.message_bits
        homes = set(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
        row, anchor, _ = simhash.visits(y, options)
        sent = list(zip(row.tolist(), anchor.tolist(), strict=True))
        assert len(sent) == len(set(sent))
        assert {r for r, _ in homes & set(sent)} == set(range(len(x)))


@pytest.mark.parametrize("options", [SimHashOptions().sized(100), SimHashOptions().sized(1 << 26), SimHashOptions(meet=3, pairs=50).sized(9), SimHashOptions(bits=3, blocks=(15, 15, 1, 1))])
def test_planted_fingerprints(spark, options):
    """Clusters, chains of links and crowds around one anchor, cut into blocks as well."""
    draw = random.Random(11)
    prints = []
    for _ in range(12):
        fp = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 12])):
            prints.append(fp)
            for _ in range(draw.randrange(1, 7)):
                fp ^= 1 << draw.randrange(64)
    prints += [1 << i for i in range(40)] + [draw.getrandbits(64) for _ in range(60)]
    nodes = spark.createDataFrame([(int(np.uint64(fp).astype(np.int64)),) for fp in sorted(set(prints))], "fp long").repartition(3)
    edges = simhash.links(simhash.meetings(nodes, options), options).collect()
    parent = {fp: fp for fp in prints}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in edges:
        a, b = r.a % 2**64, r.b % 2**64
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert {fp: find(fp) for fp in prints} == brute_classes({fp: fp for fp in prints}, options.bits)


def test_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, None), (2, ""), (4, " \n"), (5, "One  two"), (6, "one\ttwo"), (7, long), (8, long.upper()), (9, "Ä b c d"), (10, "ä b c d")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash_classes(df).collect())
    comp = brute_classes({i: brute_print(t) for i, t in rows if i})
    assert got == sorted((i or 0, f"{brute_print(t):016x}", comp[i] if i else None) for i, t in rows)
    assert comp[6] == 5 and comp[8] == 7 and comp[3] == comp[4] == 2 and comp[10] == 10
    assert simhash.simhash_classes(df.limit(0)).count() == 0
