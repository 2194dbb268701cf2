"""Operators over whole tables: brute force on small inputs, planted cases, edge cases."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixflow.llm import decontaminate, graph, jaccard_join, mixing, suffix_lm, url_filter

DOC = "doc_id long, text string, comp string, n string"


def brute_components(rows, k=4, percent=85):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def test_jaccard_query_against_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op1_jaccard_join(spark, sf_dir).collect()}
    assert got == brute_components(docs)


def test_jaccard_sends_few_rows(spark):
    """Groups of sets whose sizes can't link are left out, and what remains goes to the trees once; nothing else is lost."""
    nodes = spark.createDataFrame([(1, 100, [7, 8]), (2, 1000, [7, 9]), (3, 860, [9, 8]), (4, 98, [8, 5]), (5, 100, [6]), (6, 84, [6]), (7, 2000, [6])], "node long, n long, prefix array<long>")
    options = jaccard_join.JoinOptions()
    got = {(r.token, r.node, r.m) for r in jaccard_join.prefix_groups(nodes, options).collect()}
    assert got == {(9, 2, 2), (9, 3, 2), (8, 1, 3), (8, 4, 3), (6, 5, 3), (6, 6, 3)}
    for n in (1, 2, 6, 17, 100, 117, 100_000):
        sizes = [x for x in range(n, n + n // 5 + 2) if 100 * n >= options.percent * x]
        near = [r.near for r in spark.createDataFrame([(x,) for x in [n, *sizes[-3:]]], "n long").select(jaccard_join.size_class(options).alias("near")).collect()]
        assert max(near) - near[0] <= 1
    sent = []
    real = jaccard_join.tree_join
    jaccard_join.tree_join = lambda units, o: sent.append(units.groupBy("node").count().agg(F.max("count")).first()[0]) or real(units, o)
    try:
        words = [f"w{i}" for i in range(100)]
        texts = [" ".join([*words[:60], *(f"x{k}y{i}" for i in range(8))]) for k in range(60)]
        rows = list(enumerate(texts))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, jaccard_join.JoinOptions(block=8, hub_rounds=1)).collect()}
    finally:
        jaccard_join.tree_join = real
    assert got == brute_components(rows) and all((k or 0) <= 2 for k in sent)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_near_copies(spark, k, percent):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = list(rng.choice(vocabulary, 60))
        for c in range(12):
            words = list(base)
            for _ in range(c // 2):
                words[rng.integers(60)] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(words)))
    rows += [(100, "a b"), (101, "A  b"), (102, "a"), (103, ""), (104, None), (105, " \n"), (106, "a b c d"), (107, "z " * 5000), (108, "Z " * 5000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)
    options = jaccard_join.JoinOptions(words=k, percent=percent, block=5, frequent_least=3, hub_rounds=1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, options).collect()}
    assert got == brute_components(rows, k, percent)


def test_jaccard_long_texts_that_share_little_are_not_sent(spark, monkeypatch):
    rng = random.Random(5)
    passage = "a passage that all of them quote"
    texts = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(2500)), passage]) for _ in range(12)]
    texts.append(texts[0].replace(passage, "some other end"))
    sent = []
    linked = jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda pairs, *a: (sent.append(pairs.count()), linked(pairs, *a))[1])
    found = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {**{i: i for i in range(12)}, 12: 0}
    assert 1 <= sum(sent) <= 2


def test_parities_drop_no_link():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 40, 511, 513, 700, 1500, 5000)]
    for s in sets[:]:
        sets += [np.r_[s[: int(len(s) * keep)], rng.integers(0, 1 << 63, int(len(s) * more), dtype=np.uint64)] for keep, more in ((1, 0.17), (0.93, 0.07), (0.5, 0.5), (1, 0.05))]
    sets = [np.unique(s) for s in sets if len(s)]
    n = np.array([len(s) for s in sets])
    parity = jaccard_join.Parities(jaccard_join.parities(np.concatenate(sets), np.r_[0, np.cumsum(n)]), n)
    x, y = (k.ravel() for k in np.indices((len(sets), len(sets))))
    may = parity.may_link(x, parity, y, 85)
    share = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)]
    link = np.array([100 * c >= 85 * (n[i] + n[j] - c) for c, i, j in zip(share, x, y, strict=True)])
    assert may[link].all() and link.sum() > len(sets)
    assert not may[(np.array(share) == 0) & (n[x] > 10) & (n[y] > 10)].any()


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x", "y"), (1, "a b c d e", "x", "y"), (None, "a b c d e", "x", "y"), (3, None, None, None)], DOC)
    out = jaccard_join.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in out) == [(0, 0, 2), (1, 1, 2), (1, 1, 2), (3, 3, 0)]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, i) for i in range(51, 80)] + [(90, 90), (91, 92), (91, 92)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 50 for i in range(50, 80)) and got[92] == 91


def test_components_in_parts(spark):
    table = lambda edges: spark.createDataFrame(edges, "a long, b long")
    draw = random.Random(5)
    parts = [[], [(draw.randrange(60), draw.randrange(60)) for _ in range(15)], [(7, 7)], [(draw.randrange(90), draw.randrange(90)) for _ in range(25)], [(i, i + 1) for i in range(100, 120)] + [(3, 110)]]
    comps = None
    for part in parts:
        comps = graph.joined_components(comps, table(part))
    whole = {r.node: r.comp for r in graph.components(table(sum(parts, []))).collect()}
    rows = comps.collect()
    assert {r.node: r.comp for r in rows} == whole and len(rows) == len(whole)


def test_suffix_lm_base_and_held_out(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    c = collections.Counter()
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    out = suffix_lm.op2_suffix_lm(spark, sf_dir).collect()
    assert len(out) == len(docs)
    for r in out:
        mine = tokens(docs[r.doc_id])
        assert r.train_tokens == n and r.n_tokens == len(mine) and r.n_known == sum(c[w] > 0 for w in mine)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in mine), rel=1e-9)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_tree(texts, depth=3, least=4, least_next=2, gain=0.02, discount=0.5):
    """p(context, word), kept contexts and word counts, by the definition in plain Python. texts: lists of tokens."""
    counts = collections.Counter(w for t in texts for w in t)
    n, v = sum(counts.values()), len(counts)
    seen, after = collections.Counter(), collections.defaultdict(collections.Counter)
    alphabet = {w for w, c in counts.items() if c >= least}
    for t in texts:
        for i in range(1, len(t)):
            for d in range(1, min(depth, i) + 1):
                seen[tuple(t[i - d : i])] += 1
                after[tuple(t[i - d : i])][t[i]] += 1
    nexts = {k: {w: c for w, c in after[k].items() if c >= least_next and w in alphabet} for k, c in seen.items() if c >= least and set(k) <= alphabet}
    nexts = {k: x for k, x in nexts.items() if x}

    def rest(k):
        return (seen[k] - sum(nexts[k].values()) + discount * len(nexts[k])) / seen[k]

    def p(context, w, kept):
        q = p(context[1:], w, kept) if context else (counts[w] + 1) / (n + v + 1)
        if not context or context not in kept:
            return q
        c = nexts[context].get(w, 0)
        return (max(c - discount, 0) if c else 0) / seen[context] + rest(context) * q

    def own(k):
        q = {w: p(k[1:], w, nexts) for w in nexts[k]}
        here = {w: (c - discount) / seen[k] for w, c in nexts[k].items()}
        r, others = rest(k), 1 - sum(q.values())
        return sum(here[w] * math.log2(here[w] / q[w]) for w in q) + (r * math.log2(r / others) if r > 0 and others > 0 else 0)

    kept = {k for k in nexts if own(k) >= gain}
    kept |= {k[i:] for k in kept for i in range(1, len(k))}
    return p, kept, counts


def score_all(spark, texts, options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.lit(False))
    words = suffix_lm.count_words(df)
    tree = suffix_lm.grow_tree(df, words, options)
    n = sum(x.where("retained").count() for x in tree.contexts)
    return n, suffix_lm.score_texts(df, words, tree).collect(), tree


def test_suffix_tree_is_a_distribution(spark):
    rng = np.random.default_rng(5)
    words = ["a", "b", "c", "d"]
    texts = []
    for _ in range(200):
        w = ["a"]
        for _ in range(30):
            w.append(str(rng.choice(words, p={"a": [0.1, 0.7, 0.1, 0.1], "b": [0.7, 0.1, 0.1, 0.1], "c": [0.25] * 4, "d": [0.1, 0.1, 0.1, 0.7]}[w[-1]])))
        texts.append(" ".join(w))
    rows = [[*t.split(), " "] for t in texts]
    p, kept, counts = brute_tree(rows, depth=2)
    n, out, tree = score_all(spark, texts, suffix_lm.TreeOptions(depth=2, least_count=4, least_next=2))
    assert n == len(kept) > 4 and tree.contexts[0].where("not retained").count() == 4 - sum(len(k) == 1 for k in kept)
    for context in ((), ("a",), ("b", "a"), ("d", "d")):
        assert sum(p(context, w, kept) for w in [*counts, "never"]) == pytest.approx(1.0, abs=1e-9)
    for r in out:
        w = rows[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(w[max(0, i - 2) : i]), w[i], kept)) for i in range(len(w))), rel=1e-9)


def test_repeated_pairs_hold_all_that_repeat(spark):
    """Every pair that occurs twice, in one task or in two, is in the bitmap; of those that occur once, hardly any is."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, 60)) for _ in range(400)] + ["w1 w1 w1", "", None]
    pairs = collections.Counter()
    for t in texts:
        w = [*(t or "").split(), " "]
        pairs.update(zip(w, w[1:]))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    words = suffix_lm.Bitmap.of(suffix_lm.count_words(df).select(F.col("key").alias("code")))
    held = suffix_lm.repeated_pairs(df, spark.sparkContext.broadcast(words))
    ids = {w: suffix_lm.END if w == " " else np.uint64(suffix_lm.word_id(w.encode())) for pair in pairs for w in pair}
    known = held.has(suffix_lm.pair_code(*(np.array([ids[p[i]] for p in pairs], np.uint64) for i in (0, 1))))
    n = np.array(list(pairs.values()))
    assert known[n > 1].all() and (n > 1).sum() > 1000 and (n == 1).sum() > 1000 and known[n == 1].mean() < 0.01
    assert not suffix_lm.repeated_pairs(df.limit(0), spark.sparkContext.broadcast(words)).any()


@pytest.mark.parametrize("spans", [1, 7])
def test_pairs_are_counted_packed(spark, monkeypatch, spans):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(60)]
    monkeypatch.setattr(suffix_lm, "TOKENS", 100)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = spark.sparkContext.broadcast(suffix_lm.Bitmap.of(suffix_lm.count_words(df).select(F.col("key").alias("code"))))
    counted = suffix_lm.count_next(df, 1, words, words, None, 2, spans)
    ids = {w: int(suffix_lm.word_id(w.encode())) for w in "abcdefgh"} | {"": int(suffix_lm.END)}
    want = collections.Counter(p for t in texts for w in [[*t.split(), ""]] for p in zip(w[:-1], w[1:], strict=True))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert {(r.context, r.key): r.c for r in counted.collect()} == {tuple(signed(ids[w]) for w in p): c for p, c in want.items() if c >= 2}
    assert counted.count() == len(set(counted.select("context", "key").collect()))
    assert suffix_lm.count_next(df.limit(0), 1, words, words, None, 2, spans).count() == 0


def test_facts_are_packed_by_spans(spark):
    """Scoring reads a row for each span and level instead of one for each fact, and the bitmap holds all of them."""
    rng = np.random.default_rng(4)
    codes = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    facts = spark.createDataFrame([(int(x), i % 300 + 1, i % 7 * 1000) for i, x in enumerate(codes)], "code long, value long, rest long")
    packed = suffix_lm.packed_facts(facts, 5 * suffix_lm.SPAN_TOKENS)
    rows = packed.collect()
    assert sorted(r.span for r in rows) == list(range(5))
    got = {}
    for r in rows:
        code = suffix_lm.unpack_codes(r["codes"])
        assert (suffix_lm.code_span(code, 5) == r.span).all()
        got |= {int(c): (int(v), int(w)) for c, v, w in zip(code.view(np.int64), suffix_lm.from_planes(r["values"]), suffix_lm.from_planes(r["rests"]), strict=True)}
    assert got == {r.code: (r.value, r.rest) for r in facts.collect()}
    held = suffix_lm.fact_bitmap(packed)
    assert held.has(codes.view(np.uint64)).all() and np.bitwise_count(held.cells).sum() <= 3000


def test_suffix_lm_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "b b", None)], "doc_id long, text string, score string").withColumn("held_out", F.col("doc_id") == 2)
    df = df.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    train = df.where(~F.col("held_out"))
    counts = suffix_lm.count_words(train)
    out = suffix_lm.score_texts(df, counts, suffix_lm.grow_tree(train, counts, suffix_lm.TreeOptions())).collect()
    assert len(out) == 4 and {r.n_tokens for r in out} == {1, 3}
    none = df.limit(0)
    counts = suffix_lm.count_words(none)
    assert suffix_lm.score_texts(none, counts, suffix_lm.grow_tree(none, counts, suffix_lm.TreeOptions())).count() == 0


def test_suffix_tree_keeps_rare_contexts(spark):
    """Contexts far below any share of all tokens are kept by their count, and scored as by the definition."""
    texts = [f"p{i} q{i} r{(i + j) % 2 * 1000 + i} s{i}" for i in range(700) for j in range(6)] + ["p1 q1 lost", "lost p9 r9", "p2 q3"]
    rows = [[*t.split(), " "] for t in texts]
    p, kept, _ = brute_tree(rows)
    n, out, _ = score_all(spark, texts, suffix_lm.TreeOptions(least_count=4, least_next=2, bucket_tokens=5000))
    assert n == len(kept) > 1400
    for r in out:
        w = rows[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(w[max(0, i - 3) : i]), w[i], kept)) for i in range(len(w))), rel=1e-9)


def test_suffix_tree_is_grown_packed(spark, monkeypatch):
    """The tree's tables hold a few packed rows for each span, not one for each pair of a context and its next word."""
    df = spark.createDataFrame([(f"p{i} q{i} r{(i + j) % 2 * 1000 + i}",) for i in range(200) for j in range(6)], "text string")
    sizes, write = [], suffix_lm.materialise

    def counting(rows):
        out = write(rows)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(suffix_lm, "materialise", counting)
    tree = suffix_lm.grow_tree(df, suffix_lm.count_words(df), suffix_lm.TreeOptions(), keep=False)
    assert sum(len(suffix_lm.unpack_codes(r["codes"])) for r in tree.facts.collect()) > 1000
    assert len(sizes) > 3 and max(sizes) <= 4


def test_bitmaps_decide_nothing(spark, monkeypatch):
    """With bitmaps that let all through, words that are too rare for the alphabet still are none of the tree's."""
    full = lambda *_: suffix_lm.Bitmap(np.full(1, 0xFFFFFFFFFFFFFFFF, np.uint64))
    monkeypatch.setattr(suffix_lm.Bitmap, "of", full)
    monkeypatch.setattr(suffix_lm.Bitmap, "of_packed", full, raising=False)
    texts = [f"a b{i % 3} a rare{i // 2} c" for i in range(40)] + [f"few{i} few{i} few{i} a" for i in range(5)]
    rows = [[*t.split(), " "] for t in texts]
    p, kept, _ = brute_tree(rows)
    n, out, _ = score_all(spark, texts, suffix_lm.TreeOptions())
    assert n == len(kept) > 4
    for r in out:
        w = rows[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(w[max(0, i - 3) : i]), w[i], kept)) for i in range(len(w))), rel=1e-9)


def test_words_and_hashes(spark):
    """Words as by the pattern, hashed alike wherever a text is cut."""
    import re

    import pyarrow as pa

    from helixflow.llm import common

    texts = ["a B  c\n", None, "", " \x0b\x0c\r", "\u00e9\u00c9 \u2028x A", "word " * 50, "z" * 300, "ab" * 100 + " ab\tab", "\x1cq \x85"]
    for piece in (7, 64, 1 << 20):
        got = {}
        for row, w, at in common.word_pieces(pa.array(texts), piece):
            for k in range(len(at) - 1):
                got[row + k] = w[at[k] : at[k + 1]].tolist()
        for i, t in enumerate(texts):
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            low = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words]
            assert got[i] == [common.word_id(x.encode()) for x in low]


def test_fill_gives_siblings_first():
    assert mixing.fill(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert mixing.fill(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert mixing.fill(100, [1, 1, 2], [10, 10, 10]) == [10, 10, 10]
    assert sum(mixing.fill(7, [1, 1, 1], [5, 5, 5])) == 7
    assert mixing.fill(5, [0, 1], [9, 9]) == [0, 5] and mixing.fill(5, [], []) == []


def test_plan_keeps_shortages_below_their_parent():
    mix = mixing.Mix(weights={("a",): 0.5, ("b",): 0.5}, tokens=100, most_epochs=1)
    supply = {("a", "x", "1"): 10, ("a", "y", "1"): 500, ("b", "x", "1"): 500}
    assert mixing.plan(supply, mix) == {("a", "x", "1"): 10, ("a", "y", "1"): 40, ("b", "x", "1"): 50}
    supply[("a", "y", "1")] = 20
    assert mixing.plan(supply, mix) == {("a", "x", "1"): 10, ("a", "y", "1"): 20, ("b", "x", "1"): 70}


@pytest.mark.parametrize("bucket", [7, 20_000])
def test_mixing_against_brute_force(spark, sf_dir, bucket):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars")
    mix = mixing.PRODUCTION
    rows = docs.withColumn("t", mixing.words(F.col("text"))).collect()
    leaf = {r.doc_id: (mix.domains.get(r.source, mix.other), r.lang, r.source) for r in rows}
    supply = collections.Counter()
    for r in rows:
        supply[leaf[r.doc_id]] += r.t
    budget = mixing.plan(supply, mix)
    expected = set()
    for key, b in budget.items():
        mine = [r for r in rows if leaf[r.doc_id] == key]
        whole, rest = divmod(b, supply[key]) if supply[key] else (0, 0)
        expected |= {(r.doc_id, e) for r in mine for e in range(whole)}
        place = {x.doc_id: x.h & ((1 << 64) - 1) for x in spark.createDataFrame([(r.doc_id,) for r in mine], "doc_id long").select("doc_id", F.xxhash64(F.lit(mix.seed), F.lit(whole), "doc_id").alias("h")).collect()} if rest else {}
        total = 0
        for r in sorted(mine, key=lambda r: place.get(r.doc_id, 0)) if rest else []:
            total += r.t
            if total > rest:
                break
            expected.add((r.doc_id, whole))
    got = [(r.doc_id, r.epoch) for r in mixing.mix_sources(docs, mix, rows_a_bucket=bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_mixing_edges(spark):
    schema = "doc_id long, text string, lang string, source string, domain string"
    df = spark.createDataFrame([(1, "a b", None, None, "x"), (1, "a b", None, None, "x"), (None, None, "en", "s", None), (3, "", "en", "s", "y"), (4, "w " * 50000, "en", "s", "y")], schema)
    out = mixing.mix_sources(df, mixing.Mix(share=1.0)).collect()
    # Both domains weigh the same, so the small leaf is filled to its three epochs: two rows each.
    assert collections.Counter(r.doc_id for r in out)[1] == 6
    assert mixing.mix_sources(df.limit(0)).count() == 0


STORY = "In March Tom Smith bought 12 kg of apples for 30 dollars and gave 12 of them to Anna so how many did he keep for himself then?"
AGAIN = "In March Bob Jones bought 15 kg of apples for 70 euros and gave 15 of them to Clara so how many did he keep for himself then?"
MIXED = "In March Tom Smith bought 12 kg of apples for 30 dollars and gave 19 of them to Anna so how many did he keep for himself then?"


def test_leaks(spark):
    docs = [(1, STORY), (2, f"x y z.\nfoo {AGAIN} bar"), (3, MIXED), (4, "clean text of many words that shares nothing with the benchmark at all"), (5, None), (6, ""), (7, "pad " * 20000 + STORY), (8, STORY), (8, STORY), (None, STORY)]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(9, STORY, "c"), (10, None, "c"), (11, "too short", "c")], "item_id long, text string, doc_id string")
    out = {r.doc_id: (r.item_id, r.same_values) for r in decontaminate.find_leaks(d, b).collect()}
    assert out == {1: (9, True), 2: (9, False), 7: (9, True), 8: (9, True), None: (9, True)}
    left = [r.doc_id for r in decontaminate.drop_leaks(d, b).collect()]
    assert sorted(left) == [3, 4, 5, 6]
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0 and decontaminate.find_leaks(d, b.limit(0)).count() == 0


def test_leaks_by_occurrence(spark):
    other = AGAIN.replace("Bob Jones", "Bob").replace("15 kg", "15 or so kg")
    docs = [(1, f"{STORY}\n{AGAIN}"), (2, f"{AGAIN} {STORY} {AGAIN}"), (3, STORY + " word" * 300 + " and In March Joe Brown bought 99 kg of apples for 70 pounds"), (4, f"{MIXED} {MIXED}"), (5, f"say {STORY} {other}"), (6, "He said open 7 doors now and left"), (7, "He said open 8 doors now and left")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(9, STORY), (12, "Open 7 doors now"), (13, "")], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r.same_values for r in decontaminate.find_leaks(d, b).collect()}
    assert out == {(1, 9): True, (2, 9): True, (3, 9): True, (5, 9): True, (6, 12): True}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(d, b).collect()) == [4, 7]


def test_leaks_at_any_place(spark):
    """Copies at every offset, edited ones, decimals as one number, and items of different lengths that don't disturb each other."""
    item = "a farmer sells 12.5 kg of wheat and 3 bags of corn to the market before the storm comes over the hill"
    other = item.replace("12.5", "40.75").replace(" 3 ", " 9 ")
    wrong = item.replace("12.5", "12.5 kg of rye and 12")
    edited = item.replace("before the storm", "well before the big storm")
    docs = [(k, "pad " * k + item) for k in range(7)] + [(20, other), (21, edited), (22, "a market before the storm comes over"), (23, f"{wrong} {item}"), (24, "one two three four five six")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "one two three four five six"), (3, "five six")], "item_id long, text string")
    out = {(r.doc_id, r.item_id): (r.n_windows, r.share) for r in decontaminate.find_leaks(d, b).collect()}
    assert {k for k in out if k[1] == 1} == {(k, 1) for k in (*range(7), 20, 21, 23)} and (24, 2) in out and (24, 3) in out and len(out) == 12
    assert all(out[k, 1] == (out[0, 1][0], 1.0) for k in range(7)) and out[21, 1][1] < 1


def test_leak_query_against_search(spark, sf_dir):
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(i, j) for i, t in docs.items() for j, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op9_decontaminate(spark, sf_dir).collect()}
    assert whole <= got and len(got) <= len(whole) + 2


def brute_rule(host, path):
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def test_url_rules(spark):
    urls = ["http://A.Example.org/es/x?y", "https://example.org/en/12#z", "http://x.org", "http://x.org/", "ftp://a.com/fr/1", "http://a.com/de/", "no url", None, "http://notexample.org/es/", "//x.org/", "http://a.net/?q=://b.org/", "://org/a"]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)] + [(0, urls[0], None, "x")], "page_id long, url string, html string, host string")
    out = url_filter.judge_urls(df).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = min((rest.split(c)[0] for c in "/?#"), key=len)
        path = min((rest[len(host) :].split(c)[0] for c in "?#"), key=len)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (r.host, r.path) == (host, path)
        best = brute_rule(host, path)
        assert r.rule == (best[0] if best else None)
        if best:
            assert r.verdict == best[1]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_propagation_against_brute_force(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    pages = [(1, "http://good.org/a", link("nice.net", "nice.net", "even.net")), (2, "http://bad.com/de/1", ""), (3, "http://farm.net/x", link("bad.com")), (4, "http://nice.net/x", link("even.net")), (5, "http://lone.net/", None), (6, "http://even.net/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.host: r for r in url_filter.judge_urls(df).collect()}
    edges = {("good.org", "nice.net"): 2, ("good.org", "even.net"): 1, ("farm.net", "bad.com"): 1, ("nice.net", "even.net"): 1}
    hosts = {h for e in edges for h in e} | {"lone.net"}
    t0, d0 = {"good.org": 1.0}, {"bad.com": 1.0}
    t, d = dict(t0), dict(d0)
    for _ in range(6):
        nt, nd = ({h: x.get(h, 0) * 0.15 for h in hosts} for x in (t0, d0))
        for (a, b), w in edges.items():
            nt[b] += 0.85 * t.get(a, 0) * w / sum(x for (s, _), x in edges.items() if s == a)
            nd[a] += 0.85 * d.get(b, 0) * w / sum(x for (_, s), x in edges.items() if s == b)
        t, d = nt, nd
    for h in hosts:
        assert out[h].trust == pytest.approx(t[h], abs=1e-12) and out[h].distrust == pytest.approx(d[h], abs=1e-12)
    assert {h for h in hosts if out[h].verdict == "block"} == {"bad.com", "farm.net"}


def test_url_propagation_settles(spark):
    """A chain longer than any fixed number of rounds, and a cycle, against the solution of the linear system."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    edges = [(f"c{i}.net", f"c{i + 1}.net") for i in range(12)] + [("c12.net", "bad.com"), ("a.net", "b.net"), ("b.net", "a.net"), ("good.org", "a.net"), ("b.net", "bad.com")]
    hosts = sorted({h for e in edges for h in e})
    pages = [(i, f"http://{h}/de/1", link(*[b for a, b in edges if a == h])) for i, h in enumerate(hosts)]
    out = {r.host: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        m[at[a], at[b]] = 1
    step = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1)
    solve = lambda x, seed: np.linalg.solve(np.eye(len(hosts)) - 0.85 * step(x).T, 0.15 * np.eye(len(hosts))[at[seed]])
    trust, distrust = solve(m, "good.org"), solve(m.T, "bad.com")
    for h in hosts:
        assert out[h].trust == pytest.approx(trust[at[h]], abs=1e-5) and out[h].distrust == pytest.approx(distrust[at[h]], abs=1e-5)
    assert all(out[f"c{i}.net"].verdict == "block" for i in range(13))
    with pytest.raises(RuntimeError):
        seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust0 double, distrust0 double")
        url_filter.propagate(seeds, spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, weight long"), most_rounds=5)


def test_verdicts_settle_early_and_at_any_scale(spark):
    """Verdicts of few rounds equal those of settled ranks; seeds of 1e10 settle as well."""
    draw = random.Random(8)
    hosts = [f"h{i}.{draw.choice(['org', 'net', 'com'])}" for i in range(60)]
    pages = [(i, f"http://{draw.choice(hosts)}/{draw.choice(['fr', 'de', 'x'])}/{i}", " ".join(f'<a href="http://{draw.choice(hosts)}/">' for _ in range(draw.randrange(4)))) for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    full, few = ({r.page_id: r.verdict for r in url_filter.judge_urls(df, ranks=ranks).collect()} for ranks in (True, False))
    assert full == few and set(full.values()) == {"allow", "block"}
    seeds = [(h, draw.random() * 1e10, draw.random() * 1e10) for h in hosts]
    edges = [(a, b, draw.randrange(1, 9)) for a in hosts for b in draw.sample(hosts, 3) if a != b]
    rank = url_filter.propagate(spark.createDataFrame(seeds, "host string, trust0 double, distrust0 double"), spark.createDataFrame(edges, "src string, dst string, weight long")).collect()
    step = np.zeros((60, 60))
    for a, b, w in edges:
        step[hosts.index(b), hosts.index(a)] += w / sum(e[2] for e in edges if e[0] == a)
    want = np.linalg.solve(np.eye(60) - 0.85 * step, 0.15 * np.array([s[1] for s in seeds]))
    got = np.zeros(60)
    for r in rank:
        got[hosts.index(r.host)] = r.trust
    assert np.abs(got - want).sum() <= 1e-6 * sum(s[1] + s[2] for s in seeds)
