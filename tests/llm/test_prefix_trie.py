"""The trie against a brute-force trie and DuckDB, shards of all sizes, hot paths, edge cases."""

import collections
import hashlib
import random
import zlib

import pytest

from helixflow.llm import prefix_trie

TURN = "conv_id long, turn long, role string, text string, path string, sizes string"
COLUMNS = [x.split(" ")[0] for x in prefix_trie.NODES.split(", ")]


def brute_nodes(paths, size):
    """Rows of NODES of {conv_id: tuple of turns}; size of a turn."""
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    below = collections.Counter()
    leaves = collections.Counter()
    parents = {p[:-1] for p in members if p}
    for p, m in members.items():
        saved = (len(m) - 1) * size(p[-1]) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]] += saved
            leaves[p[:d]] += p not in parents
    children = collections.Counter(p[:-1] for p in members if p)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(paths[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], below[p], ends(p)) for p, m in members.items())


def rows(df):
    return sorted(tuple(-1 if r[c] is None and c == "parent_conv_id" else r[c] for c in COLUMNS) for r in df.collect())


def rebuilt(turns):
    """{conv_id: tuple of (role, text)} of rows (conv_id, turn, role, text) without ties."""
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in turns if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    base = lambda c: c - (c % 5 if c >= 0 else -(-c % 5))
    return {c: tuple(own.get(base(c), [])[: h(c)] + own[c][h(c) :]) for c in list(own)}


def test_query_against_brute_force(spark, sf_dir):
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert rows(prefix_trie.op11_prefix_trie(spark, sf_dir)) == brute_nodes(rebuilt(turns), lambda t: len(t[1].encode()))


def random_paths(seed, n):
    draw = random.Random(seed)
    paths = {}
    for c in draw.sample(range(-50, 5 * n), n):
        if draw.random() < 0.35:
            paths[c] = (3, 3, 1)
        else:
            paths[c] = tuple(draw.randrange(draw.choice([2, 5])) for _ in range(draw.randrange(draw.choice([2, 7, 25]))))
    return paths


@pytest.mark.parametrize("n,shards,segment", [(1, 3, 4096), (60, 1, 4096), (60, 100, 2), (400, 7, 5), (400, 40, 1)])
def test_shards(spark, monkeypatch, n, shards, segment):
    """A third of all paths are equal; splitters cut nodes, their ends and single conversations."""
    monkeypatch.setattr(prefix_trie, "SAMPLE", 2)
    paths = random_paths(n + shards, n)
    key = lambda t: hashlib.md5(b"%d" % t).digest()
    table = [(c, bytearray(b"".join(map(key, p))), [t + 1 for t in p], "x") for c, p in paths.items()]
    df = spark.createDataFrame(table, "conv_id long, path binary, sizes array<long>, depth string").repartition(3)
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    assert rows(prefix_trie.prefix_trie(df, shards)) == brute_nodes(paths, lambda t: t + 1)


def test_turns(spark):
    """Nulls, ties, negative ids, absent bases, conversations that lose all turns, repeated rows, a long conversation."""
    draw = random.Random(4)
    turns = []
    for c in [*range(-12, 40), 1000, 1003, 7001]:
        for t in range(draw.randrange(1, 12)):
            turns.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["hi", "ähm", "", None, "ok then"])))
    turns += [(50, t, "user", f"turn {t % 3}") for t in range(1500)] + [(51, t, "user", f"turn {t % 3}") for t in range(1499)]
    turns += [(60, None, "user", "first"), (60, 0, "user", "second"), (None, 0, "user", "nobody's")]
    df = spark.createDataFrame([(*r, "p", "s") for r in turns], TURN)
    got = rows(prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(df), 5))
    assert got == brute_nodes(rebuilt(turns), lambda t: len(t[1].encode()))
    assert any(r[1] == 1500 for r in got) and prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(df.limit(0))).count() == 0
    tied = spark.createDataFrame([(0, 1, "a", "x", "", ""), (0, 1, "b", "y", "", ""), (0, 1, "a", "x", "", "")], TURN)
    out = [rows(prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(df))) for df in (tied, tied.repartition(3))]
    assert out[0] == out[1] and len(out[0]) == 4


def test_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    turns = [(r[0], r[1], r[2], r[3]) for r in [(c, None if not t else t, "user" if t % 2 else None, f"{c % 3 if t else ''}{t}") for c in range(-9, 30) for t in range(c % 6 + 1)]]
    df = spark.createDataFrame([(*r, "", "") for r in turns], TURN)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.sql(prefix_trie.OP11_SQL)
    at = [sql.columns.index(c) for c in COLUMNS]
    want = sorted(tuple(-1 if r[k] is None and c == "parent_conv_id" else r[k] for c, k in zip(COLUMNS, at, strict=True)) for r in sql.fetchall())
    assert rows(prefix_trie.op11_prefix_trie(spark, str(tmp_path))) == want
