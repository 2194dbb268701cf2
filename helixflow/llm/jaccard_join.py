"""N-gram Jaccard join by signature trees, and the components of its links.

1. Each document's set of word shingles is hashed; documents of equal sets become one node, named by a hash of the set.
2. The shingles of a set are ordered by levels of how many documents share them, rare ones first. Two sets that link
   share a shingle in their prefixes (the prefix filter, exact under any order), so nodes meet in groups by prefix
   shingle. Shingles whose groups turn out large move to the level of their group, and sets whose prefixes held one are ordered
   anew; for all other sets nothing changes.
3. Links to hubs come first and join most copies of a text into one component: in each round a node is checked against
   the one hub that most of its groups name.
4. Groups that still hold several components are joined to families, and signature trees built over blocks of about
   ``block`` nodes of each, in tasks that hold ``send_blocks`` blocks of either side (a family of m nodes sends
   m / (block * send_blocks) copies of each):
   leaves hold token bitmaps and sizes, inner nodes OR-combined bitmaps and size ranges. A dual traversal drops pairs
   of tree nodes that lie in one component, whose sizes exclude a link, or whose greatest possible overlap is too small.
   Pairs of single nodes, here and in 3, are dropped as well where their parities differ in more bits than the sets of a
   link can differ in shingles. Parities grow with the set, so that this holds for long texts too.
5. Pairs that remain are checked by their exact sets: texts go to the task of their partner once for each pair.

The order in 2 and the hubs in 3 only save work; no pair of different components is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialise, mix64, release, table, tidy, word_pieces
from .graph import joined_components

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Bits of the signatures.
TREE_BITS = 1024
FAN = 8
#: Bits of the parities of a set, at least; a set of more shingles has the next power of two.
PARITY_BITS = 512
#: A list of ids longer than this is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 250_000


@dataclass(frozen=True)
class JoinOptions:
    words: int = 4
    percent: int = 85
    frequent_least: int = 16  # documents that share a shingle of level 1; each further level needs 16 times as many
    levels: int = 4
    level_bits: int = 1 << 24  # of the bitmap of a level; a wrong bit moves a shingle back in the order, for all sets alike
    block: int = 512
    send_blocks: int = 16  # a task of the trees gets so many blocks of both sides, so that a node is sent less often
    order_rounds: int = 1
    hub_rounds: int = 2  # one at least
    pilot: int = 48  # nodes of a family that all others meet first
    members: int = 2000  # of a hub, in one task

    def prefix(self, n):
        return n - -(-self.percent * n // 100) + 1


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of texts, one text after another, and their offsets. words, at: as of word_pieces.
    A shingle is k words, or all of them where there are fewer; no words, no shingles."""
    size = np.diff(at)
    count = np.where(size >= k, size - k + 1, (size > 0).astype(size.dtype))
    start = np.r_[0, np.cumsum(count)]
    out = np.empty(start[-1], np.uint64)

    def mixed(w, m):
        h = np.full(len(w) - m + 1, np.uint64(m), np.uint64)
        for i in range(m):
            h += w[i : len(w) - m + 1 + i] * FACTORS[i % len(FACTORS)] * np.uint64(2 * (i // len(FACTORS)) + 1)
        return mix64(h)

    whole = size >= k
    if whole.any():
        h = mixed(words, k)
        into = np.repeat(whole, count)
        shift = np.repeat(at[:-1] - start[:-1], count)
        out[into] = h[(np.arange(start[-1]) + shift)[into]]
    for d in np.flatnonzero((size > 0) & ~whole):
        out[start[d]] = mixed(words[at[d] : at[d + 1]], int(size[d]))[0]
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[start[:-1][count > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][start]


def text_sets(column, k: int):
    """(first row, shingles, offsets) for runs of rows of an Arrow string column."""
    for row, words, at in word_pieces(column):
        yield row, *shingle_sets(words, at, k)


def set_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set: the sum of hashes of its shingles."""
    sums = np.r_[np.uint64(0), np.cumsum(mix64(h ^ np.uint64(0x51ED270B9F1D5E2D)), dtype=np.uint64)]
    return (sums[at[1:]] - sums[at[:-1]]).view(np.int64)


class Levels:
    """How common shingles are, as nested bitmaps: the level of a shingle is the number of bitmaps that hold it."""

    def __init__(self, options: JoinOptions, bitmaps: list[np.ndarray] | None = None):
        self.options = options
        self.bitmaps = bitmaps or [np.zeros(options.level_bits >> 6, np.uint64) for _ in range(options.levels)]

    def joined(self, counts: DataFrame) -> Levels:
        """With the shingles of counts (token, c). A bitmap's cells reach the driver, level_bits / 64 of them at most."""
        o = self.options
        level = F.least(F.floor(F.log(F.col("c") / o.frequent_least) / math.log(16)), F.lit(o.levels - 1)).cast("int")
        cells = counts.where(F.col("c") >= o.frequent_least).select(level.alias("level"), F.shiftright(F.col("token").bitwiseAND(o.level_bits - 1), 6).alias("cell"), F.expr("shiftleft(1L, cast(token & 63 as int))").alias("bit"))
        found = cells.groupBy("level", "cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        out = [b.copy() for b in self.bitmaps]
        level, cell, bits = found.column("level").to_numpy(), found.column("cell").to_numpy(), found.column("bits").to_numpy().view(np.uint64)
        for i, b in enumerate(out):
            on = level >= i
            np.bitwise_or.at(b, cell[on], bits[on])
        return Levels(o, out)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint8)
        some = np.arange(len(h))
        for b in self.bitmaps:
            v = h[some] & np.uint64(self.options.level_bits - 1)
            some = some[(b[v >> np.uint64(6)] >> (v & np.uint64(63))) & np.uint64(1) > 0]
            if not len(some):
                break
            out[some] += 1
        return out


def shared_shingles(docs: DataFrame, options: JoinOptions) -> DataFrame:
    """token, c: shingles that many documents share, with rough counts. Only the order of prefixes depends on them: a
    task counts those that occur three times or more among some of its documents; large groups add what it misses."""
    import pyarrow as pa

    def often(found):
        token, c = np.unique(np.concatenate(found), return_counts=True)
        on = c >= 3
        return pa.RecordBatch.from_arrays([pa.array(token[on].view(np.int64)), pa.array(c[on])], names=["token", "c"])

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for _, h, _ in text_sets(batch.column(0), options.words):
                found.append(h)
                size += len(h)
                if size > 1_500_000:
                    yield often(found)
                    found, size = [], 0
        if found:
            yield often(found)

    schema = T.StructType().add("token", T.LongType()).add("c", T.LongType())
    return docs.select("text").mapInArrow(run, schema).groupBy("token").agg(F.sum("c").alias("c"))


def prefixes(h: np.ndarray, at: np.ndarray, levels: Levels, options: JoinOptions) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each set, in the order of levels, then hashes; and their offsets."""
    size = np.diff(at)
    p = np.where(size > 0, options.prefix(size), 0)
    level = levels.of(h)
    rare = level == 0
    before = np.r_[0, np.cumsum(rare)]
    have = before[at[1:]] - before[at[:-1]]
    rank = before[:-1] - np.repeat(before[at[:-1]], size)
    into = np.r_[0, np.cumsum(p)]
    out = np.empty(into[-1], np.uint64)
    pick = rare & (rank < np.repeat(p, size))
    out[(np.repeat(into[:-1], size) + rank)[pick]] = h[pick]
    for d in np.flatnonzero(have < p):
        a, b = at[d], at[d + 1]
        late = np.flatnonzero(~rare[a:b]) + a
        late = late[np.argsort(level[late], kind="stable")][: p[d] - have[d]]
        out[into[d] + have[d] : into[d + 1]] = h[late]
    return out, into


def signatures(docs: DataFrame, levels: Levels, options: JoinOptions, bits: bool = True) -> DataFrame:
    """doc_id, n, node (hash of the set), text_id, prefix, bits and parity (both left out on request)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(levels)  # levels * level_bits / 8 bytes
    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n", T.LongType()).add("node", T.LongType()).add("text_id", T.LongType()).add("prefix", T.ArrayType(T.LongType()))
    if bits:
        schema = schema.add("bits", T.BinaryType()).add("parity", T.BinaryType())

    def run(batches):
        for batch in batches:
            for row, h, at in text_sets(batch.column(1), options.words):
                rows = len(at) - 1
                head, into = prefixes(h, at, shared.value, options)
                cols = [batch.column(0).slice(row, rows), pa.array(np.diff(at)), pa.array(set_hash(h, at)), batch.column(2).slice(row, rows), pa.ListArray.from_arrays(pa.array(into.astype(np.int32)), pa.array(head.view(np.int64)))]
                if bits:
                    cols += [bitmaps(h, at), parities(h, at)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")).mapInArrow(run, schema)


def bitmaps(h: np.ndarray, at: np.ndarray):
    """An Arrow column of TREE_BITS for each set."""
    import pyarrow as pa

    rows = len(at) - 1
    on = np.zeros(rows * TREE_BITS, bool)
    on[np.repeat(np.arange(rows), np.diff(at)) * TREE_BITS + (h & np.uint64(TREE_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(on, bitorder="little")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(TREE_BITS // 8), rows, [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())


def parities(h: np.ndarray, at: np.ndarray):
    """An Arrow column of bits for each set, PARITY_BITS or more: whether an odd number of its shingles have a bit's place. One
    shingle in only one of two sets turns one bit, so sets differ in as many shingles at least as their parities in bits."""
    import pyarrow as pa

    size = np.diff(at)
    places = np.maximum(PARITY_BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    start = np.r_[0, np.cumsum(places)]
    at_bit = np.repeat(start[:-1], size) + ((h >> np.uint64(10)).astype(np.int64) & np.repeat(places - 1, size))
    odd = np.bincount(at_bit, minlength=start[-1]).astype(np.uint8) & 1
    packed = np.packbits(odd, bitorder="little")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(start >> 3), pa.py_buffer(packed)]).cast(pa.binary())


class Parities:
    """Parities of many sets. Those of the larger of two sets are folded to the bits of the smaller's."""

    def __init__(self, column, n: np.ndarray):
        import pyarrow as pa

        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.cells = np.frombuffer(column.buffers()[2], np.uint64, count=int(at[-1]) >> 3) if len(column) else np.zeros(0, np.uint64)
        self.start, self.size, self.n = at[:-1] >> 3, np.diff(at) >> 3, n

    def folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((len(rows), size), np.uint64)
        own = self.size[rows]
        for s in np.unique(own).tolist():
            k = np.flatnonzero(own == s)
            cells = self.cells[self.start[rows[k]][:, None] + np.arange(s)]
            out[k] = np.bitwise_xor.reduce(cells.reshape(len(k), s // size, size), axis=1)
        return out

    def may_link(self, x: np.ndarray, other: Parities, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether sets x of these and y of others may link by their sizes and parities, pair by pair."""
        out = 100 * np.minimum(self.n[x], other.n[y]) >= percent * np.maximum(self.n[x], other.n[y])
        size = np.minimum(self.size[x], other.size[y])
        longest = np.maximum(self.size[x], other.size[y])
        for s in np.unique(size).tolist():
            k = np.flatnonzero(out & (size == s))
            step = np.cumsum(longest[k]) // (1 << 19)  # bounds the copies of cells
            for part in np.split(k, np.flatnonzero(np.diff(step)) + 1):
                a, b = x[part], y[part]
                differ = np.bitwise_count(self.folded(a, s) ^ other.folded(b, s)).sum(axis=1, dtype=np.int64)
                out[part] = (100 + percent) * differ <= (100 - percent) * (self.n[a] + other.n[b])
        return out


class Tree:
    """Signature trees of many groups side by side, as levels of arrays from single rows (level 0) to one root each."""

    def __init__(self, group, n, left, comp, excess, bits):
        self.levels = [{"group": group, "least": n, "most": n, "left": left, "c0": comp, "c1": comp, "excess": excess, "bits": bits, "child": None}]

    @property
    def done(self) -> bool:
        g = self.levels[-1]["group"]
        return len(np.unique(g)) == len(g)

    def grow(self):
        low = self.levels[-1]
        g = low["group"]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
        cut = np.flatnonzero(rank % FAN == 0)
        red = lambda f, k: f.reduceat(low[k], cut)
        self.levels.append({"group": g[cut], "least": red(np.minimum, "least"), "most": red(np.maximum, "most"), "left": red(np.maximum, "left"), "c0": red(np.minimum, "c0"), "c1": red(np.maximum, "c1"), "excess": red(np.maximum, "excess"), "bits": np.bitwise_or.reduceat(low["bits"], cut, axis=0), "child": np.r_[cut, len(g)]})


def dual_traversal(left: Tree, right: Tree, percent: int):
    """Index pairs (rows of left, rows of right) of one group that may link and lie in different components."""
    while not (left.done and right.done and len(left.levels) == len(right.levels)):
        deep = max(len(left.levels) + (not left.done), len(right.levels) + (not right.done))
        for tree in (left, right):
            if len(tree.levels) < deep:
                tree.grow()
    a, b = left.levels[-1], right.levels[-1]
    x = np.flatnonzero(np.isin(a["group"], b["group"]))
    y = np.searchsorted(b["group"], a["group"][x])
    for depth in range(len(left.levels) - 1, -1, -1):
        a, b = left.levels[depth], right.levels[depth]
        on = (100 * a["most"][x] >= percent * b["least"][y]) & (100 * b["most"][y] >= percent * a["least"][x])
        on &= ~((a["c0"][x] == a["c1"][x]) & (b["c0"][y] == b["c1"][y]) & (a["c0"][x] == b["c0"][y]))
        x, y = x[on], y[on]
        # Sets share nothing before their first common shingle, nor before the first one that the family has.
        need = percent * (a["least"][x] + b["least"][y])
        on = (100 + percent) * np.minimum(a["left"][x], b["left"][y]) >= need
        x, y, need = x[on], y[on], need[on]
        on = np.zeros(len(x), bool)
        for k in range(0, len(x), 32_768):  # bounds the copies of bitmaps
            p, q = x[k : k + 32_768], y[k : k + 32_768]
            overlap = np.bitwise_count(a["bits"][p] & b["bits"][q]).sum(axis=1, dtype=np.int64) + np.minimum(a["excess"][p], b["excess"][q])
            on[k : k + 32_768] = (100 + percent) * overlap >= need[k : k + 32_768]
        x, y = x[on], y[on]
        if depth == 0:
            return x, y
        nx, ny = a["child"][x + 1] - a["child"][x], b["child"][y + 1] - b["child"][y]
        size = nx * ny
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(ny, size)
        x, y = np.repeat(a["child"][x], size) + at // width, np.repeat(b["child"][y], size) + at % width


def sizes_meet(n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether a set of rows x and one of rows y may be of sizes that link; both are in the order of sizes."""
    return 100 * n[x[-1]] >= percent * n[y[0]] and 100 * n[y[-1]] >= percent * n[x[0]]


def tree_pairs(rows, options: JoinOptions):
    """(a, b) arrays for whole groups of rows: dict of arrays group, role, node, n, pos, comp, bits, and parity as Parities."""
    parity = rows["parity"]
    order = np.lexsort((rows["n"], rows["role"], rows["group"]))
    rows = {k: v[order] for k, v in rows.items() if k != "parity"}
    size = np.bincount(rows["group"])
    left = np.bincount(rows["group"][rows["role"] == 0], minlength=len(size))
    at = np.r_[0, np.cumsum(size)]
    work = np.cumsum(left * (size - left))
    out_a, out_b = [], []

    def meet(*sides):
        trees = []
        for k in sides:
            n, bits = rows["n"][k], rows["bits"][k]
            trees.append(Tree(rows["group"][k], n, n - rows["pos"][k], rows["comp"][k], n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), bits))
        x, y = dual_traversal(*trees, options.percent)
        x, y = sides[0][x], sides[1][y]
        near = parity.may_link(order[x], parity, order[y], options.percent)
        a, b = rows["node"][x[near]], rows["node"][y[near]]
        out_a.append(np.minimum(a, b)), out_b.append(np.maximum(a, b))

    start = 0
    while start < len(size):
        done = work[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(work, done + 300_000, side="right")))
        some = np.arange(at[start], at[stop])
        sides = [some[rows["role"][some] == role] for role in (0, 1)]
        # Several groups are small together; one group may be large, and is met block by block, in the order of sizes.
        blocks = [[x] if stop > start + 1 else np.split(x, np.arange(options.block, len(x), options.block)) for x in sides]
        for x in blocks[0]:
            for y in blocks[1]:
                if len(x) and len(y) and (stop > start + 1 or sizes_meet(rows["n"], x, y, options.percent)):
                    meet(x, y)
        start = stop
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def tree_join(units: DataFrame, options: JoinOptions) -> DataFrame:
    """a, b: candidate pairs from units (family, i, j, role, node, n, pos, comp, bits, parity), each unit a pair of blocks."""
    import pyarrow as pa

    def starts(rows):
        keys = [rows.column(k).to_numpy() for k in ("family", "i", "j")]
        return np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            new = starts(held)
            last = int(np.flatnonzero(new)[-1])  # the last unit may go on in the next batch
            if last and held.num_rows >= 4096:
                yield answer(held.slice(0, last), new[:last])
                held = held.slice(last)
        if held is not None:
            yield answer(held, starts(held))

    def answer(rows, new):
        group, role = np.cumsum(new) - 1, rows.column("role").to_numpy()
        twice = np.flatnonzero(role == 2)
        if len(twice):
            at = np.r_[np.arange(len(role)), twice]
            rows, group, role = rows.take(at), group[at], np.r_[np.where(role == 2, 0, role), np.ones(len(twice), role.dtype)]
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, TREE_BITS // 64)
        a, b = tree_pairs({"group": group, "role": role, "node": rows.column("node").to_numpy(), "n": rows.column("n").to_numpy(), "pos": rows.column("pos").to_numpy(), "comp": rows.column("comp").to_numpy(), "bits": bits, "parity": Parities(rows.column("parity"), rows.column("n").to_numpy())}, options)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    schema = T.StructType().add("a", T.LongType()).add("b", T.LongType())
    return units.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, schema)


def near_pairs(pairs: DataFrame, nodes: DataFrame, options: JoinOptions) -> DataFrame:
    """pairs (node, hub) whose parities allow a link, before any text is sent."""
    import pyarrow as pa

    side = nodes.select("node", "n", "parity")
    hubs = side.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("parity").alias("hub_parity"))
    rows = pairs.join(side, "node").join(hubs, "hub").select("node", "hub", "n", "parity", "hub_n", "hub_parity")

    def run(batches):
        for batch in batches:
            own, other = (Parities(batch.column(i + 1), batch.column(i).to_numpy()) for i in (2, 4))
            at = np.arange(batch.num_rows)
            on = pa.array(own.may_link(at, other, at, options.percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], names=["node", "hub"])

    return rows.mapInArrow(run, T.StructType().add("node", T.LongType()).add("hub", T.LongType()))


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, options: JoinOptions) -> DataFrame:
    """a, b: the distinct pairs (node, hub) that link, by their exact sets. Each pair sends the node's text to a task of
    the hub; a hub of many nodes has many tasks, each with the hub's own text."""
    import pyarrow as pa

    per = pairs.groupBy("hub").agg(F.ceil(F.count("*") / options.members).cast("int").alias("parts"))
    members = pairs.join(per, "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", F.lit(1).alias("role"))
    hubs = per.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(0).alias("role"))
    jobs = materialise(members.unionByName(hubs).join(nodes.select("node", "home"), "node"))
    asked = F.broadcast(jobs) if jobs.count() <= BROADCAST_ROWS else jobs
    rows = docs.join(asked, docs["doc_id"] == asked["home"]).select("hub", "part", "role", "node", "text")
    schema = T.StructType().add("a", T.LongType()).add("b", T.LongType())

    def run(batches):
        hub, base = None, None
        for batch in batches:
            hubs, role, node = (batch.column(i).to_numpy() for i in (0, 2, 3))
            a, b = [], []
            for row, h, at in text_sets(batch.column(4), options.words):
                name = set_hash(h, at)
                for k in range(len(at) - 1):
                    r = row + k
                    if name[k] != node[r]:
                        continue  # another text of the same id
                    x = h[at[k] : at[k + 1]]
                    if role[r] == 0:
                        hub, base = hubs[r], x
                    elif hub == hubs[r] and 100 * min(len(x), len(base)) >= options.percent * max(len(x), len(base)):
                        place = np.searchsorted(base, x)
                        place[place == len(base)] = 0
                        shared = int((base[place] == x).sum())
                        if 100 * shared >= options.percent * (len(x) + len(base) - shared):
                            a.append(node[r]), b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=schema.names)

    out = materialise(rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(run, schema))
    release(jobs)
    return out


def size_class(options: JoinOptions):
    """A class of n, in an unsharp order: sets of a link are of one class or of two that follow each other."""
    return F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / options.percent) * (1 + 1e-9))).cast("int")


def prefix_groups(nodes: DataFrame, options: JoinOptions) -> DataFrame:
    """token, node, n, pos: the prefix shingles that several nodes hold, with their places in the sets' orders; m, how
    many hold it. Counted before the join, so that a large group can be dealt over many tasks. A node without another of
    its group that has a size to link with is left out: unrelated texts share ever more shingles as a corpus grows."""
    posts = nodes.select("node", "n", size_class(options).alias("near"), F.posexplode("prefix").alias("pos", "token"))
    m = posts.groupBy("token").agg(F.count("*").alias("m"), F.min("near").alias("lo"), F.max("near").alias("hi")).where("m > 2 or m = 2 and hi - lo <= 1").select("token", "m")
    groups = materialise(posts.join(m, "token").select("token", "node", "n", "pos", "m", "near"))
    # Classes as bits, 64 of them in turn: a bit that stands for two classes keeps a row, and never drops one.
    bit = lambda k: F.expr(f"shiftleft(1L, pmod({k}, 64))")
    counted = groups.groupBy("token", "near").agg(F.count("*").alias("c")).groupBy("token").agg(F.bit_or(bit("near")).alias("once"), F.bit_or(F.when(F.col("c") > 1, bit("near")).otherwise(F.lit(0).cast("long"))).alias("again"))
    on = F.col("once").bitwiseAND(bit("near - 1").bitwiseOR(bit("near + 1"))).bitwiseOR(F.col("again").bitwiseAND(bit("near"))) != 0
    out = materialise(groups.join(counted, "token").where(on).select("token", "node", "n", "pos", "m"))
    release(groups)
    return out


def moved(nodes: DataFrame, before: Levels, after: Levels) -> DataFrame:
    """node: those with a shingle in their prefix whose level has changed."""
    import pyarrow as pa

    both = nodes.sparkSession.sparkContext.broadcast((before, after))

    def run(batches):
        old, new = both.value
        for batch in batches:
            heads = batch.column(1)
            h = heads.flatten().to_numpy().view(np.uint64)
            at = np.r_[0, np.cumsum(heads.value_lengths().to_numpy())]
            changed = np.r_[0, np.cumsum(old.of(h) != new.of(h))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(changed[at[1:]] > changed[at[:-1]]))], names=["node"])

    return nodes.select("node", "prefix").mapInArrow(run, T.StructType().add("node", T.LongType()))


def labelled(rows: DataFrame, comps: DataFrame, node: str = "node", name: str = "comp") -> DataFrame:
    """rows with the component of a node: itself where it has none."""
    return rows.join(comps.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def apart(groups: DataFrame, comps: DataFrame | None) -> DataFrame:
    """groups with comp, where a group holds several components."""
    rows = labelled(groups.drop("comp"), comps) if comps is not None else groups.withColumn("comp", F.col("node"))
    several = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return materialise(rows.join(several, "token", "left_semi"))


def left_over(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """pairs (node, hub) of different components."""
    return labelled(labelled(pairs, comps), comps, "hub", "hub_comp").where("comp <> hub_comp").select("node", "hub")


def hub_pairs(groups: DataFrame, nodes: DataFrame, comps: DataFrame | None, turn: int, options: JoinOptions) -> DataFrame:
    """node, hub: for each node the hub of another component that most of its groups name, if it may link. The hub of a group, within a
    class of sizes, is the node of the least salted name; names are random, so the groups of copies agree. Salts
    change with each turn, and the borders of the classes move by half a class."""
    salt = F.lit(int(mix64(np.array([turn + 1], np.uint64)).view(np.int64)[0]))
    near = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / options.percent) + turn % 2 / 2).cast("int").alias("near")
    placed = groups.select("token", near, "node", "comp", F.col("node").bitwiseXOR(salt).alias("name"))
    least = placed.groupBy("token", "near").agg(F.min("name").alias("least"))
    votes = placed.join(least, ["token", "near"]).where("name <> least").groupBy("node", "comp", "least").agg(F.count("*").alias("votes"))
    votes = votes.select("node", "comp", "votes", F.col("least").bitwiseXOR(salt).alias("hub"))
    if comps is not None:
        votes = labelled(votes, comps, "hub", "hub_comp").where("comp <> hub_comp")
    best = votes.groupBy("node").agg(F.max("votes").alias("votes")).join(votes, ["node", "votes"]).groupBy("node").agg(F.min("hub").alias("hub"))
    return materialise(near_pairs(best, nodes, options))


def family_pairs(groups: DataFrame, nodes: DataFrame, options: JoinOptions, pilot: int) -> DataFrame:
    """node, hub: distinct pairs that the signature trees leave, of groups with their components. Groups of the same least
    name are one family, as those of a passage or of copies are, so that their pairs are found once. All nodes of a
    family meet those outside its largest component; or, with ``pilot``, about so many of its nodes."""
    least = groups.groupBy("token").agg(F.min("node").alias("family"))
    family = materialise(groups.join(least, "token").groupBy("family", "node", "n", "comp").agg(F.min("pos").alias("pos")))
    per = family.groupBy("family", "comp").agg(F.count("*").alias("k")).groupBy("family").agg(F.sum("k").alias("m"), F.max(F.struct("k", "comp")).alias("top"))
    blocks = lambda n: F.ceil(n / (options.block * options.send_blocks)).cast("int")
    blocked = family.join(per.select("family", "m", F.col("top.comp").alias("major"), blocks(F.col("m")).alias("blocks"), blocks(F.col("m") - F.col("top.k")).alias("q_blocks")), "family")
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = ["family", "node", "n", "pos", "comp"]
    i, j = block(F.col("blocks")).alias("i"), F.lit(0).alias("j") if pilot else block(F.col("q_blocks")).alias("j")
    some = F.pmod(F.xxhash64(F.lit(1), "node"), F.ceil(F.col("m") / pilot)) == 0 if pilot else F.col("comp") != F.col("major")
    # A row of a family of one block that is of both sides is sent once, as role 2.
    left = blocked.select(*base, F.when(some & (F.col("blocks") == 1), 2).otherwise(0).alias("role"), i, j if pilot else every(F.col("q_blocks")).alias("j"))
    right = blocked.where(some & (F.col("blocks") > 1)).select(*base, F.lit(1).alias("role"), every(F.col("blocks")).alias("i"), j)
    units = left.unionByName(right).join(nodes.select("node", "bits", "parity"), "node")
    found = tree_join(units.select("family", "i", "j", "role", "node", "n", "pos", "comp", "bits", "parity"), options)
    out = materialise(found.distinct().select(F.col("a").alias("hub"), F.col("b").alias("node")))
    release(family)
    return out


def near_duplicates(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for every row of docs (doc_id, text).

    Texts that are null, empty or without words have no shingles and link with nothing. A row without doc_id has no
    component and links with nothing. Rows that repeat a doc_id are judged each by its own text. Extra
    columns are ignored; an empty table gives an empty one.
    """
    return document_classes(docs, options).select("doc_id", "n_shingles", "component_id")


def document_classes(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """near_duplicates with text_id (xxhash64 of the text) and ``first``: whether the row is the one of its component to
    keep, the one of least doc_id, or links with nothing. Rows that repeat it are first as well."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = materialise(shared_shingles(docs, options).where(F.col("c") >= options.frequent_least))
    levels = Levels(options).joined(common)
    sig = materialise(signatures(docs, levels, options))
    release(common)
    able = sig.where("n > 0 and doc_id is not null")
    nodes = materialise(able.groupBy("node", "n").agg(F.min(F.struct("doc_id", "prefix", "bits", "parity")).alias("s")).select("node", "n", F.col("s.doc_id").alias("home"), "s.prefix", "s.bits", "s.parity"))
    slim = materialise(sig.select("doc_id", "n", "node", "text_id"))
    release(sig)
    groups = prefix_groups(nodes, options)
    for _ in range(options.order_rounds):
        large = groups.where(F.col("m") >= 16 * options.frequent_least)
        after = levels.joined(large.select("token", F.col("m").alias("c")).distinct())
        affected = materialise(moved(nodes, levels, after).join(nodes.select("node", "home"), "node"))
        n_affected = affected.count()
        if not n_affected:
            release(affected)
            break
        levels = after
        wanted = affected.select("home").distinct()
        texts = docs.join(F.broadcast(wanted) if n_affected <= BROADCAST_ROWS else wanted, docs["doc_id"] == wanted["home"], "left_semi")
        again = signatures(texts, levels, options, bits=False).select("node", F.col("prefix").alias("ordered")).dropDuplicates(["node"])
        new = materialise(nodes.join(again, "node", "left").withColumn("prefix", F.coalesce("ordered", "prefix")).drop("ordered"))
        release(affected, groups, nodes)
        nodes = new
        groups = prefix_groups(nodes, options)

    comps = None
    current = apart(groups, comps)
    release(groups)
    tidy(spark)
    for i in range(options.hub_rounds):
        pairs = hub_pairs(current, nodes, comps, i, options)
        edges = linked(pairs, nodes, docs, options)
        comps = joined_components(comps, edges)
        groups, current = current, apart(current, comps)
        release(pairs, groups, edges)
        tidy(spark)

    # Signature trees: a few nodes of each family first, then all. Of their pairs one for each node is checked, twice,
    # as what it links makes others needless; in the end all pairs that are still apart.
    for pilot in (options.pilot, 0):
        found = family_pairs(current, nodes, options, pilot)
        for _ in range(2):
            left = left_over(found, comps)
            one = materialise(left.groupBy("node").agg(F.min("hub").alias("hub")))
            if one.isEmpty():  # no pair is left apart
                release(one)
                break
            edges = linked(one, nodes, docs, options)
            comps = joined_components(comps, edges)
            release(edges)
            rest = materialise(left_over(found.join(one, ["node", "hub"], "left_anti"), comps))
            release(found, one)
            found = rest
            tidy(spark)
        if pilot:
            groups, current = current, apart(current, comps)
            release(groups)
        elif not left_over(found, comps).isEmpty():
            edges = linked(found, nodes, docs, options)
            comps = joined_components(comps, edges)
            release(edges)
        release(found)
    release(current)

    # Components are named by sets; their ids are the least documents.
    placed = materialise(labelled(nodes.select("node", "home"), comps))
    release(nodes)
    ids = placed.groupBy("comp").agg(F.min(F.struct("home", "node")).alias("least"))
    whole = slim.join(placed.join(ids, "comp").select("node", F.col("least.home").alias("id"), F.col("least.node").alias("id_node")), "node", "left")
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    first = ~own | ((F.col("node") == F.col("id_node")) & (F.col("doc_id") == F.col("id")))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("id")).otherwise(F.col("doc_id")).alias("component_id"), "text_id", first.alias("first"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
