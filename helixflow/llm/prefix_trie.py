"""The prefix trie of conversations by splitters and their skeleton.

1. A conversation is a path: the 16-byte hashes of its turns, one after another. Paths sort as bytes, so a node's members,
   the conversations that start with its path, stand together.
2. Splitters, taken from a sample of the paths (it only balances), cut the order into shards. The skeleton, broadcast to
   all tasks, is the trie of the splitters' paths. A node whose members lie on both sides of a splitter is a prefix of it; so all
   other nodes lie within one shard.
3. Each shard is sorted and read once, with a stack for the current path: nodes off the skeleton are finished there,
   skeleton nodes give partial aggregates, and the ids that end at them, in order, as segments of text.
4. Partial aggregates are summed, and the skeleton is rolled up from its leaves: it has a path for each splitter at
   most, however many conversations there are. Its ids name the parents of the nodes right below it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, crc_bucket, materialise, release, table

#: Bytes of the hash of a turn.
KEY = 16
#: Conversations of the sample for each shard.
SAMPLE = 32
#: Ids of a segment.
SEGMENT = 4096
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_WALKED = "kind int, skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
FINISHED, PARTIAL, ENDS = 0, 1, 2


def ordered_turns(turns: DataFrame) -> DataFrame:
    """base (conv_id less its remainder by 5), conv_id, turns: array of turn, key (hash of role and text), size (bytes of
    the text), by turn, null first; equal turns by key."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where("conv_id is not null").select((F.col("conv_id") - F.col("conv_id") % 5).alias("base"), "conv_id", F.struct("turn", key.alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def packed(turns: str) -> list:
    """path and sizes of a column of turns."""
    return [F.expr(f"unhex(array_join(transform({turns}, x -> hex(x.key)), ''))").alias("path"), F.expr(f"transform({turns}, x -> x.size)").alias("sizes")]


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """conv_id, path, sizes of conversations rebuilt: the first h turns of conversation c - c % 5 (none if there is no
    such), then the own turns of c after its first h, where h = crc32 of c's decimal text modulo 9. The remainder has the sign of c."""
    convs = ordered_turns(turns).withColumn("h", crc_bucket(F.col("conv_id"), 9).cast("int"))
    # At most five conversations have a base in common, so its first turns need no join.
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8)), ignorenulls=True).over(Window.partitionBy("base"))
    whole = convs.withColumn("head", head).withColumn("turns", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(turns, 1, 0)")), F.slice("turns", F.col("h") + 1, F.size("turns"))))
    return whole.select("conv_id", *packed("turns"))


class Skeleton:
    """The trie of the splitters' paths. Node 0 is the root; a child has a higher number than its parent."""

    def __init__(self, splitters: list[tuple[bytes, int]], sizes: list[list[int]]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.size = [-1], [0], [0]
        for (path, _), size in zip(splitters, sizes, strict=True):
            at = 0
            for d in range(len(path) // KEY):
                key = (at, path[KEY * d : KEY * d + KEY])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at), self.depth.append(d + 1), self.size.append(size[d])
                at = self.child[key]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


class Node:
    """A node on the current path of a shard."""

    __slots__ = ("skeleton", "size", "conv_id", "ends", "convs", "children", "leaves", "saved", "held")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.size = skeleton, size  # skeleton: its number there, -1 for others
        self.conv_id = None
        self.ends = [] if skeleton >= 0 else None
        self.convs = self.children = self.leaves = self.saved = 0
        self.held = []  # children that wait for the least member

    def take(self, conv_id: int, convs: int):
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.convs += convs


_EMPTY = hashlib.sha256().digest()


def walk(rows, skeleton: Skeleton):
    """Rows of _WALKED for one shard's (conv_id, path, sizes), sorted by path, then conv_id."""
    stack: list[Node] = [Node(0, 0)]
    before = b""

    def segment(node):
        row = (ENDS, node.skeleton, node.ends[0], None, None, None, None, None, None, ",".join(map(str, node.ends)).encode())
        node.ends.clear()
        return row

    def pop():
        node, depth = stack.pop(), len(stack)
        if node.skeleton >= 0:
            if node.ends:
                yield segment(node)
            yield (PARTIAL, node.skeleton, node.conv_id, depth, None, node.convs, node.children, node.leaves, node.saved, None)
            return
        for child in node.held:
            yield (*child[:4], node.conv_id, *child[5:])
        leaves, saved = node.leaves or 1, node.saved + (node.convs - 1) * node.size
        above = stack[-1]
        row = (FINISHED, above.skeleton, node.conv_id, depth, None, node.convs, node.children, leaves, saved, node.ends.digest() if node.ends else _EMPTY)
        above.take(node.conv_id, node.convs)
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.skeleton >= 0:
            yield row
        else:
            above.held.append(row)

    for conv_id, path, sizes in rows:
        same, most = 0, min(len(before), len(path))
        while same < most and before[same : same + KEY] == path[same : same + KEY]:
            same += KEY
        same //= KEY
        while len(stack) - 1 > same:
            yield from pop()
        for d in range(same, len(path) // KEY):
            above = stack[-1].skeleton
            number = skeleton.child.get((above, path[KEY * d : KEY * d + KEY]), -1) if above >= 0 else -1
            stack.append(Node(number, sizes[d]))
        node = stack[-1]
        node.take(conv_id, 1)
        if node.skeleton >= 0:
            node.ends.append(conv_id)
            if len(node.ends) >= SEGMENT:
                yield segment(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(b"%d" % conv_id)
        else:
            node.ends.update(b",%d" % conv_id)
        before = path
    while stack:
        yield from pop()


def choose_splitters(paths: DataFrame, shards: int) -> Skeleton:
    """Splitters for so many shards. SAMPLE * shards conversations reach the driver, about, chosen by a hash of their ids."""
    n = paths.count()
    some = paths
    if n > SAMPLE * shards:
        some = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)) < max(1, (SAMPLE * shards << 20) // n))
    found = sorted((bytes(r.path), r.conv_id, r.sizes) for r in some.collect())
    cut = sorted({len(found) * k // shards for k in range(1, shards)} - {0})
    return Skeleton([found[k][:2] for k in cut], [found[k][2] for k in cut])


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """A row of NODES for each node of the trie of paths (conv_id, path, sizes).

    conv_id must be unique and not null; path is a binary of KEY bytes a turn, sizes an array of as many longs. Nodes are
    the distinct prefixes of paths, from the root (depth 0, no parent) on; members of a node start with its path. conv_id and
    parent_conv_id are the least members of the node and its parent, n_leaves counts childless nodes below, itself included,
    saved_tokens sums (n_convs - 1) * size of its last turn over its subtree, and ends_sha256 is the SHA-256 of the ids of those
    that end at the node, ascending, joined by commas. An empty table gives an empty one; equal paths are members of one node.
    """
    import pyarrow as pa

    spark = paths.sparkSession
    bounded_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = materialise(paths.select(F.col("conv_id").cast("long").alias("conv_id"), "path", "sizes"))
    skeleton = choose_splitters(paths, shards)
    shared = spark.sparkContext.broadcast(skeleton)  # a path for each splitter

    def dealt(batches):
        for batch in batches:
            at = [shared.value.shard(p, c) for p, c in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["conv_id", "path", "sizes", "shard"])

    types = [pa.int32(), *[pa.int64()] * 8, pa.binary()]
    names = [x.split(" ")[0] for x in _WALKED.split(", ")]

    def walked(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        first = next(rows, None)
        if first is None:
            return
        for row in walk((r for part in ((first,), rows) for r in part), shared.value):
            out.append(row)
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    by_shard = paths.mapInArrow(dealt, "conv_id long, path binary, sizes array<long>, shard int")
    # One shard a task: nodes of a shard are finished by the task that reads it.
    by_shard = by_shard.repartitionById(shards, "shard").sortWithinPartitions("path", "conv_id").select("conv_id", "path", "sizes")
    found = materialise(by_shard.mapInArrow(walked, _WALKED))
    release(paths)
    top = rolled_up(found, skeleton)
    below = found.where(F.col("kind") == FINISHED).join(F.broadcast(top.select("skeleton", F.col("conv_id").alias("above"))), "skeleton", "left")
    below = below.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256"))
    return below.unionByName(top.drop("skeleton"))


def end_digests(found: DataFrame) -> dict[int, str]:
    """SHA-256 of the ends of skeleton nodes. A digest is sequential: one task reads a node's segments, of SEGMENT ids
    each, as a stream."""
    import pyarrow as pa

    def run(batches):
        at, digest, out = None, None, []
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != at:
                    if digest:
                        out.append((at, digest.hexdigest()))
                    at, digest = number, hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
        if digest:
            out.append((at, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["skeleton", "digest"])

    segments = found.where(F.col("kind") == ENDS).select("skeleton", "ends", "conv_id")
    rows = segments.repartition("skeleton").sortWithinPartitions("skeleton", "conv_id").select("skeleton", "ends")
    return {r.skeleton: r.digest for r in rows.mapInArrow(run, "skeleton long, digest string").collect()}


def rolled_up(found: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes: skeleton (number) and the columns of NODES."""
    sums = found.where(F.col("kind") == PARTIAL).groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    parts = {r.skeleton: [r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens] for r in sums.collect()}
    digests = end_digests(found)
    empty = hashlib.sha256().hexdigest()
    for v in range(len(skeleton.parent) - 1, -1, -1) if parts else ():
        own = parts[v]
        own[3] = own[3] or 1
        own[4] += (own[1] - 1) * skeleton.size[v]
        if v:
            above = parts[skeleton.parent[v]]
            above[0] = own[0] if above[0] is None else min(above[0], own[0])
            above[1] += own[1]
            above[2] += 1
            above[3] += own[3]
            above[4] += own[4]
    rows = [(v, own[0], skeleton.depth[v], parts[skeleton.parent[v]][0] if v else None, *own[1:], digests.get(v, empty)) for v, own in sorted(parts.items())]
    return found.sparkSession.createDataFrame(rows, f"skeleton long, {NODES}")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_paths(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP11_SQL = r"""
with keyed as (
  select conv_id, turn, strlen(coalesce(text, '')) as size, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as key
  from conversations where conv_id is not null
), own as (
  select conv_id, list(key order by turn nulls first, key) as keys, list(size order by turn nulls first, key) as sizes from keyed group by 1
), chosen as (
  select *, conv_id - conv_id % 5 as base,
    xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, o: case when o >= 0 then xor(c, o) when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end), 4294967295::bigint) % 9 as h
  from own
), whole as (
  select c.conv_id, coalesce(b.keys[1:c.h], []) || c.keys[c.h + 1:] as keys, coalesce(b.sizes[1:c.h], []) || c.sizes[c.h + 1:] as sizes
  from chosen c left join own b on b.conv_id = c.base
), prefixes as (
  select conv_id, d, len(keys) as n, array_to_string(keys[1:d], '') as path, case when d > 0 then sizes[d] else 0 end as size
  from whole, unnest(range(0, len(keys) + 1)) as u(d)
), nodes as (
  select d, path, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(size) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256
  from prefixes group by 1, 2
), sized as (
  select p.*, up.conv_id as parent_conv_id, (select count(*) from nodes c where c.d = p.d + 1 and left(c.path, 32 * p.d) = p.path) as n_children
  from nodes p left join nodes up on up.d = p.d - 1 and up.path = left(p.path, 32 * (p.d - 1))
), below as (
  select x as d, left(path, 32 * x) as path, sum(saved)::bigint as saved_tokens, sum(case when n_children = 0 then 1 else 0 end)::bigint as n_leaves
  from sized, unnest(range(0, d + 1)) as u(x) group by 1, 2
)
select s.conv_id, s.d::bigint as depth, s.parent_conv_id, s.n_convs, s.n_children, b.n_leaves, b.saved_tokens, s.ends_sha256
from sized s join below b on b.d = s.d and b.path = s.path
"""
