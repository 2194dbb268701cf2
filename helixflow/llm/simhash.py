"""SimHash near-duplicates by an anchor-point covering.

1. A text's fingerprint holds bit i where over half of the XXH64 values of its word shingles hold it. Equal fingerprints
   are one node.
2. The 64 bits are two halves. Fingerprints that differ in at most t bits differ in at most t // 2 bits of one half, so
   each half has its own anchors: the words of a covering code, a direct sum of perfect codes (Golay, Hamming, single
   bits). Every half-word lies within the covering radius of one anchor, its home.
3. A fingerprint is sent to every anchor within covering radius plus threshold, block by block: to a word of the code
   whose distances exceed the radii of the blocks by t // 2 bits in all. If x and y differ in so few bits of a half, y
   is sent to the home of x, so no link is lost.
4. Per anchor, those at home are compared with those sent there. Anchors are counted before: where nobody is at home
   nothing is sent, and where many meet, homes and visitors are cut into blocks that meet in pairs in tasks of their own.
5. A task gives a spanning forest of the links it finds, not the links; components are found over all forests.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialise, mix64, release, table, texts_as_bytes, tidy
from .graph import components

#: Generator polynomials of perfect codes by length; the word length is also the degree plus the message bits.
GENERATORS = {1: 0b1, 3: 0b111, 7: 0b1011, 15: 0b10011, 23: 0b101011100011}
RADIUS = {1: 0, 3: 1, 7: 1, 15: 1, 23: 3}
#: Codes of a half by the number of different fingerprints up to which they serve. The more anchors, the fewer meet at one,
#: and the more anchors a fingerprint is sent to: 72, 114 and 210, whatever the number of fingerprints.
LADDER = ((1 << 24, (23, 3, 3, 3)), (1 << 27, (23, 7, 1, 1)), (1 << 63, (23, *[1] * 9)))


@dataclass(frozen=True)
class SimHashOptions:
    words: int = 4
    bits: int = 4  # fingerprints that differ in so many bits or fewer link
    blocks: tuple[int, ...] | None = None  # code lengths of a half, 32 in all; None: by LADDER
    meet: int = 1 << 14  # of one side of an anchor, in one task
    pairs: int = 1 << 21  # compared at once

    def sized(self, nodes: int) -> SimHashOptions:
        return self if self.blocks else replace(self, blocks=next(blocks for most, blocks in LADDER if nodes <= most))

    @property
    def message_bits(self) -> int:
        return sum(n - GENERATORS[n].bit_length() + 1 for n in self.blocks)


def fingerprint(text: bytes | None, k: int, piece: int = 1 << 16) -> bytes:
    """Eight bytes, highest bit first. A-Z are lower-cased; words are runs of bytes other than ASCII white space; a
    shingle is k words joined by a space, or all of them where there are fewer. No words: zero."""
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    if len(words) > k:
        start, end = start[: len(words) - k + 1], end[k - 1 :]
    else:
        start, end = start[:1], end[-1:]
    joined = b" ".join(words)
    del words
    ones = np.zeros(64, np.int64)
    for i in range(0, len(start), piece):
        hashes = b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(start[i : i + piece].tolist(), end[i : i + piece].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(start)).tobytes()


def fingerprints(docs: DataFrame, options: SimHashOptions) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = b"".join(fingerprint(t, options.words) for part in range(0, batch.num_rows, 64) for t in texts_as_bytes(batch.column(1).slice(part, 64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType().add("doc_id", T.LongType()).add("fp", T.LongType())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class PerfectCode:
    """The words of a cyclic perfect code as anchors: which of them lie how far beyond the radius of a given word."""

    def __init__(self, n: int, most: int):
        self.n, self.g = n, GENERATORS[n]
        self.degree = self.g.bit_length() - 1
        message = np.arange(1 << (n - self.degree), dtype=np.int64)
        code = np.zeros_like(message)
        for i in range(n - self.degree):
            code ^= np.where(message >> i & 1, self.g << i, 0)
        leader = np.zeros(1, np.int64)
        ones = np.int64(1) << np.arange(n, dtype=np.int64)
        for _ in range(RADIUS[n]):
            leader = np.unique(np.r_[leader, (leader[:, None] ^ ones).ravel()])
        leader = leader[np.bitwise_count(leader) <= RADIUS[n]]
        leader = leader[np.argsort(self.syndrome(leader))]
        flips = leader[:, None] ^ code  # from a word with this syndrome to each word of the code
        excess = np.maximum(np.bitwise_count(flips).astype(np.int64) - RADIUS[n], 0)
        order = np.argsort(excess, axis=1, kind="stable")
        self.size = np.stack([(excess <= b).sum(axis=1) for b in range(most + 1)], axis=1)
        kept = np.arange(len(code)) < self.size[:, -1:]
        self.start = np.r_[0, np.cumsum(self.size[:, -1])]
        self.flips = np.take_along_axis(flips, order, axis=1)[kept]
        self.excess = np.take_along_axis(excess, order, axis=1)[kept]

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        word = word.copy()
        for i in range(self.n - 1, self.degree - 1, -1):
            word ^= np.where(word >> i & 1, self.g << (i - self.degree), 0)
        return word


@cache
def codes(blocks: tuple[int, ...], most: int) -> tuple[PerfectCode, ...]:
    if sum(blocks) != 32:
        raise ValueError(f"the blocks of a half have 32 bits in all, not {sum(blocks)}")
    made = {n: PerfectCode(n, most) for n in set(blocks)}
    return tuple(made[n] for n in blocks)


def visits(fp: np.ndarray, options: SimHashOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of fp, anchor, at home) for each anchor that a fingerprint is sent to."""
    most, out = options.bits // 2, []
    for half in (0, 1):
        row = np.arange(len(fp))
        word = (fp.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        anchor = np.full(len(fp), half, np.int64)
        left = np.full(len(fp), most, np.int64)
        for code in codes(options.blocks, most):
            part = word & (1 << code.n) - 1
            s = code.syndrome(part)
            size = code.size[s, left]
            into = np.repeat(np.arange(len(row)), size)
            at = np.arange(len(into)) - np.repeat(np.cumsum(size) - size, size) + code.start[s][into]
            # The highest bits of a cyclic code's word tell its message.
            anchor = anchor[into] << code.n - code.degree | (part[into] ^ code.flips[at]) >> code.degree
            row, word, left = row[into], word[into] >> code.n, left[into] - code.excess[at]
        out.append((row, anchor, left == most))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchor_counts(nodes: DataFrame, options: SimHashOptions) -> tuple[np.ndarray, np.ndarray]:
    """How many are at home at each anchor, and how many are sent there. Sums of tasks, of as many rows as anchors at
    most: 2 ** (message bits + 1), which does not grow with the data."""
    import pyarrow as pa

    size = 2 << options.message_bits

    def run(batches):
        home, sent = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                _, anchor, at_home = visits(batch.column(0).slice(i, 8192).to_numpy(), options)
                home += np.bincount(anchor[at_home], minlength=size)
                sent += np.bincount(anchor, minlength=size)
        on = np.flatnonzero(sent)
        for i in range(0, len(on), 65_536):
            k = on[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(home[k]), pa.array(sent[k])], names=["anchor", "home", "sent"])

    found = nodes.select("fp").mapInArrow(run, "anchor long, home long, sent long").groupBy("anchor").agg(F.sum("home").alias("home"), F.sum("sent").alias("sent")).where("home > 0 and sent > 1").toArrow()
    home, sent = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = found.column("anchor").to_numpy()
    home[at], sent[at] = found.column("home").to_numpy(), found.column("sent").to_numpy()
    return home, sent


def meetings(nodes: DataFrame, options: SimHashOptions) -> DataFrame:
    """anchor, i, j (the block of homes and of those sent there), visitor (false for one at home), fp."""
    import pyarrow as pa

    home, sent = anchor_counts(nodes, options)
    cut = lambda n: -(-n // options.meet)
    shared = nodes.sparkSession.sparkContext.broadcast((cut(home).astype(np.int32), cut(sent).astype(np.int32)))

    def run(batches):
        homes, sents = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                fp = batch.column(0).slice(k, 2048).to_numpy()
                row, anchor, at_home = visits(fp, options)
                on = homes[anchor] > 0
                row, anchor, at_home = row[on], anchor[on], at_home[on]
                for visitor in (False, True):
                    r, a = (row, anchor) if visitor else (row[at_home], anchor[at_home])
                    own, other = (sents, homes) if visitor else (homes, sents)
                    size = other[a]
                    mine = (mix64(fp[r].view(np.uint64)) % own[a].astype(np.uint64)).astype(np.int32)
                    into = np.repeat(np.arange(len(r)), size)
                    each = (np.arange(len(into)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
                    i, j = (each, mine[into]) if visitor else (mine[into], each)
                    yield pa.RecordBatch.from_arrays([pa.array(a[into]), pa.array(i), pa.array(j), pa.array(np.full(len(into), visitor)), pa.array(fp[r][into])], names=["anchor", "i", "j", "visitor", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor long, i int, j int, visitor boolean, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) with the components of links (a, b)."""
    name, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(name))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        new = new[new]
        if (new == low).all():
            break
        low = new
    on = low != np.arange(len(name))
    return name[on], name[low[on]]


def links(met: DataFrame, options: SimHashOptions) -> DataFrame:
    """a, b: links whose components are those of all pairs that met and differ in few bits."""
    import pyarrow as pa

    def starts(rows):
        keys = [rows.column(k).to_numpy() for k in ("anchor", "i", "j")]
        return np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)]

    def compared(rows, new):
        """The pairs that link among whole groups of rows; homes come first in a group."""
        fp, visitor = rows.column("fp").to_numpy(), rows.column("visitor").to_numpy(zero_copy_only=False)
        edge = np.r_[np.flatnonzero(new), len(new)]
        size = np.diff(edge)
        homes = np.add.reduceat(~visitor, edge[:-1], dtype=np.int64)
        first, many = np.repeat(edge[:-1] + homes, size)[~visitor], np.repeat(size - homes, size)[~visitor]
        x = fp[~visitor]
        x, first, many = x[many > 0], first[many > 0], many[many > 0]
        work = np.cumsum(many)
        at = 0
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + options.pairs, side="right")))
            n = many[at:stop]
            left = np.repeat(x[at:stop], n)
            right = fp[np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n)]
            on = (left < right) & (np.bitwise_count(left ^ right) <= options.bits)
            yield left[on], right[on]
            at = stop

    def run(batches):
        held, found, size = None, [], 0

        def settle(pairs):
            nonlocal found, size
            for a, b in pairs:
                if len(a):
                    found.append(forest(a, b))
                    size += len(found[-1][0])
                if size > 1_000_000 and len(found) > 1:
                    found = [forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                    size = len(found[0][0]) // 2  # a large forest is not made anew at each step

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < 32_768:
                continue
            new = starts(held)
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            if last:
                settle(compared(held.slice(0, last), new[:last]))
                held = held.slice(last)
        if held is not None:
            settle(compared(held, starts(held)))
        if found:
            a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            for i in range(0, len(a), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 65_536]), pa.array(b[i : i + 65_536])], names=["a", "b"])

    by = ["anchor", "i", "j"]
    return met.repartition(*by).sortWithinPartitions(*by, "visitor").mapInArrow(run, "a long, b long")


def simhash_classes(docs: DataFrame, options: SimHashOptions = SimHashOptions()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text).

    A null text, or one without words, has fingerprint zero and links like any other. A row without doc_id gets its
    fingerprint, but no component, and links nothing. Rows that repeat a doc_id are judged each by its own text. Extra
    columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = materialise(fingerprints(docs, options))
    nodes = materialise(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("home")))
    options = options.sized(nodes.count())
    edges = materialise(links(meetings(nodes, options), options))
    comps = components(edges)
    release(edges)
    tidy(spark)
    placed = nodes.join(comps.select(F.col("node").alias("fp"), "comp"), "fp", "left").select("fp", "home", F.coalesce("comp", "fp").alias("comp"))
    placed = materialise(placed)
    ids = placed.groupBy("comp").agg(F.min("home").alias("id"))
    named = materialise(placed.join(ids, "comp").select("fp", "id"))
    release(nodes, comps, placed)
    whole = marked.join(named, "fp", "left")
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("component_id"))


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
