"""Runs of periodic words, found by an enhanced suffix array.

1. The suffixes of a text's words are sorted by prefix doubling, many texts side by side; only suffixes that share their
   first ``least_root`` words with another go on. The LCP table follows: a suffix whose left neighbour continues the one
   before it has one less, all others are compared word by word.
2. A scan of the LCP table gives its intervals and their children as ranges of the suffix array, without tree nodes. For
   each interval of depth d, each suffix i of all children but the largest asks by the inverse suffix array whether i + d
   or i - d lies in the interval, in another child: then a square of roots of d words starts at i or i - d, and the word after
   it breaks the period (a branching tandem repeat).
3. All squares of one run whose root is repeated end at the same word. Of those that end there the shortest is rotated to the
   left as far as the period holds, which gives the run; longer squares that it explains are merged into it.

A run of 12 words or more has a square of roots of 4 words or more, perhaps of a multiple of its period, so shallower
intervals are not needed; the period is then the root's own smallest period.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table, texts_as_bytes


@dataclass(frozen=True)
class RunOptions:
    least: int = 12  # words of a run, 2 at least; a run has two periods at least
    batch_words: int = 1 << 18  # of texts whose suffixes are sorted side by side; a longer text is alone
    expand: int = 1 << 20  # suffixes that ask at once

    @property
    def least_root(self) -> int:
        """The most words that the root of some square of every run is sure to have."""
        return min(q * (self.least // (2 * q)) for q in range(1, self.least // 2 + 1))


def matched(words: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words are equal from a[k] and b[k] on, to the right (step 1) or left (step -1). Words end in marks that
    occur once, on both sides, so each comparison ends."""
    if len(a) > 1 << 15:  # bounds the copies of words
        return np.concatenate([matched(words, a[i : i + (1 << 15)], b[i : i + (1 << 15)], step) for i in range(0, len(a), 1 << 15)])
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    done = 0
    last = len(words) - 1
    while len(left):
        width = min(max(16, (1 << 18) // len(left)), 1 << 14)
        width = min(width, max(16, done))
        off = step * (done + np.arange(width))
        same = words[np.clip(a[left, None] + off, 0, last)] == words[np.clip(b[left, None] + off, 0, last)]
        whole = same.all(axis=1)
        out[left] = done + np.where(whole, width, same.argmin(axis=1))
        left = left[whole]
        done += width
    return out


def sorted_suffixes(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, LCP with the one before): all suffixes that share their first ``least`` words with another, in the
    order of their words; LCP is 0 where they share fewer. Each end of a text is a mark that occurs once."""
    n = len(words)
    count = np.bincount(words)
    rank = (np.cumsum(count) - count)[words]
    active = np.flatnonzero(count[words] > 1)
    length, kept = 1, None
    while True:
        if kept is None and (length == least or not len(active)):
            kept = active
        if not len(active):
            break
        step = length if kept is not None else min(length, least - length)
        key = rank[active] << 32 | rank[active + step]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        group = key >> 32
        first = np.r_[True, group[1:] != group[:-1]]
        start = np.flatnonzero(first)
        slot = group + np.arange(len(active)) - np.repeat(start, np.diff(np.r_[start, len(active)]))
        new = np.r_[True, key[1:] != key[:-1]]
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(active)])
        rank[active] = np.repeat(slot[at], size)
        active = active[np.repeat(size > 1, size)]
        length += step
    suffix = kept[np.argsort(rank[kept], kind="stable")]
    lcp = np.zeros(len(suffix), np.int64)
    if not len(suffix):
        return suffix, lcp
    before = np.r_[-1, suffix[:-1]]
    near = np.zeros(len(suffix), bool)
    near[1:] = (words[suffix[1:, None] + np.arange(least)] == words[suffix[:-1, None] + np.arange(least)]).all(axis=1)
    by_text = np.argsort(suffix)  # in the order of the text
    text, left, on = suffix[by_text], before[by_text], near[by_text]
    goes_on = on & (words[text - 1] == words[np.where(on, left, 1) - 1])
    found = np.zeros(len(text), np.int64)
    alone = np.flatnonzero(on & ~goes_on)
    found[alone] = matched(words, text[alone], left[alone], 1)
    origin = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(text))))
    found = np.where(goes_on, found[origin] - (text - text[origin]), found)
    lcp[by_text] = found
    return suffix, lcp


def interval_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(interval, start, end) of each child and (depth, start, end) of each interval of the LCP table, ends exclusive."""
    parent, start, end = [], [], []
    depth, low, high = [], [], []
    stack = []  # (depth, interval, the start of its last child)
    values = lcp.tolist()
    values.append(0)
    for k, value in enumerate(values):
        begin = k - 1  # of the child that ends at k
        while stack and stack[-1][0] > value:
            _, v, last = stack.pop()
            parent.append(v), start.append(last), end.append(k)
            high[v] = k
            begin = low[v]
        if value:
            if stack and stack[-1][0] == value:
                _, v, last = stack.pop()
                begin = last
            else:
                v = len(depth)
                depth.append(value), low.append(begin), high.append(0)
            parent.append(v), start.append(begin), end.append(k)
            stack.append((value, v, k))
    return tuple(np.array(x, np.int64) for x in (parent, start, end, depth, low, high))


def branching_squares(words: np.ndarray, options: RunOptions) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of the squares that the word after them breaks, repeats left out."""
    suffix, lcp = sorted_suffixes(words, options.least_root)
    parent, start, end, depth, low, high = interval_children(lcp)
    rank = np.full(len(words), -1, np.int64)
    rank[suffix] = np.arange(len(suffix))
    size = end - start
    order = np.lexsort((-size, parent))
    small = order[~np.r_[True, parent[order][1:] != parent[order][:-1]]] if len(order) else order
    found = [np.zeros((2, 0), np.int64)]
    work = np.cumsum(size[small])
    at = 0
    while at < len(small):
        stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + options.expand, side="right")))
        k = small[at:stop]
        n = size[k]
        k = np.repeat(k, n)
        i = suffix[np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + start[k]]
        d, v = depth[parent[k]], parent[k]
        for other, first in ((i + d, i), (i - d, i - d)):
            r = np.where((other >= 0) & (other < len(words)), rank[np.clip(other, 0, len(words) - 1)], -1)
            on = (r >= low[v]) & (r < high[v]) & ((r < start[k]) | (r >= end[k]))
            found.append(np.stack([first[on], d[on]]))
        at = stop
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def runs(words: np.ndarray, options: RunOptions = RunOptions()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs. words: numbers from 0 on, the words of some texts, with a mark that occurs nowhere
    else before the first and after each text."""
    start, root = branching_squares(words, options)
    end = start + 2 * root
    order = np.lexsort((root, end))
    end, root = end[order], root[order]
    found = []
    while len(end):
        first = np.r_[True, end[1:] != end[:-1]]
        e, d = end[first], root[first]
        s = e - d - matched(words, e - 1, e - 1 - d, -1)
        q = d.copy()
        for short in range(options.least_root - 1, 0, -1):  # a root that repeats a shorter one
            k = np.flatnonzero((d % short == 0) & (d < 2 * options.least_root))
            k = k[matched(words, e[k] - 1, e[k] - 1 - short, -1) >= 2 * d[k] - short]
            q[k] = short
        found.append((s, e, q))
        of = np.cumsum(first) - 1
        left = ~first & ~((root % q[of] == 0) & (end - 2 * root >= s[of]))
        end, root = end[left], root[left]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = (np.concatenate(x) for x in zip(*found, strict=True))
    on = e - s >= np.maximum(options.least, 2 * q)
    order = np.lexsort((q[on], s[on]))
    return s[on][order], e[on][order], q[on][order]


def text_runs(texts: list[list[bytes]], options: RunOptions = RunOptions()):
    """(start, length, period) arrays of each text, given as its words; by start, then period."""
    names: dict = {}
    parts, at, offset = [np.zeros(1, np.int64)], [], 1
    fresh = 1
    for words in texts:
        names.clear()
        part = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)) + fresh
        fresh += len(names)
        parts += [part, np.array([fresh])]
        fresh += 1
        at.append(offset)
        offset += len(part) + 1
    s, e, q = runs(np.concatenate(parts), options)
    low = np.array(at)
    cut = np.r_[np.searchsorted(s, low), len(s)]
    for k in range(len(texts)):
        one = slice(cut[k], cut[k + 1])
        yield s[one] - low[k], e[one] - s[one], q[one]


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space; null has none."""
    return (text or b"").split()


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(start):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, prepare=None, options: RunOptions = RunOptions()) -> DataFrame:
    """doc_id, runs (array of start, length, period by start, then period; word numbers from 0), text (words joined by one
    space, without those that a run holds after its first period) for every row of docs (doc_id, text).

    A run is a stretch of max(least, two periods) words or more with a smallest period that no neighbouring word extends. A null
    text, or one without words, has no runs and an empty text. Repeated rows and rows without doc_id are kept as they are; extra columns
    are ignored; an empty table gives an empty one. prepare(doc_id, words) may change the words of a text before.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    run_type = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("runs", T.ArrayType(run_type, False)).add("text", T.BinaryType())

    def answer(ids, texts):
        found, rows = list(text_runs(texts, options)), []
        for words, one in zip(texts, found, strict=True):
            rows.append(b" ".join(collapsed(words, *one)))
        columns = [np.concatenate([one[k] for one in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        offsets = np.r_[0, np.cumsum([len(one[0]) for one in found])].astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(rows, pa.binary())], names=schema.names)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            texts, size, first = [], 0, 0
            for k in range(batch.num_rows):
                words = split_words(texts_as_bytes(batch.column(1).slice(k, 1))[0])
                if prepare:
                    words = prepare(ids[k].as_py(), words)
                if texts and size + len(words) > options.batch_words:
                    yield answer(ids.slice(first, len(texts)), texts)
                    texts, size, first = [], 0, k
                texts.append(words)
                size += len(words)
            if texts:
                yield answer(ids.slice(first, len(texts)), texts)

    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("text", F.col("text").cast("string"))


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rewriting of the query: with h = crc32 of the id's decimal text, g = h // 10 and n words, where h % 10 is 0 word i from
    a = g % n on becomes word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8). Others, and rows without id, stay as they are."""
    import zlib

    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + [cycle[i % p] for i in range(n - a)]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The digests of each document's runs and of what is left of its words."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), repeated)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("left"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.left")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.expr("(1000 * best.length) div -best.short").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
