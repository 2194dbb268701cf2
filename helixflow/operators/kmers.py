"""K-mer counts and minimizers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dna import unpack
from .windows import blocks, bounded, known, packed, pieces, scan

#: K-mers that a task sums at once.
SUMMED = 4_000_000


def packed_counts(seqs: DataFrame, k: int, ids: list[str]) -> DataFrame:
    """packed (canonical, two bits a base), count. Tasks sum their k-mers before the shuffle, so a very common one is no hot
    key; the packed order is the order of the strings."""
    import pyarrow as pa

    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")

    def summed(parts):
        value, count = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["packed", "count"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, piece in pieces(batch, 0):
                fore, back = packed(piece.bases, k)
                on = piece.owns(k) & known(piece.bases, k)
                parts.append(np.minimum(fore[on], back[on]))
                size += len(parts[-1])
                if size >= SUMMED:
                    yield summed(parts)
                    parts, size = [], 0
        if size:
            yield summed(parts)

    schema = T.StructType().add("packed", T.LongType()).add("count", T.LongType())
    return bounded(blocks(seqs, k - 1, [])).mapInArrow(run, schema).groupBy("packed").agg(F.sum("count").alias("count"))


def held_kmers(seqs: DataFrame, wanted: list[int], k: int) -> DataFrame:
    """packed: those of ``wanted`` (packed canonical k-mers, a bounded list) that some sequence holds. Only hits leave a task."""
    import pyarrow as pa

    codes = seqs.sparkSession.sparkContext.broadcast(np.unique(np.array(wanted, np.uint64)))

    def run(batches):
        for batch in batches:
            for _, piece in pieces(batch, 0):
                fore, back = packed(piece.bases, k)
                own = np.minimum(fore, back)[piece.owns(k) & known(piece.bases, k)]
                found = np.intersect1d(own.astype(np.uint64), codes.value)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["packed"])

    return bounded(blocks(seqs, k - 1, [])).mapInArrow(run, T.StructType().add("packed", T.LongType())).distinct()


def count_kmers(seqs: DataFrame, k: int, ids: list[str]) -> DataFrame:
    """kmer (canonical), count."""
    return packed_counts(seqs, k, ids).select(unpack(F.col("packed"), k).alias("kmer"), "count")


def top_kmers(counts: DataFrame, least: int = 1, top: int | None = 1000, kmer: str = "kmer") -> DataFrame:
    """Counts of ``least`` or more, by count downwards, then k-mer (or packed k-mer); the first ``top`` (all if None)."""
    rows = counts.where(F.col("count") >= least)
    return rows.orderBy(F.desc("count"), kmer).limit(top) if top else rows


def minimizers(seqs: DataFrame, k: int, w: int, ids: list[str]) -> DataFrame:
    """ids, pos, kmer: in each run of w consecutive valid k-mers the least canonical one, the oldest of equals.

    A run ends at any other base than A, C, G or T. The windows that take one minimizer follow each other, so it is
    reported by the first of them: sequences get one letter in front, and each block looks at pairs of windows, of which
    it owns the first.
    """
    front = seqs.select(*ids, F.concat(F.lit(" "), "seq").alias("seq"))
    width = k + w  # a pair of windows of w k-mers

    def kernel(piece):
        n = len(piece.bases)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        fore, back = packed(piece.bases, k)
        value = np.minimum(fore, back)
        least, place = value.copy(), np.arange(len(value))
        size = 1
        while size < w:  # minima of windows of k-mers, by doubling
            step = min(size, w - size)
            count = len(least) - step
            later = least[step:] < least[:count]
            least, place = np.where(later, least[step:], least[:count]), np.where(later, place[step:], place[:count])
            size += step
        ok = known(piece.bases, k + w - 1)
        on = piece.owns(width) & ok[1:] & ~(ok[:-1] & (place[:-1] == place[1:]))
        where = np.flatnonzero(on)
        found = place[where + 1]
        block = piece.block(where)
        return where, piece.start[block] + found - piece.at[block] - 1, value[found].view(np.int64)

    rows = scan(front, ids, width, kernel, "pos long, packed long")
    return rows.select(*ids, "pos", unpack(F.col("packed"), k).alias("kmer"))
