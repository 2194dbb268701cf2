"""Sequences as blocks, and scans of blocks for windows. Long sequences are cut into blocks that overlap on the right;
each window belongs to the block that holds its start. A scan turns the blocks of a batch into one array of bytes and gives
rows only where its kernel finds something, so cost is linear in the bases, and no row stands for a base."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Window starts that a block owns.
BLOCK = 1 << 16
#: Bases that a kernel sees at once, unless one block holds more, and rows of a batch of blocks.
PIECE, BATCH_ROWS = 1 << 20, 1000
CODE = np.full(256, 4, np.uint8)
CODE[list(b"ACGT")] = range(4)
COMPLEMENT = np.arange(256, dtype=np.uint8)
COMPLEMENT[list(b"ACGTN")] = list(b"TGCAN")


def blocks(seqs: DataFrame, overlap: int, ids: list[str], seq: str = "seq", own: int | None = None) -> DataFrame:
    """ids, start (0-based), owned (window starts that the block owns), bases (bytes, own + overlap at most), total.

    Blocks are cut from bytes, which takes the same time anywhere in a sequence; so sequences hold ASCII alone."""
    own = own or BLOCK
    n = F.length("_bytes")
    rows = seqs.select(*ids, F.col(seq).cast("binary").alias("_bytes"))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(own)))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(F.col("_bytes"), s + 1, F.lit(own + overlap)).alias("bases")))
    rows = rows.select(*ids, n.alias("total"), F.explode(cut).alias("b"))
    return rows.select(*ids, "b.start", F.least(F.lit(own), F.col("total") - F.col("b.start")).alias("owned"), "b.bases", "total")


@dataclass
class Piece:
    """Some blocks side by side: bases, and for each block its offset (at), start, owned starts and length of its sequence."""

    bases: np.ndarray
    at: np.ndarray
    start: np.ndarray
    owned: np.ndarray
    total: np.ndarray

    def block(self, where: np.ndarray) -> np.ndarray:
        """The blocks of places in ``bases``, which are in order or not."""
        return np.searchsorted(self.at, where, side="right") - 1

    def owns(self, width: int) -> np.ndarray:
        """Of each place but the last width - 1: whether a window of this width starts and ends in its block, owned by it."""
        size = np.diff(self.at)
        count = np.clip(np.minimum(self.owned, size - width + 1), 0, None)
        edge = np.zeros(len(self.bases) + 1, np.int32)
        some = count > 0
        edge[self.at[:-1][some]] += 1
        edge[(self.at[:-1] + count)[some]] -= 1
        return np.cumsum(edge[: max(len(self.bases) - width + 1, 0)]).astype(bool)

    def pos(self, where: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
        """Positions in the sequences."""
        block = self.block(where) if block is None else block
        return self.start[block] + where - self.at[block]


def pieces(batch, first: int):
    """(first row, Piece) of a batch whose columns from ``first`` on are start, owned, bases, total."""
    start, owned, total = (batch.column(first + i).to_numpy().astype(np.int64) for i in (0, 1, 3))
    column = batch.column(first + 2)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, side="right")) - 1)
        yield row, Piece(data[at[row] : at[stop]], at[row : stop + 1] - at[row], start[row:stop], owned[row:stop], total[row:stop])
        row = stop


def bounded(df: DataFrame) -> DataFrame:
    """df, with Spark's own bound on the rows of an Arrow batch lowered to BATCH_ROWS, where it is higher or off."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def scan(seqs: DataFrame, ids: list[str], width: int, kernel: Callable, fields: str, seq: str = "seq") -> DataFrame:
    """ids and ``fields`` of what ``kernel`` finds in windows of ``width``. kernel(piece) gives the places of hits in
    ``piece.bases`` (each in an owned window, or at its place), then an array or Arrow array for each field; or it yields
    these for one part of the hits after another."""
    import pyarrow as pa

    rows = bounded(blocks(seqs, width - 1, ids, seq))
    found = T.StructType.fromDDL(fields)
    schema = T.StructType([*(rows.schema[i] for i in ids), *found.fields])

    def run(batches):
        for batch in batches:
            for row, piece in pieces(batch, len(ids)):
                parts = kernel(piece)
                for where, *columns in [parts] if isinstance(parts, tuple) else parts:
                    if len(where):
                        of = pa.array(row + piece.block(where))
                        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(len(ids))), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=schema.names)

    return rows.mapInArrow(run, schema)


def strings(bases: np.ndarray, where: np.ndarray, width: int, back: np.ndarray | None = None):
    """The windows at some places as an Arrow column, those in ``back`` as their reverse complements."""
    import pyarrow as pa

    found = bases[where[:, None] + np.arange(width)]
    if back is not None and back.any():
        found[back] = COMPLEMENT[found[back]][:, ::-1]
    return pa.StringArray.from_buffers(len(where), pa.py_buffer(np.arange(0, len(where) * width + 1, width, dtype=np.int32).tobytes()), pa.py_buffer(found.tobytes()))


def choice(names: list[str], index: np.ndarray):
    """An Arrow column of names by index."""
    import pyarrow as pa

    return pa.DictionaryArray.from_arrays(pa.array(index.astype(np.int32)), pa.array(names)).cast(pa.string())


def known(bases: np.ndarray, width: int) -> np.ndarray:
    """Of each window: whether all its bases are A, C, G or T."""
    bad = np.r_[0, np.cumsum(CODE[bases] > 3)]
    return bad[width:] == bad[: len(bad) - width] if len(bases) >= width else np.zeros(0, bool)


def packed(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window of k (31 at most) as two bits a base, and its reverse complement; by doubling, so log k steps."""
    code = (CODE[bases] & 3).astype(np.uint64)
    size, fore, back = 1, code, np.uint64(3) - code
    out_fore, out_back, done = None, None, 0

    def joined(f, r, n, f2, r2, m):
        """Windows of n and the windows of m right after them."""
        count = max(len(code) - n - m + 1, 0)
        return f[:count] << np.uint64(2 * m) | f2[n : n + count], r[:count] | r2[n : n + count] << np.uint64(2 * n)

    while True:
        if k & size:
            out_fore, out_back = (fore, back) if out_fore is None else joined(out_fore, out_back, done, fore, back, size)
            done += size
        if size * 2 > k:
            return out_fore, out_back
        fore, back = joined(fore, back, size, fore, back, size)
        size *= 2


def kmers(seqs: DataFrame, k: int, ids: list[str], seq: str = "seq", valid: bool = True) -> DataFrame:
    """ids, pos (0-based), kmer for every window of k bases; ``valid`` keeps those of A, C, G and T alone."""

    def kernel(piece):
        on = piece.owns(k)
        where = np.flatnonzero(on & known(piece.bases, k) if valid else on)
        return where, piece.pos(where), strings(piece.bases, where, k)

    return scan(seqs, ids, k, kernel, "pos long, kmer string", seq)
