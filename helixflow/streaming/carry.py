"""State carried over batches: windows of sequences that arrive in chunks, and scores on streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import mismatch_score

STATE = "next long, start long, tail string, waiting_parts array<long>, waiting_bases array<string>"
_BASES = frozenset("ACGT")


def advanced(state: tuple, parts: list[tuple[int, str]], k: int):
    """(state, chunks) after some parts (number, bases) of one sequence. state: the next part's number, the position of the tail, the tail of
    k - 1 bases at most, and parts that came too early. chunks: (position, bases) whose windows of k bases are all new. A part that has
    come before is left out."""
    following, start, tail, waiting = state
    waiting = dict(waiting)
    for number, bases in parts:
        if number >= following:
            waiting.setdefault(number, bases)
    out = []
    while following in waiting:
        text = tail + waiting.pop(following)
        out.append((start, text))
        keep = min(k - 1, len(text))
        start, tail = start + len(text) - keep, text[len(text) - keep :]
        following += 1
    return (following, start, tail, sorted(waiting.items())), out


def chunk_windows(chunks: DataFrame, k: int, key: str = "seq_id") -> DataFrame:
    """key, pos (in the whole sequence), kmer: every window of k bases of A, C, G and T, also across chunks, once it is whole.

    chunks is a stream (key, part, bases): the parts of a sequence, from 0 on, in any order and in any batches. For each sequence the
    state is its last k - 1 bases, and the parts that came before their turn; it stays, as a sequence has no known end. A null
    part or null bases are an error of the row; repeated parts count once. Columns of other names are left out.
    """
    import pandas as pd

    if k < 1:
        raise ValueError("k must be positive")
    bad = F.raise_error(F.lit("a chunk needs a part and bases"))
    rows = chunks.select(F.col(key).alias("_key"), F.when(F.col("part").isNull() | F.col("bases").isNull(), bad.cast("long")).otherwise(F.col("part").cast("long")).alias("part"), F.upper("bases").alias("bases"))

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        following, start, tail, numbers, waits = state.get if state.exists else (0, 0, "", [], [])
        parts = sorted((int(n), b) for batch in batches for n, b in zip(batch["part"], batch["bases"], strict=True))
        (following, start, tail, waiting), out = advanced((following, start, tail, zip(numbers, waits, strict=True)), parts, k)
        state.update((following, start, tail, [n for n, _ in waiting], [b for _, b in waiting]))
        for at, text in out:
            found = [(at + i, text[i : i + k]) for i in range(len(text) - k + 1) if _BASES.issuperset(text[i : i + k])]
            for i in range(0, len(found), 50_000):
                pos, kmers = zip(*found[i : i + 50_000], strict=True)
                yield pd.DataFrame({"_key": [keys[0]] * len(pos), "pos": pos, "kmer": kmers})

    kind = chunks.schema[key].dataType.simpleString()
    found = rows.groupBy("_key").applyInPandasWithState(run, f"_key {kind}, pos long, kmer string", STATE, "append", "NoTimeout")
    return found.withColumnRenamed("_key", key)


def scored_stream(hits: DataFrame) -> DataFrame:
    """A stream (or table) of hits (spacer, site, others) with score: stateless, so batches of any size give the same."""
    return hits.withColumn("score", mismatch_score(F.col("spacer"), F.col("site")))
