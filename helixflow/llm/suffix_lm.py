"""LM scoring with a probabilistic suffix tree over words.

The root is the smoothed unigram distribution of all training tokens. Words that occur ``least_count`` times or more
are the tree's alphabet. Its contexts are runs of one to ``depth`` of them that occur ``least_count`` times or more,
with the counts of the words of the alphabet that follow ``least_next`` times or more. A context gives such a word its
discounted share, and leaves the rest of its mass to its parent, the context without its oldest word. A context is
retained if its shares and its rest diverge from what its parent gives to the same words and to all others by
``least_gain`` bits, or if a longer retained context ends in it. A token is scored in the state of its
longest retained context.

All counts cover all training documents. The tree grows with the corpus and stays in distributed tables; what documents
need of it comes back by buckets: each bucket asks once for each of its words, contexts and words after a context. Only
bitmaps of a fixed size are broadcast. They save work that can have no result, and decide nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, batches_of, bounded_batches, crc_bucket, distinct, first_places, materialise, mix64, release, table, tidy, word_id, word_pieces

ODD = np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(mix64(np.array([1], np.uint64))[0])  # the end token
#: Bits of a bitmap, and of the one of pairs that occur twice. The latter is made in spans.
BITS = 1 << 27
PAIR_BITS = 1 << 27
PAIR_SPAN = 1 << 21
#: Tokens that a task counts at once. Spark sums what a task yields again before the shuffle, so more would save little.
TOKENS = 250_000
#: Training tokens for each span of codes that a task answers for.
SPAN_TOKENS = 2_000_000
#: Rows of an Arrow batch of facts, and of one of packed spans.
FACT_ROWS = 20_000
SPAN_ROWS = 16
#: Spans of the words' hashes when they are counted.
WORD_SPANS = 256
#: The same as SPAN_TOKENS where pairs are counted. They travel whole there, in fewer bytes a span.
COUNT_TOKENS = 1_000_000


@dataclass(frozen=True)
class TreeOptions:
    depth: int = 3
    least_count: int = 4
    least_next: int = 2
    least_gain: float = 0.02
    discount: float = 0.5
    bucket_tokens: int = 6_000_000
    bucket_bytes: int = 5_000_000  # of a file's split
    score_rounds: int = 4  # a part of the buckets asks at a time


def token_pieces(column):
    """(first row, tokens, offsets) for runs of rows of an Arrow string column: the words of each text, then the end."""
    for row, words, at in word_pieces(column):
        ends = at[1:] + np.arange(len(at) - 1)
        tokens = np.empty(len(words) + len(ends), np.uint64)
        is_word = np.ones(len(tokens), bool)
        is_word[ends] = False
        tokens[is_word] = words
        tokens[ends] = END
        yield row, tokens, np.r_[0, ends + 1]


def pair_code(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The code of a context and the word after it, which is also that of the context longer by this word."""
    return mix64(symbol ^ ((state.astype(np.uint64) + np.uint64(1)) * ODD))


def lookup(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted array, or -1."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


def code_span(code: np.ndarray, spans: int) -> np.ndarray:
    """Which of some even spans a code lies in."""
    return ((code >> np.uint64(32)) * np.uint64(spans)) >> np.uint64(32)


def packed_type(*names: str) -> T.StructType:
    return T.StructType([T.StructField("span", T.LongType()), *(T.StructField(name, T.BinaryType()) for name in names)])


def by_spans(code: np.ndarray, spans: int, **columns: np.ndarray):
    """An Arrow table with a row for each span of the codes: the columns' entries there, packed. Signed numbers go as planes of
    their bytes, others as they are."""
    import pyarrow as pa

    span = code_span(code, spans).astype(np.uint16 if spans <= 1 << 16 else np.uint32)
    if not (span[1:] >= span[:-1]).all():
        order = np.argsort(span, kind="stable")
        span, columns = span[order], {name: x[order] for name, x in columns.items()}
    first = np.flatnonzero(np.r_[True, span[1:] != span[:-1]][: len(span)])
    stop = np.r_[first[1:], len(span)][: len(first)]
    out = {"span": pa.array(span[first].astype(np.int64))}
    for name, x in columns.items():
        write = planes if x.dtype == np.int64 else np.ndarray.tobytes
        out[name] = pa.array([write(x[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary())
    return pa.table(out)


def entries(rows, name: str, kind=np.uint64) -> np.ndarray:
    """All entries of a packed column; kind: their type, np.int64 for planes."""
    if kind is np.int64:
        return np.concatenate([np.zeros(0, np.uint64), *(from_planes(x.as_py()) for x in rows.column(name))]).view(np.int64)
    return np.frombuffer(b"".join(x.as_py() for x in rows.column(name)), kind)


class Answers:
    """What a bucket has been told: sorted codes with a value and a rest each. Codes are random, so the leading bits of
    one say nearly where it is."""

    def __init__(self, code: np.ndarray, value: np.ndarray, rest: np.ndarray):
        if not (code[1:] > code[:-1]).all():
            code, first = first_places(code)
            value, rest = value[first], rest[first]
        # An entry is in one place of memory. One more, so that a search has where to end.
        rows = np.full((len(code) + 1, 3), 0xFFFFFFFFFFFFFFFF, np.uint64)
        rows[:-1, 0], rows[:-1, 1], rows[:-1, 2] = code, value, rest
        self.code, self.value, self.rest = rows[:, 0], rows[:-1, 1].view(np.int64), rows[:-1, 2].view(np.int64)
        bits = max(1, len(code).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((code >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        at = self.start[values >> self.shift]
        on = np.flatnonzero(self.code[at] < values)
        while len(on):
            at[on] += 1
            on = on[self.code[at[on]] < values[on]]
        return np.where((self.code[at] == values) & (at < len(self.value)), at, -1)


class Bitmap:
    """A set of codes, by their leading bits, that may hold more than were put in, never fewer."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @classmethod
    def of(cls, codes: DataFrame) -> Bitmap:
        """codes: one column, code. BITS / 64 cells at most reach the driver."""
        bit = 65 - BITS.bit_length()
        rows = codes.selectExpr(f"shiftrightunsigned(code, {bit + 6}) as cell", f"shiftleft(1L, cast(shiftrightunsigned(code, {bit}) & 63 as int)) as bit")
        found = rows.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        cells = np.zeros(BITS >> 6, np.uint64)
        cells[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(cells)

    @classmethod
    def of_packed(cls, rows: DataFrame, least: int = 0) -> Bitmap:
        """rows: codes by spans, sorted, and counts, or codes alone; those below ``least`` are left out. A row is a stretch of the
        bitmap, so about BITS / 8 bytes reach the driver."""
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                for k, data in enumerate(batch.column(0)):
                    code = unpack_codes(data.as_py())
                    if least:
                        code = code[from_planes(batch.column(1)[k].as_py()) >= least]
                    if len(code):
                        bits = distinct(code >> np.uint64(65 - BITS.bit_length()))
                        cell = bits >> np.uint64(6)
                        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                        stretch = np.zeros(int(cell[-1] - cell[0]) + 1, np.uint64)
                        stretch[cell[first] - cell[0]] = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), first)
                        yield pa.RecordBatch.from_arrays([pa.array([int(cell[0])], pa.int64()), pa.array([stretch.tobytes()], pa.binary())], names=["cell", "bits"])

        with batches_of(rows.sparkSession, SPAN_ROWS):
            found = rows.mapInArrow(run, T.StructType().add("cell", T.LongType()).add("bits", T.BinaryType())).toArrow()
        cells = np.zeros(BITS >> 6, np.uint64)
        for cell, bits in zip(found.column("cell").to_pylist(), found.column("bits"), strict=True):
            stretch = np.frombuffer(bits.as_buffer(), np.uint64)
            cells[cell : cell + len(stretch)] |= stretch
        return cls(cells)

    def any(self) -> bool:
        return bool(self.cells.any())

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = codes >> np.uint64(59 - len(self.cells).bit_length())
        return (self.cells[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def state_codes(tokens: np.ndarray, place: np.ndarray, depth: int):
    """(level, positions, codes) of the contexts of each length that a token of the same text follows. place: of each
    token in its text. A context of one word has the word's own hash for its code, as if it followed nothing."""
    code = tokens
    for level in range(1, depth + 1):
        if level > 1:
            code = np.r_[np.uint64(0), pair_code(code[:-1], tokens[1:])]
        at = np.flatnonzero((place[:-1] >= level - 1) & (place[1:] > 0))
        yield level, at, code[at]


def context_codes(tokens: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """Codes as of ``state_codes`` of the contexts of one length that end in some positions."""
    code = tokens[at - (level - 1)]
    for k in range(level - 2, -1, -1):
        code = pair_code(code, tokens[at - k])
    return code


def places(at: np.ndarray) -> np.ndarray:
    return np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))


def count_words(docs: DataFrame) -> DataFrame:
    """key, c over all documents' tokens; a task sums over many documents before the shuffle, and sends them packed."""
    import pyarrow as pa

    def summed(parts):
        key, c = np.unique(np.concatenate(parts), return_counts=True)
        return by_spans(key, WORD_SPANS, keys=key, counts=c.astype(np.int64)).to_batches(BATCH_ROWS)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, tokens, _ in token_pieces(batch.column(0)):
                parts.append(tokens)
                size += len(tokens)
                if size >= 2 * TOKENS:
                    yield from summed(parts)
                    parts, size = [], 0
        if parts:
            yield from summed(parts)

    def merge(rows):
        key, c = entries(rows, "keys"), entries(rows, "counts", np.int64)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return pa.table({"key": key[first].view(np.int64), "c": np.add.reduceat(c[order], first)})

    schema = T.StructType().add("key", T.LongType()).add("c", T.LongType())
    return docs.select("text").mapInArrow(run, packed_type("keys", "counts")).groupBy("span").applyInArrow(merge, schema)


def repeated_pairs(docs: DataFrame, words) -> Bitmap:
    """Pairs of words of the bitmap ``words`` (a broadcast), one after the other, that occur twice or more, and few others.

    Tasks send which of the bitmap's bits they met, once or again, as steps of about a byte; a span of bits is set where two
    tasks met it or one did again. One span at a time is in memory, and PAIR_BITS / 8 bytes reach the driver.
    """
    import pyarrow as pa

    def met(codes):
        bits = np.concatenate(codes)
        bits.sort()
        same = bits[1:] == bits[:-1]
        rows = []
        for again, x in ((False, bits[np.r_[True, ~same]]), (True, distinct(bits[1:][same]))):
            cuts = np.searchsorted(x, np.arange(0, PAIR_BITS, PAIR_SPAN, dtype=np.uint32)).tolist() + [len(x)]
            rows += [(k, again, pack_codes(x[a:b].astype(np.uint64))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["span", "again", "bits"])

    def run(batches):
        codes, size = [], 0
        for batch in batches:
            for _, tokens, at in token_pieces(batch.column(0)):
                known = words.value.has(tokens)
                where = np.flatnonzero(known[:-1] & known[1:] & (places(at)[1:] > 0))
                if len(where):
                    codes.append((pair_code(tokens[where], tokens[where + 1]) >> np.uint64(65 - PAIR_BITS.bit_length())).astype(np.uint32))
                    size += len(where)
                if size >= 8 * TOKENS:
                    yield met(codes)
                    codes, size = [], 0
        if codes:
            yield met(codes)

    def merge(batches):
        span, once, again = None, None, None

        def bits():
            return pa.RecordBatch.from_arrays([pa.array([span], pa.int32()), pa.array([np.packbits(again, bitorder="little").tobytes()])], names=["span", "bits"])

        for batch in batches:
            for k, twice, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != span:
                    if span is not None:
                        yield bits()
                    span, once, again = k, np.zeros(PAIR_SPAN, bool), np.zeros(PAIR_SPAN, bool)
                # A chunk's own two rows meet only on bits that are set anyway.
                at = unpack_codes(data.as_py()) & np.uint64(PAIR_SPAN - 1)
                again[at if twice else at[once[at]]] = True
                once[at] = True
        if span is not None:
            yield bits()

    rows = docs.select("text").mapInArrow(run, T.StructType().add("span", T.IntegerType()).add("again", T.BooleanType()).add("bits", T.BinaryType()))
    spans = rows.repartition("span").sortWithinPartitions("span").mapInArrow(merge, T.StructType().add("span", T.IntegerType()).add("bits", T.BinaryType()))
    cells = np.zeros(PAIR_BITS >> 6, np.uint64)
    found = spans.toArrow()
    for k, bits in zip(found.column("span").to_pylist(), found.column("bits"), strict=True):
        cells[k * PAIR_SPAN >> 6 : (k + 1) * PAIR_SPAN >> 6] = np.frombuffer(bits.as_buffer(), np.uint64)
    return Bitmap(cells)


def count_next(docs: DataFrame, level: int, words, contexts, pairs, least: int, spans: int = 1, parent_spans: int = 0) -> DataFrame:
    """context, key, c: how often a word of the bitmap ``words`` follows a context of this level in the bitmap
    ``contexts``, ``least`` times or more. A bitmap ``pairs`` (or None) holds all such pairs of the level before, or, on the
    first level, of this one: no word follows a context more often than it follows the context's end. All are broadcasts.

    A task sends its pairs packed, one row for each of ``spans`` spans of their codes, and they are summed a span at a time:
    a row for each pair would fill the heap with tables of sums, as most pairs occur once in a task. With ``parent_spans``
    they stay packed, as rows for so many spans of their parents: codes, contexts, parents, counts. A pair's parent is the
    pair of the context without its oldest word and the same word, or that word alone.
    """
    import pyarrow as pa

    def summed(context, key, suffix, c=None):
        code = pair_code(context, key)
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        c = np.diff(np.r_[first, len(code)]) if c is None else np.add.reduceat(c[order], first) if len(first) else c
        code, first = code[first], order[first]
        return code, context[first], key[first], suffix[first] if level > 1 else suffix, c

    def packed(parts):
        code, context, key, suffix, c = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        columns = {"contexts": context, "keys": key, "counts": c} | ({"suffixes": suffix} if level > 1 else {})
        return by_spans(code, spans, **columns).to_batches(BATCH_ROWS)

    def merge(rows):
        none = np.zeros(0, np.uint64)
        code, context, key, suffix, c = summed(entries(rows, "contexts"), entries(rows, "keys"), entries(rows, "suffixes") if level > 1 else none, entries(rows, "counts", np.int64))
        on = c >= least
        code, context, key, c = code[on], context[on], key[on], c[on]
        if not parent_spans:
            return pa.table({"context": context.view(np.int64), "key": key.view(np.int64), "c": c})
        parent = pair_code(suffix[on], key) if level > 1 else key
        return by_spans(parent, parent_spans, codes=code, contexts=context, parents=parent, counts=c)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, tokens, at in token_pieces(batch.column(0)):
                shorter = tokens
                for longest, where, code in state_codes(tokens, places(at), level):
                    if longest == level - 1:
                        shorter = np.zeros(len(tokens), np.uint64)
                        shorter[where] = code
                on = contexts.value.has(code)
                where, code = where[on], code[on]
                if level == 1 or pairs is None:  # else the pair's parent has the word
                    on = words.value.has(tokens[where + 1])
                    where, code = where[on], code[on]
                if pairs is not None and len(where):
                    on = pairs.value.has(pair_code(shorter[where], tokens[where + 1]))
                    where, code = where[on], code[on]
                if len(where):
                    parts.append((code, tokens[where + 1], shorter[where] if level > 1 else shorter[:0]))
                    size += len(where)
                if size >= 2 * TOKENS:
                    yield from packed(parts)
                    parts, size = [], 0
        if parts:
            yield from packed(parts)

    sent = packed_type("contexts", "keys", "counts", *(["suffixes"] if level > 1 else []))
    schema = packed_type("codes", "contexts", "parents", "counts") if parent_spans else T.StructType().add("context", T.LongType()).add("key", T.LongType()).add("c", T.LongType())
    return docs.select("text").mapInArrow(run, sent).groupBy("span").applyInArrow(merge, schema)


def first_level(words: DataFrame, total: int, vocabulary: int, least: int) -> DataFrame:
    """What ``grown`` asks on the first level, from packed facts of words: those of the alphabet, by spans, with their
    probability in the root. A word has no shorter context than itself."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k, span in enumerate(batch.column(0).to_pylist()):
                code, c = unpack_codes(batch.column(1)[k].as_py()), from_planes(batch.column(2)[k].as_py())
                code, c = code[c >= least], c[c >= least]
                if len(code):
                    q = (c + 1) / (total + vocabulary + 1)
                    columns = [pack_codes(code), planes(c), bytes(8 * len(code)), q.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([span], pa.int64()), *(pa.array([x], pa.binary()) for x in columns)], names=["span", "codes", "counts", "parents", "qs"])

    with batches_of(words.sparkSession, SPAN_ROWS):
        return materialise(words.select("span", "codes", "values").mapInArrow(run, packed_type("codes", "counts", "parents", "qs")))


def grown(counted: DataFrame, base: DataFrame, spans: int, options: TreeOptions) -> DataFrame:
    """A row for each span of the contexts of a level: contexts, suffixes, ns, rests, owns (whether they diverge by ``least_gain``), sizes
    (next words of each), and codes, parents, counts, qs (probability in the context) of their next words, one context after another.

    counted: packed by ``count_next``. base: by spans of the codes, all pairs of the level before (or the words) with their
    count, parent and probability. It knows what a pair's parent gives and how often a context occurs, as a context
    has the code of the pair that it ends in; bitmaps may have let others through, these lookups don't. Spans hold
    about 1 / ``spans`` of the contexts; a context's next words are together, as many as distinct words follow it twice.
    """
    import pyarrow as pa

    def rated(rows, base):
        known, q = (np.concatenate([np.zeros(0, np.uint64), *(unpack_codes(x.as_py()) for x in base.column("codes"))]), entries(base, "qs", np.float64))
        parent = entries(rows, "parents")
        at = lookup(known, parent)
        on = at >= 0
        context = entries(rows, "contexts")[on]
        return by_spans(context, spans, codes=entries(rows, "codes")[on], contexts=context, parents=parent[on], counts=entries(rows, "counts", np.int64)[on], qs=q[at[on]])

    def together(rows, base):
        known, often = np.concatenate([np.zeros(0, np.uint64), *(unpack_codes(x.as_py()) for x in base.column("codes"))]), entries(base, "counts", np.int64)
        at = lookup(known, entries(rows, "contexts"))
        at[at >= 0] = np.where(often[at[at >= 0]] >= options.least_count, at[at >= 0], -1)
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at[order], 0) :]
        if not len(order):
            return pa.table({f.name: pa.array([], pa.int64() if f.name == "span" else pa.binary()) for f in schema})
        at = at[order]
        code, parent, c, q = entries(rows, "codes")[order], entries(rows, "parents")[order], entries(rows, "counts", np.int64)[order], entries(rows, "qs", np.float64)[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size = np.diff(np.r_[first, len(at)])
        here = at[first]
        n = often[here]
        share = (c - options.discount) / np.repeat(n, size)
        rest = np.floor((n - np.add.reduceat(c, first) + options.discount * size) * UNIT + 0.5).astype(np.int64)
        others, left = rest / UNIT / n, 1 - np.add.reduceat(q, first)
        on = (others > 0) & (left > 0)
        gain = np.add.reduceat(share * np.log2(share / q), first)
        gain[on] += others[on] * np.log2(others[on] / left[on])
        q = share + np.repeat(rest / UNIT / n, size) * q
        found = {"contexts": known[here], "suffixes": entries(base, "parents")[here], "ns": n, "rests": rest, "owns": np.round(gain, 9) >= options.least_gain, "sizes": size, "codes": code, "parents": parent, "counts": c, "qs": q}
        row = [planes(x) if x.dtype == np.int64 else x.tobytes() for x in found.values()]
        return pa.table([pa.array(code_span(known[here[:1]], spans).view(np.int64)), *(pa.array([x], pa.binary()) for x in row)], names=["span", *found])

    schema = packed_type("contexts", "suffixes", "ns", "rests", "owns", "sizes", "codes", "parents", "counts", "qs")
    rows = counted.groupBy("span").cogroup(base.groupBy("span")).applyInArrow(rated, packed_type("codes", "contexts", "parents", "counts", "qs"))
    return rows.groupBy("span").cogroup(base.groupBy("span")).applyInArrow(together, schema)


#: Columns of ``grown`` that stay until the facts are written.
LEVEL = ("span", "contexts", "suffixes", "ns", "rests", "owns", "sizes", "codes", "counts")


def next_level(level: DataFrame, spans: int) -> DataFrame:
    """What ``grown`` asks on the next level: all pairs of this one, by spans of their codes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                code = entries(row, "codes")
                yield from by_spans(code, spans, codes=code, counts=entries(row, "counts", np.int64), parents=entries(row, "parents"), qs=entries(row, "qs", np.float64)).to_batches(BATCH_ROWS)

    def merge(rows):
        code = entries(rows, "codes")
        order = np.argsort(code)
        columns = [pack_codes(code[order]), planes(entries(rows, "counts", np.int64)[order]), entries(rows, "parents")[order].tobytes(), entries(rows, "qs", np.float64)[order].tobytes()]
        return pa.table([pa.array(code_span(code[:1], spans).view(np.int64)), *(pa.array([x], pa.binary()) for x in columns)], names=schema.names)

    schema = packed_type("codes", "counts", "parents", "qs")
    with batches_of(level.sparkSession, SPAN_ROWS):
        return materialise(level.select("codes", "counts", "parents", "qs").mapInArrow(run, schema).groupBy("span").applyInArrow(merge, schema))


def settled(level: DataFrame, longer: DataFrame | None, spans: int, keep: bool) -> DataFrame:
    """Facts of the retained contexts of a level and of their next words (kind ``fact``), the suffixes of these contexts
    (``end``), and, with ``keep``, all contexts (``context``). longer: the same of the next level, whose ends retain more."""
    import pyarrow as pa

    def sorted_out(rows, ends):
        parts = []

        def put(kind, table):
            for name in schema.names[1:]:
                if name not in table.column_names:
                    table = table.append_column(name, pa.array([kind] * len(table), pa.string()) if name == "kind" else pa.nulls(len(table), pa.binary()))
            parts.append(table.select(schema.names))

        context, n, rest = entries(rows, "contexts"), entries(rows, "ns", np.int64), entries(rows, "rests", np.int64)
        suffix, retained = entries(rows, "suffixes"), entries(rows, "owns", np.bool_)
        if ends is not None:
            retained = retained | (lookup(distinct(entries(ends, "codes")), context) >= 0)
        after = np.repeat(retained, entries(rows, "sizes", np.int64))
        code = np.r_[fact_code("context", context[retained]), fact_code("pair", entries(rows, "codes")[after])]
        value, more = entries(rows, "counts", np.int64)[after], np.zeros(after.sum(), np.int64)
        put("fact", by_spans(code, spans, codes=code, values=np.r_[n[retained], value], rests=np.r_[rest[retained], more]))
        code = distinct(suffix[retained])
        put("end", by_spans(code, spans, codes=code))
        if keep:
            put("context", by_spans(context, spans, codes=context, values=n, rests=rest, suffixes=suffix, retained=retained))
        return pa.concat_tables(parts)

    schema = packed_type("codes", "values", "rests", "suffixes", "retained").add("kind", T.StringType())
    rows = level.groupBy("span")
    if longer is None:
        return materialise(rows.applyInArrow(lambda rows: sorted_out(rows, None), schema))
    return materialise(rows.cogroup(longer.where("kind = 'end'").select("span", "codes").groupBy("span")).applyInArrow(sorted_out, schema))


def as_rows(packed: DataFrame, names: dict, lists: dict) -> DataFrame:
    """A row for each entry of packed columns. names: their types by the columns' names; lists: the rows' columns from those."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = {name: entries(batch.slice(k, 1), name, kind) for name, kind in names.items()}
                columns = {name: read(found) for name, read in lists.items()}
                yield from pa.table({name: x.view(np.int64) if x.dtype == np.uint64 else x for name, x in columns.items()}).to_batches(FACT_ROWS)

    return packed.select(*names).mapInArrow(run, T.StructType([T.StructField(name, T.BooleanType() if name == "retained" else T.LongType()) for name in lists]))


class SuffixTree:
    """contexts: for each level, a table context, suffix, n (occurrences), rest (the left-over mass, in ``unit``s of an
    occurrence), retained. nexts: for each level, a table context, code, c of the next words. facts: what scoring may ask, packed by spans of
    its codes (span, codes, values, rests): a word's count; n and rest of a retained context; the count of a word after one (rest is 0 but for contexts)."""

    def __init__(self, options: TreeOptions, total: int, vocabulary: int, contexts: list[DataFrame], nexts: list[DataFrame], facts: DataFrame, asked: Bitmap):
        self.options, self.total, self.vocabulary = options, total, vocabulary
        self.contexts, self.nexts, self.facts, self.asked = contexts, nexts, facts, asked
        self.sent = None

    def shared(self, spark):
        """The bitmap of facts, broadcast once however often texts are scored."""
        self.sent = self.sent or spark.sparkContext.broadcast(self.asked)
        return self.sent

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.vocabulary + 1)


#: Rests are whole numbers of 1 / UNIT occurrences, so that they shuffle as small longs.
UNIT = 1 << 10
KINDS = {"context": np.uint64(0x9FB21C651E98DF25), "pair": np.uint64(0xD1B54A32D192ED03)}


def fact_code(kind: str, code: np.ndarray) -> np.ndarray:
    return mix64(code ^ KINDS[kind])


def packed_facts(facts: DataFrame, total: int) -> DataFrame:
    """code, value, rest as a row for each span of the codes. All rounds of scoring read these, and move no row for each fact."""
    import pyarrow as pa

    spans = fact_spans(total)

    def pack(rows):
        code, at = first_places(rows.column("code").to_numpy().view(np.uint64))
        value, rest = (rows.column(k).to_numpy()[at].view(np.uint64) for k in ("value", "rest"))
        return pa.table({"span": pa.array(code_span(code[:1], spans).view(np.int64)), "codes": pa.array([pack_codes(code)], pa.binary()), "values": pa.array([planes(value)], pa.binary()), "rests": pa.array([planes(rest)], pa.binary())})

    placed = facts.withColumn("span", F.shiftright(F.shiftrightunsigned("code", 32) * spans, 32))
    with batches_of(facts.sparkSession, FACT_ROWS):  # no texts here
        return materialise(placed.groupBy("span").applyInArrow(pack, T.StructType().add("span", T.LongType()).add("codes", T.BinaryType()).add("values", T.BinaryType()).add("rests", T.BinaryType())))


def merged_facts(words: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Facts of words (of ``packed_facts``) and of all levels (of ``settled``) in one row for each span."""
    import pyarrow as pa

    def merge(rows):
        code = [unpack_codes(x.as_py()) if kind == "word" else np.frombuffer(x.as_py(), np.uint64) for kind, x in zip(rows.column("kind").to_pylist(), rows.column("codes"), strict=True)]
        code, at = first_places(np.concatenate(code))
        columns = [pack_codes(code), *(planes(entries(rows, k, np.int64)[at]) for k in ("values", "rests"))]
        return pa.table([rows.column("span")[:1].combine_chunks(), *(pa.array([x], pa.binary()) for x in columns)], names=schema.names)

    schema = packed_type("codes", "values", "rests")
    found = [words.withColumn("kind", F.lit("word")), *(x.where("kind = 'fact'").select(*schema.names, "kind") for x in levels)]
    return materialise(reduce(DataFrame.unionByName, found).groupBy("span").applyInArrow(merge, schema))


def fact_bitmap(facts: DataFrame) -> Bitmap:
    """The bitmap of all codes of packed facts."""
    return Bitmap.of_packed(facts.select("codes"))


def fact_spans(total: int) -> int:
    return max(1, -(-total // SPAN_TOKENS))


def in_words(tokens: np.ndarray, known: Answers) -> Answers:
    """For each word of a bucket its count, and in place of a rest where ``known`` has it as a context, or -1."""
    word = distinct(tokens)
    at = known.find(word)
    c = np.zeros(len(word), np.int64)
    c[at >= 0] = known.value[at[at >= 0]]
    return Answers(word, c.view(np.uint64), known.find(fact_code("context", word)).astype(np.int64).view(np.uint64))


def in_states(tokens, place, p, words, known: Answers, options: TreeOptions, asked: Bitmap) -> np.ndarray:
    """Probabilities in the longest retained contexts, from those in the root: one step down for each length. A context is
    retained only where its suffix is. words: where ``known`` has each token as a context, or -1."""
    p = p.copy()
    at = np.flatnonzero(place[1:] > 0)
    for level in range(1, options.depth + 1):
        at = at[place[at] >= level - 1]
        context = context_codes(tokens, at, level)
        if level == 1:
            held = words[at]
        else:
            code = fact_code("context", context)
            on = asked.has(code)
            held, at, context = known.find(code[on]), at[on], context[on]
        on = held >= 0
        held, at, context = held[on], at[on], context[on]
        if len(at):
            code = fact_code("pair", pair_code(context, tokens[at + 1]))
            on = np.flatnonzero(asked.has(code))
            found = known.find(code[on])
            share = np.zeros(len(at))
            share[on[found >= 0]] = known.value[found[found >= 0]] - options.discount
            p[at + 1] = (share + known.rest[held] / UNIT * p[at + 1]) / known.value[held]
    return p


def grow_tree(docs: DataFrame, counts: DataFrame, options: TreeOptions, keep: bool = True) -> SuffixTree:
    """docs: training documents; counts: key, c of their words. Without ``keep`` the tables of levels are deleted once their
    facts are written."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, vocabulary = sums["n"] or 0, sums["v"] or 0
    spans = fact_spans(total)
    counted_words = packed_facts(counts.select(F.col("key").alias("code"), F.col("c").alias("value"), F.lit(0).cast("long").alias("rest")), total)
    base = first_level(counted_words, total, vocabulary, options.least_count)
    symbols = spark.sparkContext.broadcast(Bitmap.of_packed(base.select("codes")))
    here = symbols
    # Beyond some tokens a bit the bitmap would be full and save nothing. A pair is let through or not by its bits alone.
    pairs = None
    if options.least_next > 1 and total <= 8 * PAIR_BITS:
        pairs = spark.sparkContext.broadcast(repeated_pairs(docs, symbols))
    levels = []
    for level in range(1, options.depth + 1):
        if level > 1:
            # Pairs with the end token have codes here too, but nothing follows them.
            here = spark.sparkContext.broadcast(Bitmap.of_packed(base.select("codes", "counts"), options.least_count))
            if not here.value.any():
                here.destroy()
                break
            pairs = spark.sparkContext.broadcast(Bitmap.of_packed(base.select("codes")))
        # What tasks sent leaves the disk before the pairs that count are looked up.
        counted = materialise(count_next(docs, level, symbols, here, pairs, options.least_next, max(1, -(-total // COUNT_TOKENS)), spans))
        tidy(spark)
        whole = materialise(grown(counted, base, spans, options))
        if here is not symbols:
            here.destroy()
        if pairs is not None:
            pairs.destroy()
        release(counted, base)
        tidy(spark)
        if level < options.depth:
            base = next_level(whole, spans)
        levels.append(materialise(whole.select(*LEVEL)))
        release(whole)
        tidy(spark)
    if len(levels) < options.depth:
        release(base)
    symbols.destroy()
    # From the longest contexts down, as these retain their suffixes.
    found, contexts, nexts = [], [], []
    for level in reversed(levels):
        found.append(settled(level, found[-1] if found else None, spans, keep))
        if keep:
            numbers = {"values": np.int64, "rests": np.int64, "codes": np.uint64, "suffixes": np.uint64, "retained": np.bool_}
            contexts.append(as_rows(found[-1].where("kind = 'context'"), numbers, {"context": lambda x: x["codes"], "suffix": lambda x: x["suffixes"], "n": lambda x: x["values"], "rest": lambda x: x["rests"], "retained": lambda x: x["retained"]}))
            nexts.append(as_rows(level, {"contexts": np.uint64, "sizes": np.int64, "codes": np.uint64, "counts": np.int64}, {"context": lambda x: np.repeat(x["contexts"], x["sizes"]), "code": lambda x: x["codes"], "c": lambda x: x["counts"]}))
        else:
            release(level)
        tidy(spark)
    facts = merged_facts(counted_words, found)
    if not keep:
        release(counted_words, *found)
    return SuffixTree(options, total, vocabulary, contexts[::-1], nexts[::-1], facts, fact_bitmap(facts))


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, without the planes that are zero."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    x = x.astype(np.uint64)
    return bytes([width]) + b"".join((x >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width))


def from_planes(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = part[0].astype(np.uint64)
    for k in range(1, data[0]):
        out |= part[k].astype(np.uint64) << np.uint64(8 * k)
    return out


def pack_codes(codes: np.ndarray) -> bytes:
    """Sorted codes, at least one, as the first and the steps between them."""
    return int(codes[0]).to_bytes(8, "little") + planes(np.diff(codes))


def unpack_codes(data: bytes) -> np.ndarray:
    return np.cumsum(np.r_[np.uint64(int.from_bytes(data[:8], "little")), from_planes(data[8:])], dtype=np.uint64)


def split_bucket(options: TreeOptions) -> Column:
    """A bucket for each split of the files that a table is read from, or several for a large one; to be selected right
    from the table. Texts need not move to ask what their bucket needs."""
    parts = F.greatest(F.ceil(F.input_file_block_length() / options.bucket_bytes), F.lit(1))
    return F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id"), parts))


def score_texts(docs: DataFrame, counts: DataFrame, tree: SuffixTree) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, held_out, text).

    Null and empty texts are the end token alone. Without training documents every count is 0 and the tree is its
    root. Rows of equal id, or without one, are scored each on its own. ``counts`` are in the tree's facts. A column
    ``bucket`` of docs says which rows are scored together; without it they are dealt by their ids.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    options, total, vocabulary = tree.options, tree.total, tree.vocabulary
    dealt = docs
    if "bucket" not in docs.columns:
        n_buckets = max(1, -(-total // options.bucket_tokens))
        dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_buckets)))
    dealt = dealt.select("doc_id", "held_out", "text", "bucket")
    asked = tree.shared(spark)

    def wanted(parts):
        tokens = np.concatenate([t for t, _ in parts])
        place = np.concatenate([places(at) for _, at in parts])
        codes = [distinct(tokens)]
        at = np.flatnonzero(place[1:] > 0)
        for level in range(1, options.depth + 1):
            at = at[place[at] >= level - 1]
            context = context_codes(tokens, at, level)
            on = asked.value.has(fact_code("context", context))
            at, context = at[on], context[on]
            pair = fact_code("pair", pair_code(context, tokens[at + 1]))
            codes += [fact_code("context", distinct(context)), distinct(pair[asked.value.has(pair)])]
        codes[0] = codes[0][asked.value.has(codes[0])]
        return np.concatenate(codes)

    def ask(batches):
        held: dict[int, list] = {}  # parts of each bucket
        codes: dict[int, list] = {}  # what it asks for: merged codes, then new ones
        size = 0

        def flush():
            for b, parts in held.items():
                mine = codes.setdefault(b, [np.zeros(0, np.uint64)])
                mine.append(wanted(parts))
                if sum(map(len, mine[1:])) > max(len(mine[0]), TOKENS):
                    codes[b] = [distinct(np.concatenate(mine))]
            held.clear()

        for batch in batches:
            bucket = batch.column(1).to_numpy()
            for row, tokens, at in token_pieces(batch.column(0)):
                mine = bucket[row : row + len(at) - 1]
                if (mine == mine[0]).all():
                    held.setdefault(int(mine[0]), []).append((tokens, at))
                else:
                    for k, b in enumerate(mine):
                        held.setdefault(int(b), []).append((tokens[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]])))
                size += len(tokens)
                if size >= TOKENS:
                    flush()
                    size = 0
        flush()
        for b, mine in codes.items():
            code = distinct(np.concatenate(mine))
            span = code_span(code, spans)
            first = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])[: len(code)]
            last = np.r_[first[1:], len(code)]
            for k in range(0, len(first), BATCH_ROWS):
                edges = list(zip(first[k : k + BATCH_ROWS].tolist(), last[k : k + BATCH_ROWS].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edges), b, np.int64)), pa.array(span[first[k : k + BATCH_ROWS]].view(np.int64)), pa.array([pack_codes(code[x:y]) for x, y in edges], pa.binary())], names=["bucket", "span", "codes"])

    def answer(questions, facts):
        none = np.zeros(0, np.uint64)
        code, value, rest = (np.concatenate([none, *(read(x.as_py()) for x in facts.column(k))]) for k, read in (("codes", unpack_codes), ("values", from_planes), ("rests", from_planes)))
        code, at = first_places(code)
        value, rest = value[at], rest[at]
        bucket, codes, values, rests = [], [], [], []
        for b, data in zip(questions.column("bucket").to_pylist(), questions.column("codes"), strict=True):
            one = unpack_codes(data.as_py())
            at = lookup(code, one)
            on = at >= 0
            if on.any():
                bucket.append(b), codes.append(pack_codes(one[on])), values.append(planes(value[at[on]])), rests.append(planes(rest[at[on]]))
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "codes": pa.array(codes, pa.binary()), "values": pa.array(values, pa.binary()), "rests": pa.array(rests, pa.binary())})

    # Questions and answers travel packed, a span of the codes at a time: half the bytes of a row for each code.
    spans = fact_spans(total)
    questions = dealt.select("text", "bucket").mapInArrow(ask, T.StructType().add("bucket", T.LongType()).add("span", T.LongType()).add("codes", T.BinaryType()))
    known = questions.groupBy("span").cogroup(tree.facts.groupBy("span")).applyInArrow(answer, T.StructType().add("bucket", T.LongType()).add("codes", T.BinaryType()).add("values", T.BinaryType()).add("rests", T.BinaryType()))
    out = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("held_out", T.BooleanType())
    for name in ("n_tokens", "n_known", "train_tokens"):
        out = out.add(name, T.LongType())
    out = out.add("base_score", T.DoubleType()).add("score", T.DoubleType())

    def run(rows, answers):
        parts = [[read(x.as_py()) for x in answers.column(k)] for k, read in (("codes", unpack_codes), ("values", from_planes), ("rests", from_planes))]
        order = sorted(range(len(parts[0])), key=lambda k: parts[0][k][0])  # each has a span of the codes
        mine = Answers(*(np.concatenate([np.zeros(0, np.uint64), *(part[k] for k in order)]) for part in parts))
        del parts
        n, seen, base, score = [], [], [], []
        pieces = [x for chunk in rows.column("text").chunks for x in token_pieces(chunk)]
        words = in_words(np.concatenate([np.zeros(0, np.uint64), *(tokens for _, tokens, _ in pieces)]), mine)
        for _, tokens, starts in pieces:
            at = words.find(tokens)
            c = words.value[at]
            p = (c + 1) / (total + vocabulary + 1)
            n.append(np.diff(starts)), seen.append(np.add.reduceat((c > 0).astype(np.int64), starts[:-1]))
            base.append(np.add.reduceat(np.log10(p), starts[:-1]))
            score.append(np.add.reduceat(np.log10(in_states(tokens, places(starts), p, words.rest[at], mine, options, asked.value)), starts[:-1]))
        put = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        n = put(n, np.int64)
        return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": n, "n_known": put(seen, np.int64), "train_tokens": np.full(len(n), total, np.int64), "base_score": put(base, float), "score": put(score, float)})

    return dealt.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, out)


def op2_suffix_lm(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    options = TreeOptions()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_bucket(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"))
    split = docs.withColumn("bucket", split_bucket(options))
    training = docs.where(~F.col("held_out"))
    counts = materialise(count_words(training))
    tree = grow_tree(training, counts, options, keep=False)
    release(counts)
    tidy(spark)
    # Each round has its questions and answers on disk, and they go before the next.
    scored = None
    for k in range(options.score_rounds):
        mine = split.where(F.pmod(F.xxhash64("bucket"), F.lit(options.score_rounds)) == k)
        part = materialise(score_texts(mine, counts, tree))
        tidy(spark)
        scored = part if scored is None else scored.unionByName(part)
    release(tree.facts)
    return scored


__all__ = ["TreeOptions", "SuffixTree", "count_words", "grow_tree", "score_texts", "op2_suffix_lm", "word_id"]
