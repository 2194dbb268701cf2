"""Exact token counts of a unigram tokenizer without building tokens.

Aho-Corasick enumerates the vocabulary's matches that end at each character; dynamic programming carries the best score
and its number of pieces. Ties go to the earliest start, as in the tokenizer's own lattice search, which replaces a path
only by a strictly better one and meets starts from left to right. A character without a piece of its own costs the
least score minus 10 and counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MARK = "▁"
UNKNOWN_COST = 10.0


class PieceCounter(dict):
    """Counts by unit: a dict of those met so far, up to ``bound``, that fills itself."""

    def __init__(self, pieces: list[tuple[str, float]], bound: int = 400_000):
        import ahocorasick

        super().__init__()
        self.bound = bound
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COST
        alphabet = {c for p, _ in pieces for c in p}
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece goes on after a word's end; units cannot be counted on their own")
        # No piece crosses from a letter to a mark, or touches a character outside the alphabet: units end there.
        self.apart = "".join(c for c in "\n\t\r" if c not in alphabet)
        self.units = re.compile(f"[{self.apart}]|{MARK}*[^{MARK}{self.apart}]+|{MARK}+" if self.apart else f"{MARK}*[^{MARK}]+|{MARK}+")

    def __missing__(self, unit: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        n = self[unit] = self.count_unit(unit)
        return n

    def count_unit(self, unit: str) -> int:
        best, pieces = [0.0], [0]
        end, top, at, own = 0, 0.0, 0, True
        # Matches come by their ends, and at one end the longest, which starts first, comes first.
        for last, (length, score) in self.automaton.iter(unit):
            while end <= last:
                if end:
                    self._close(unit, end, top, at, own, best, pieces)
                end += 1
                top, at, own = None, 0, False
            own |= length == 1
            path = best[end - length] + score
            if top is None or path > top:
                top, at = path, pieces[end - length] + 1
        while end <= len(unit):
            if end:
                self._close(unit, end, top, at, own, best, pieces)
            end += 1
            top, at, own = None, 0, False
        return pieces[len(unit)]

    def _close(self, unit, end, top, at, own, best, pieces) -> None:
        """Fix the best path to ``end``; where no piece is its last character, that may be an unknown one."""
        if not own:
            path = best[end - 1] + self.unknown
            if top is None or path > top:
                top, at = path, pieces[end - 1] + len(unit[end - 1].encode())
        best.append(top)
        pieces.append(at)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.units.findall(MARK + text.replace(" ", MARK))))


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a SentencePiece file and their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with ``name``: the pieces of each whole text under the file's vocabulary and scores, read as a unigram
    model. Null and empty texts have none. A column of that name is replaced; repeated rows are counted alike."""
    import pyarrow as pa

    own = [c for c in docs.columns if c != name]
    schema = docs.select(*own).schema.add(name, T.LongType())

    def run(batches):
        counter = PieceCounter(load_pieces(vocabulary))
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(counts, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op8_token_count(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, default_vocabulary()).select("doc_id", "n_tokens", F.length("text").cast("long").alias("n_chars"))
