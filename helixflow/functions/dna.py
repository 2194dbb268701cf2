"""Column functions on DNA strings (A, C, G, T and N), all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN"
#: IUPAC codes as character classes (fixed values).
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}


def dna_view(text: Column) -> Column:
    """The letters A-Z of a text, upper-cased and mapped onto bases; Z gives N."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement; string order equals packed order as A < C < G < T."""
    return F.least(kmer, reverse_complement(kmer))


def pack(kmer: Column) -> Column:
    """Two bits a base as a long, for 1 to 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(value: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def hamming(x: Column, y: Column) -> Column:
    """Mismatches between two packed strings of up to 31 bases."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x5555555555555555))).cast("int")


def iupac_regex(pattern: str) -> str:
    """An anchored regex for a pattern of 1 to 8 IUPAC codes."""
    if not 1 <= len(pattern) <= 8 or any(c not in IUPAC for c in pattern):
        raise ValueError(f"not an IUPAC pattern of 1 to 8 codes: {pattern!r}")
    return "^" + "".join(IUPAC[c] for c in pattern) + "$"


def count_of(seq: Column, bases: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, bases, ""))


def gc_fraction(seq: Column) -> Column:
    """G and C of the unambiguous bases; 0 where there are none."""
    known = count_of(seq, "ACGT")
    return F.when(known > 0, count_of(seq, "CG") / known).otherwise(0.0)


def gc_percent(seq: Column) -> Column:
    """G and C of the whole length, in percent."""
    return F.when(F.length(seq) > 0, count_of(seq, "CG") * 100.0 / F.length(seq)).otherwise(0.0)


def n_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, count_of(seq, "N") / F.length(seq)).otherwise(0.0)


def homopolymer_run(seq: Column) -> Column:
    runs = F.regexp_extract_all(seq, F.lit("(A+|C+|G+|T+|N+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def entropy(seq: Column) -> Column:
    """Bits a base over A, C, G and T."""
    known = count_of(seq, "ACGT")
    parts = F.lit(0.0)
    for b in "ACGT":
        share = count_of(seq, b) / known
        parts = parts - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return F.when(known > 0, parts).otherwise(0.0)


def kmer_tokens(seq: Column, k: int = 3) -> Column:
    """All k-mers, separated by spaces; empty where the sequence is shorter."""
    n = F.length(seq) - k + 1
    return F.coalesce(F.array_join(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: seq.substr(i, F.lit(k)))), " "), F.lit(""))
