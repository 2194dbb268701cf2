"""Positions of motifs: PAMs, primers, methylation contexts, guide candidates, editing windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import IUPAC, entropy, gc_fraction, homopolymer_run, iupac_regex, n_fraction
from .windows import CODE, COMPLEMENT, choice, scan, strings


def _fits(pattern: str) -> np.ndarray:
    """For each place of an IUPAC pattern, which bytes fit it."""
    iupac_regex(pattern)  # checks it
    table = np.zeros((len(pattern), 256), bool)
    for i, c in enumerate(pattern):
        table[i, list(IUPAC[c].strip("[]").encode())] = True
    return table


def _matches(bases: np.ndarray, table: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """Of the first n windows: whether the bytes from ``start`` on fit."""
    out = np.ones(n, bool)
    for i, row in enumerate(table):
        out &= row[bases[start + i : start + i + n]]
    return out


def pam_hits(seqs: DataFrame, pam: str, ids: list[str]) -> DataFrame:
    """ids, pos, strand (0) of every forward window, overlapping ones too, that an IUPAC pattern fits."""
    table = _fits(pam)

    def kernel(piece):
        on = piece.owns(len(pam))
        where = np.flatnonzero(on & _matches(piece.bases, table, len(on)))
        return where, piece.pos(where)

    return scan(seqs, ids, len(pam), kernel, "pos long").select(*ids, "pos", F.lit(0).alias("strand"))


def primer_hits(seqs: DataFrame, primer: str, ids: list[str], both: bool = True) -> DataFrame:
    """ids, pos, strand: 0 where the window is the primer, else 1 where it is its reverse complement."""
    if not primer or set(primer) - set("ACGT"):
        raise ValueError("a primer has the bases A, C, G and T alone")
    fore, back = np.zeros((2, len(primer), 256), bool)
    for i, c in enumerate(primer.encode()):
        fore[i, c] = back[len(primer) - 1 - i, COMPLEMENT[c]] = True

    def kernel(piece):
        on = piece.owns(len(primer))
        first = on & _matches(piece.bases, fore, len(on))
        hit = first | on & _matches(piece.bases, back, len(on)) if both else first
        where = np.flatnonzero(hit)
        return where, piece.pos(where), (~first[where]).astype(np.int32)

    return scan(seqs, ids, len(primer), kernel, "pos long, strand int")


def methylation_contexts(seqs: DataFrame, ids: list[str]) -> DataFrame:
    """ids, pos, strand, context, motif of every cytosine on either strand whose context is known.

    CG before a G; else CHG or CHH, which need two more bases. On the minus strand the context is read from the
    reverse complement. Upper-cases; edges and other letters are left out.
    """
    padded = seqs.select(*ids, F.concat(F.lit("  "), F.upper("seq"), F.lit("  ")).alias("seq"))
    motifs = [f"C{a}{b}" for a in "ACGT" for b in "ACGT"]

    def kernel(piece):
        on = piece.owns(5)
        n = len(on)
        code = CODE[piece.bases]
        centre = code[2 : 2 + n]
        plus = centre == 1
        # The next two bases as the strand of the cytosine reads them; 4 where one is no base.
        flip = lambda x: np.where(x < 4, 3 - x, 4).astype(np.uint8)
        one, two = np.where(plus, code[3 : 3 + n], flip(code[1 : 1 + n])), np.where(plus, code[4 : 4 + n], flip(code[:n]))
        where = np.flatnonzero(on & (plus | (centre == 2)) & ((one == 2) | ((one < 4) & (two < 4))))
        one, two = one[where].astype(np.int32), two[where].astype(np.int32)
        cg = one == 2
        context = np.where(cg, 0, np.where(two == 2, 1, 2))
        motif = np.where(cg, 16, 4 * one + two)
        return where, piece.pos(where), choice(["+", "-"], ~plus[where]), choice(["CG", "CHG", "CHH"], context), choice([*motifs, "CG"], motif)

    return scan(padded, ids, 5, kernel, "pos long, strand string, context string, motif string")


def rejections(spacer: Column, low: float = 0.40, high: float = 0.70, most_n: float = 0.0, run: int = 4, least_entropy: float = 1.2) -> Column:
    """Reasons against a spacer, in fixed order."""
    tests = (("n_content", n_fraction(spacer) > most_n), ("low_gc", gc_fraction(spacer) < low), ("high_gc", gc_fraction(spacer) > high), ("homopolymer", homopolymer_run(spacer) > run), ("low_complexity", entropy(spacer) < least_entropy))
    return F.array_compact(F.array(*[F.when(t, name) for name, t in tests]))


def stranded_windows(seqs: DataFrame, ids: list[str], width: int, table: np.ndarray, name: str) -> DataFrame:
    """ids, pos, strand and ``name``, the window as its strand reads it, where that fits the table of a pattern."""
    back = np.zeros_like(table)
    back[:, COMPLEMENT[list(b"ACGT")]] = table[::-1][:, list(b"ACGT")]

    def kernel(piece):
        on = piece.owns(width)
        # The pattern's rarer end first: few windows are left for the other places.
        sides = []
        for rows in (table, back):
            where = np.flatnonzero(on)
            for i in np.argsort(rows.sum(axis=1), kind="stable"):
                where = where[rows[i, piece.bases[where + i]]]
            sides.append(where)
        where = np.concatenate(sides)
        minus = np.arange(len(where)) >= len(sides[0])
        return where, piece.pos(where), choice(["+", "-"], minus), strings(piece.bases, where, width, minus)

    return scan(seqs, ids, width, kernel, f"pos long, strand string, {name} string")


def guide_candidates(seqs: DataFrame, ids: list[str], spacer: int = 20, pam: str = "NGG") -> DataFrame:
    """ids, pos (window start), strand, guide (spacer and PAM as read on its strand), reasons; both strands."""
    rows = stranded_windows(seqs, ids, spacer + len(pam), np.concatenate([*[_fits("N")] * spacer, _fits(pam)]), "guide")
    return rows.withColumn("reasons", rejections(F.col("guide").substr(1, spacer)))


def editing_targets(guides: DataFrame, base: str, first: int, last: int) -> DataFrame:
    """guides with targets (0-based positions of ``base`` in the activity window), in_window and bystanders.

    first and last are 1-based from the PAM-distal end; the first target is edited, the others are bystanders.
    """
    at = F.filter(F.sequence(F.lit(first - 1), F.lit(last - 1)), lambda i: F.col("guide").substr(i + 1, F.lit(1)) == base)
    n = F.size("targets")
    return guides.withColumn("targets", at).withColumn("in_window", n > 0).withColumn("bystanders", F.greatest(n - 1, F.lit(0)))
