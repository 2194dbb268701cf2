"""Notations of edits and targets as columns. Text that no form fits is an error of the row that holds it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES, _NAME = "([ACGTUacgtu]+)", "([A-Za-z0-9_]+)"
#: kind: pattern, and the groups of chrom, first position, last position, ref, alt (0: none).
FORMS = {
    "substitution": [(rf"^\s*{_BASES}\s*>\s*{_BASES}\s+at\s+{_NAME}:(\d+)(?:\.\.(\d+))?\s*$", (3, 4, 5, 1, 2)), (rf"^\s*{_NAME}:g\.(\d+){_BASES}>{_BASES}\s*$", (1, 2, 0, 3, 4))],
    "insertion": [(rf"^\s*ins{_BASES}\s+at\s+{_NAME}:(\d+)\s*$", (2, 3, 0, 0, 1))],
    "replacement": [(rf"^\s*{_NAME}:g\.(\d+)(?:_(\d+))?delins{_BASES}\s*$", (1, 2, 3, 0, 4))],
    "deletion": [(rf"^\s*del\s+{_NAME}:(\d+)\.\.(\d+)\s*$", (1, 2, 3, 0, 0)), (rf"^\s*{_NAME}:g\.(\d+)(?:_(\d+))?del\s*$", (1, 2, 3, 0, 0))],
    "duplication": [(rf"^\s*{_NAME}:g\.(\d+)(?:_(\d+))?dup\s*$", (1, 2, 3, 0, 0))],
}


def _each(text: Column, read) -> Column:
    """read(text), as one value that later columns share instead of repeating its long expression."""
    return F.transform(F.array(text), read)[0]


def edit_fields(notation: Column, most: int = 50) -> Column:
    """struct<kind,chrom,start,end,ref,alt> of an edit, 0-based and half-open: ``C>T at chr1:100``,
    ``AC>GT at chr1:100..101``, ``insACG at chr1:100`` (before that base), ``del chr1:100..104``, and ``chr1:g.`` with
    ``100C>T``, ``100_104del``, ``100_104delinsAC`` or ``100_104dup``. ref is null where the notation leaves it to the
    sequence. Other forms, spans that don't fit their alleles, and edits of more than ``most`` bases are errors."""
    return _each(notation, lambda n: _edit(n, most))


def _edit(notation: Column, most: int) -> Column:
    out = F.lit(None)
    for kind, forms in FORMS.items():
        for pattern, (chrom, first, last, ref, alt) in forms:
            part = lambda i: F.regexp_extract(notation, pattern, i) if i else F.lit("")  # noqa: B023, E731
            dna = lambda i: F.translate(F.upper(part(i)), "U", "T")  # noqa: B023, E731
            start = part(first).cast("long") - 1
            end = start if kind == "insertion" else F.coalesce(F.nullif(part(last), F.lit("")).cast("long"), start + 1)
            ref_text = dna(ref) if ref or kind == "insertion" else F.lit(None).cast("string")
            fields = F.struct(F.lit(kind).alias("kind"), part(chrom).alias("chrom"), start.alias("start"), end.alias("end"), ref_text.alias("ref"), dna(alt).alias("alt"))
            size = F.greatest(end - start, F.length(dna(alt)))
            wrong = (start < 0) | (end < start) | (size > most)
            if kind != "insertion":
                wrong = wrong | (end == start)
            if ref:
                wrong = wrong | (F.length(ref_text) != end - start)
            out = F.when(notation.rlike(pattern), F.when(wrong, F.raise_error(F.concat(F.lit("edit out of range: "), notation))).otherwise(fields)).otherwise(out)
    known = F.lit(False)
    for forms in FORMS.values():
        for pattern, _ in forms:
            known = known | notation.rlike(pattern)
    return F.when(notation.isNull(), F.lit(None)).when(~known, F.raise_error(F.concat(F.lit("not an edit: "), notation))).otherwise(out)


def target_fields(target: Column, flank: int = 0) -> Column:
    """struct<chrom,start,end> of ``chr1:1,001-2,000`` (1-based, both ends inside) as 0-based and half-open, widened by
    ``flank`` on both sides but not below 0."""
    return _each(target, lambda t: _target(t, flank))


def _target(target: Column, flank: int) -> Column:
    pattern = r"^\s*([^:\s]+):([\d,]+)-([\d,]+)\s*$"
    number = lambda i: F.replace(F.regexp_extract(target, pattern, i), F.lit(","), F.lit("")).cast("long")
    fields = F.struct(F.regexp_extract(target, pattern, 1).alias("chrom"), F.greatest(number(2) - 1 - flank, F.lit(0)).alias("start"), (number(3) + flank).alias("end"))
    right = F.when(target.rlike(pattern), (number(2) >= 1) & (number(3) >= number(2))).otherwise(False)
    return F.when(target.isNull(), F.lit(None)).when(~right, F.raise_error(F.concat(F.lit("not a target: "), target))).otherwise(fields)
