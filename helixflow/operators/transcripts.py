"""Variants in the notation of transcripts and genomes, put on the forward strand of chromosomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement

_HEAD, _DNA = r"^\s*(?:([A-Za-z0-9_.]+):)?([gcm])\.", "([ACGTUacgtu]+)"
#: kind: pattern behind the prefix, and the groups of last position, ref, alt (0: none); group 3 is the first position.
VARIANTS = {
    "substitution": (rf"(\d+)([ACGTUacgtu])>([ACGTUacgtu])\s*$", (0, 4, 5)),
    "replacement": (rf"(\d+)(?:_(\d+))?del([ACGTUacgtu]*)ins{_DNA}\s*$", (4, 5, 6)),
    "deletion": (rf"(\d+)(?:_(\d+))?del([ACGTUacgtu]*)\s*$", (4, 5, 0)),
    "duplication": (rf"(\d+)(?:_(\d+))?dup([ACGTUacgtu]*)\s*$", (4, 5, 0)),
}


def variant_fields(notation: Column, most: int = 50) -> Column:
    """struct<kind,accession,flavor,first,last,ref,alt> of ``chr1:g.100C>T``, ``NM_1.2:c.5_7delinsAC``, ``m.8dupA`` and the
    like: positions are 1-based with both ends inside, ref is null where it is left out, an accession loses its version. Inversions, sets of alleles, uncertain
    positions, genomic positions by accession (NC_, NM_, NR_), transcript positions without one, refs of another length than
    their span and edits of more than ``most`` bases are errors."""

    def one(n: Column) -> Column:
        out = F.lit(None)
        for kind, (tail, (last, ref, alt)) in VARIANTS.items():
            pattern = _HEAD + tail
            part = lambda i: F.regexp_extract(n, pattern, i) if i else F.lit("")  # noqa: B023, E731
            dna = lambda i: F.translate(F.upper(part(i)), "U", "T")  # noqa: B023, E731
            first = part(3).cast("long")
            stop = F.coalesce(F.nullif(part(last), F.lit("")).cast("long"), first)
            accession, flavor = part(1), part(2)
            name = F.when(flavor == "m", "chrM").when(flavor == "c", F.substring_index(accession, ".", 1)).when(accession == "", "chr1").otherwise(accession)
            wrong = (first < 1) | (stop < first) | (F.greatest(stop - first + 1, F.length(dna(alt))) > most)
            wrong = wrong | ((dna(ref) != "") & (F.length(dna(ref)) != stop - first + 1)) | ((flavor == "c") & (accession == "")) | ((flavor == "g") & F.lower(accession).rlike("^n[cmr]_"))
            fields = F.struct(F.lit(kind).alias("kind"), name.alias("accession"), flavor.alias("flavor"), first.alias("first"), stop.alias("last"), F.nullif(dna(ref), F.lit("")).alias("ref"), dna(alt).alias("alt"))
            out = F.when(n.rlike(pattern), F.when(wrong, F.raise_error(F.concat(F.lit("variant out of range: "), n))).otherwise(fields)).otherwise(out)
        known = F.lit(False)
        for tail, _ in VARIANTS.values():
            known = known | n.rlike(_HEAD + tail)
        return F.when(n.isNull(), F.lit(None)).when(~known, F.raise_error(F.concat(F.lit("not a variant: "), n))).otherwise(out)

    return F.transform(F.array(notation), one)[0]


def exon_spans(transcripts: DataFrame) -> DataFrame:
    """accession, chrom, strand, low, high (0-based positions of the transcript, half-open), at (0-based position on the
    chromosome of ``low``) for each exon. Prefix sums of exon lengths from the 5' end; a transcript without exons is
    one exon from its 5' end on, without an end."""
    whole = F.coalesce(F.size("exon_starts"), F.lit(0)) < 1
    minus = F.col("strand") == "-"
    pairs = F.array_sort(F.transform(F.arrays_zip("exon_starts", "exon_ends"), lambda e: F.struct(e["exon_starts"].alias("a"), e["exon_ends"].alias("b"))))
    ordered = F.when(minus, F.reverse(pairs)).otherwise(pairs)
    rows = transcripts.select(F.substring_index("refseq_id", ".", 1).alias("accession"), "chrom", "strand", "start", "end", whole.alias("whole"), F.when(~whole, ordered).alias("exons"))
    size = F.transform("exons", lambda e: e["b"] - e["a"])
    rows = rows.withColumn("lengths", size)
    spans = F.transform("exons", lambda e, i: F.struct(F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x).alias("low"), e["a"].alias("a"), e["b"].alias("b")))
    single = F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("start") - 1).alias("a"), F.col("end").alias("b")))
    out = rows.select("accession", "chrom", "strand", "whole", F.explode(F.when(F.col("whole"), single).otherwise(spans)).alias("e"))
    high = F.when(F.col("whole"), F.lit((1 << 62))).otherwise(F.col("e.low") + F.col("e.b") - F.col("e.a"))
    return out.select("accession", "chrom", "strand", F.col("e.low").alias("low"), high.alias("high"), F.when(F.col("strand") == "-", F.col("e.b") - 1).otherwise(F.col("e.a")).alias("at"))


def on_genome(variants: DataFrame, transcripts: DataFrame, column: str = "v") -> DataFrame:
    """variants (``column`` of variant_fields, others) with kind, chrom, start, end (0-based, half-open), ref and alt on the
    forward strand. Positions of transcripts (flavor c) are found among the exons of their accession, of which one must hold the
    whole span; unknown accessions, and spans beyond or across exons, are errors. On minus transcripts alleles are
    reversed and complemented."""
    others = [c for c in variants.columns if c != column]
    v = lambda c: F.col(f"{column}.{c}")
    spans = exon_spans(transcripts).withColumnRenamed("accession", "_accession")
    met = variants.join(spans, (v("flavor") == "c") & (v("accession") == F.col("_accession")) & (v("first") - 1 >= F.col("low")) & (v("last") <= F.col("high")), "left")
    moved, minus = F.col("at").isNotNull(), F.coalesce(F.col("strand") == "-", F.lit(False))
    lost = (v("flavor") == "c") & ~moved
    begin = F.when(~moved, v("first") - 1).when(minus, F.col("at") - (v("last") - 1 - F.col("low"))).otherwise(F.col("at") + v("first") - 1 - F.col("low"))
    chrom = F.when(lost, F.raise_error(F.concat(F.lit("no exon holds the variant: "), v("accession"), F.lit(":c."), v("first").cast("string"))).cast("string")).when(moved, F.col("chrom")).otherwise(v("accession"))
    turned = lambda c: F.when(minus, reverse_complement(v(c))).otherwise(v(c)).alias(c)
    return met.select(*others, v("kind").alias("kind"), chrom.alias("chrom"), begin.alias("start"), (begin + v("last") - v("first") + 1).alias("end"), turned("ref"), turned("alt"))
