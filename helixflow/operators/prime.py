"""Prime-editing candidates: PAM sites x primer-binding lengths x template lengths, pruned before each explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from .matching import band_join

#: The common SpCas9 guide scaffold (fixed value).
SCAFFOLD = "GTTTTAGAGCTAGAAATAGCAAGTTAAAATAAGGCTAGTCCGTTATCAACTTGAAAAAGTGGCACCGAGTCGGTGC"


def rna(seq: Column) -> Column:
    return F.translate(F.upper(seq), "T", "U")


def local_edits(edits: DataFrame, seqs: DataFrame, key: str, flank: int = 100) -> DataFrame:
    """edits (key, start, ref, alt) with the sequence around them, read on both strands.

    Adds strand, origin (plus-strand start of the context), size, at (edit start in the oriented context), r, a
    (oriented alleles) and ctx. Contexts are cut before anything else, so a long sequence travels once.
    """
    joined = edits.join(seqs.select(key, "seq"), key)
    origin = F.greatest(F.col("start") - flank, F.lit(0)).cast("int")
    cut = joined.withColumn("origin", origin).withColumn("ctx", F.col("seq").substr(F.col("origin") + 1, (F.col("start") - F.col("origin") + F.length("ref") + flank).cast("int"))).drop("seq").withColumn("size", F.length("ctx"))
    here = (F.col("start") - F.col("origin")).cast("int")
    plus = F.struct(F.lit("+").alias("strand"), here.alias("at"), F.upper("ref").alias("r"), F.upper("alt").alias("a"), F.col("ctx").alias("ctx"))
    minus = F.struct(F.lit("-").alias("strand"), (F.col("size") - here - F.length("ref")).cast("int").alias("at"), reverse_complement(F.upper("ref")).alias("r"), reverse_complement(F.upper("alt")).alias("a"), reverse_complement(F.col("ctx")).alias("ctx"))
    rows = cut.withColumn("o", F.explode(F.array(plus, minus))).drop("ctx")
    return rows.select("*", "o.*").drop("o")


def enumerate_pe2(edits: DataFrame, seqs: DataFrame, key: str, pbs: tuple[int, int] = (8, 15), rtt: tuple[int, int] = (10, 30), scaffold: str = SCAFFOLD, flank: int = 100) -> DataFrame:
    """Every candidate for edits (key, start, ref, alt; one context each): strand, spacer, pam, pbs, rtt, nick (on the
    plus strand), edit_in_rtt.

    A site is NGG, its nick lies before the edit, and an edit inside the PAM must destroy it. The template covers the
    edit and is five bases longer at least; no part holds N, no unit or junction holds UUUU, and the whole has 25 to
    75 % G and C.
    """
    rows = local_edits(edits, seqs, key, flank)
    edited = F.concat(F.substring(F.col("ctx"), 1, 0), F.col("ctx").substr(F.lit(1), F.col("at")), F.col("a"), F.col("ctx").substr(F.col("at") + F.length("r") + 1, F.col("size")))
    rows = rows.withColumn("edited", edited).where(F.col("size") >= 23)
    p = F.col("pam_at")
    sites = rows.withColumn("pam_at", F.explode(F.filter(F.sequence(F.lit(20), F.col("size") - 3), lambda i: F.col("ctx").substr(i + 2, F.lit(2)) == "GG")))
    insertion = F.length("r") == 0
    end = F.col("at") + F.length("r")
    nick = p - 3
    sites = sites.withColumns({"pam": F.col("ctx").substr(p + 1, F.lit(3)), "spacer": F.col("ctx").substr(p - 19, F.lit(20)), "nick_at": nick})
    in_pam = ((F.col("at") < p + 3) & (end > p)) | (insertion & (p <= F.col("at")) & (F.col("at") < p + 3))
    sites = sites.where(F.col("pam").rlike("^[ACGT]GG$") & ~F.col("spacer").contains("N") & (F.col("at") >= nick) & ((end > nick) | (insertion & (F.col("at") == nick))) & ~(in_pam & F.col("edited").substr(p + 1, F.lit(3)).rlike("^[ACGT]GG$")))
    offset = F.col("at") - F.col("nick_at")
    floor = F.greatest(F.length("r"), F.length("a")) + 5
    low = F.greatest(F.lit(rtt[0]), floor, offset + F.greatest(F.length("a"), F.lit(1)))
    high = F.least(F.lit(rtt[1]), F.length("edited") - F.col("nick_at"))
    long = sites.where(low <= high).withColumn("rtt_length", F.explode(F.sequence(low, high)))
    long = long.withColumn("product", F.col("edited").substr(F.col("nick_at") + 1, F.col("rtt_length"))).where(~F.col("product").contains("N"))
    both = long.withColumn("pbs_length", F.explode(F.sequence(F.lit(pbs[0]), F.lit(pbs[1])))).where(F.col("nick_at") >= F.col("pbs_length"))
    both = both.withColumn("before", F.col("ctx").substr(F.col("nick_at") - F.col("pbs_length") + 1, F.col("pbs_length"))).where(~F.col("before").contains("N"))
    both = both.withColumns({"pbs": rna(reverse_complement(F.col("before"))), "rtt": rna(reverse_complement(F.col("product"))), "s": rna(F.col("spacer"))})
    scaffold = scaffold.upper().replace("T", "U")
    joints = F.concat_ws("|", F.concat(F.substring("s", 18, 3), F.lit(scaffold[:3])), "s", "rtt", "pbs", F.concat(F.lit(scaffold[-3:]), F.substring("rtt", 1, 3)))
    parts = F.concat("s", "rtt", "pbs")
    gc = (F.length(parts) - F.length(F.translate(parts, "CG", "")) + sum(c in "CG" for c in scaffold)) / (F.length(parts) + len(scaffold))
    kept = both.where(~joints.contains("UUUU") & (gc >= 0.25) & (gc <= 0.75))
    place = F.when(F.col("strand") == "+", F.col("origin") + F.col("nick_at")).otherwise(F.col("origin") + F.col("size") - F.col("nick_at"))
    return kept.select(key, "start", "strand", "spacer", "pam", "pbs_length", "rtt_length", "pbs", "rtt", place.cast("long").alias("nick"), (F.col("rtt_length") - 1 - offset).alias("edit_in_rtt"))


def applied_edits(edits: DataFrame, seqs: DataFrame, key: str) -> DataFrame:
    """edits (chrom and the other fields of edit_fields) joined to seqs (key, seq) by name, with ref and alt in full and
    ``edited``, the sequence after the edit. A stated ref that the sequence does not hold, or a span beyond its end, is an
    error; edits of unknown sequences have no row."""
    rows = edits.join(seqs.select(F.col(key).alias("chrom"), "seq"), "chrom")
    held = F.upper(F.col("seq").substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    rows = rows.withColumn("held", held)
    wrong = (F.col("end") > F.length("seq")) | (F.col("ref") != F.col("held"))
    rows = rows.withColumn("ref", F.when(F.coalesce(wrong, F.col("end") > F.length("seq")), F.raise_error(F.concat(F.lit("the sequence does not hold the edit's ref: "), F.col("chrom")))).otherwise(F.col("held")))
    rows = rows.withColumn("alt", F.when(F.col("kind") == "duplication", F.concat("ref", "ref")).otherwise(F.col("alt")))
    after = F.concat(F.col("seq").substr(F.lit(1), F.col("start").cast("int")), F.col("alt"), F.col("seq").substr((F.col("end") + 1).cast("int"), F.length("seq")))
    return rows.withColumn("edited", after).drop("held", "seq")


def nicking_guides(nicks: DataFrame, sites: DataFrame, keys: list[str], low: int = 40, high: int = 100) -> DataFrame:
    """For nicks (keys, strand, nick, edit_start, edit_end) the guides of the other strand among sites (pam_sites) that nick
    ``low`` to ``high`` bases away and outside the edit: nicks' columns, nicking_spacer, nicking_site, distance and rank,
    the nearest first, then by spacer and place."""
    cut = F.when(F.col("strand") == "+", F.col("start") + 17).otherwise(F.col("start") + 6)
    others = sites.select(*keys, F.col("strand").alias("other"), cut.alias("nicking_site"), F.col("site").substr(1, 20).alias("nicking_spacer"))
    pairs = band_join(nicks, others, keys, "nick", "nicking_site", low, high).where("strand <> other and not (nicking_site >= edit_start and nicking_site < edit_end)")
    pairs = pairs.withColumn("distance", F.abs(F.col("nick") - F.col("nicking_site")).cast("long")).drop("other")
    own = Window.partitionBy(*keys, "strand", "nick", "edit_start", "edit_end").orderBy("distance", "nicking_spacer", "nicking_site")
    return pairs.withColumn("rank", F.row_number().over(own).cast("long"))
