"""Registered queries of searches, comparisons and tables that several operators take part in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, design, kmers, matching, prime, ranking, seeds, transcripts, trimming
from ..sources import genes, kmer_tables, reports, results, sequences as files, splits
from .storage import scratch
from .tables import guides, items, reads, sequences, table


def seed_prefilter_mismatch(spark, sf_dir):
    """Sites whose last 12 bases are within two mismatches of a guide's."""
    hits = seeds.seed_search(seeds.protospacers(sequences(spark, sf_dir), ["doc_id"]), guides(spark, sf_dir), 12, 2)
    return hits.select("guide_id", "doc_id", "position", "strand", "pam", "target_seed", F.col("seed_mismatches").cast("long").alias("seed_mismatches"), F.array_join(F.transform("seed_mismatch_positions", lambda i: i.cast("string")), ",").alias("at"), "seed_hit_count")


def guide_rollup(spark, sf_dir):
    """The guides of benchmark items that no rule rejects, with their seed hits in documents at one mismatch."""
    every, hits = seeds.design_guides(items(spark, sf_dir), sequences(spark, sf_dir), ["item_id"], "doc_id", 12, 1)
    rows = seeds.seed_rollup(every.where(F.size("reasons") == 0), hits, "doc_id")
    names = F.array_join(F.transform("references", lambda i: i.cast("string")), ",")
    return rows.select("guide_id", "seed_hit_count", "exact_seed_hit_count", "mismatched_seed_hit_count", F.size("references").cast("long").alias("n_references"), F.md5(names).alias("references_md5"))


def record_agreement(spark, sf_dir):
    """Reads trimmed by an adapter and by a longer one, compared record by record in the order of the table."""
    trimmed = lambda a: trimming.trim_reads(reads(spark, sf_dir), a).select("conv_id", "turn", "role", "seq")
    return agreement.record_agreement(trimmed("TTACT"), trimmed("TTACTA"), ["conv_id", "turn", "role", "seq"])


def score_agreement(spark, sf_dir):
    """Scores of hits as they are, and as a table with six decimals gives them back."""
    from . import catalog
    from ..sources import scores

    rows = catalog.mismatch_scores(spark, sf_dir)
    order = ["doc_id", "start", "guide_id", "strand"]
    back = rows.withColumn("score", scores.fixed(F.col("score")).cast("double"))
    out = agreement.score_agreement(rows, back, order, order, epsilon=1e-6)
    return out.withColumn("max_abs_diff", F.round("max_abs_diff", 9))


def score_lines(spark, sf_dir):
    """The score tables' lines for all hits."""
    from . import catalog
    from ..operators import matching
    from ..sources import scores

    rows = catalog._scored(spark, sf_dir)
    named = rows.select(F.col("guide_id"), F.lit("X").alias("bulge_type"), F.concat("spacer", F.lit("NGG")).alias("crrna"), matching.marked_site(F.col("site"), F.col("spacer")).alias("dna"), F.col("doc_id").cast("string").alias("chrom"), "start", "strand", "mismatches", F.lit(0).alias("bulge_size"), "score")
    return named.select(scores.score_line().alias("line"))


def fasta_ranges(spark, sf_dir):
    """All sequences written as FASTA in lines of 60 bases, and the middle third of each read back from byte ranges."""
    seqs = sequences(spark, sf_dir).where(F.length("seq") >= 3)
    path = scratch(spark, "fasta")
    seqs.select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" document\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")).alias("value")).write.text(path)
    third = F.floor(F.length("seq") / 3)
    asked = seqs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("contig"), third.alias("start"), (2 * third).alias("end"))
    return splits.sliced(splits.fasta_blocks(spark, path, 1 << 20), asked).select("contig", "start", "end", F.md5("seq").alias("slice_md5"))


def fastq_ranges(spark, sf_dir):
    """All reads written as FASTQ and read back from byte ranges."""
    path = scratch(spark, "fastq")
    named = reads(spark, sf_dir).withColumn("header", F.concat_ws(":", "conv_id", "turn", "role"))
    files.fastq_lines(named).write.text(path)
    rows = splits.read_fastq_ranges(spark, path, 1 << 18)
    return rows.select("read_id", F.length("seq").cast("long").alias("bases"), F.length("qual").cast("long").alias("qualities"), F.md5("seq").alias("seq_md5"))


def gene_targets(spark, sf_dir):
    """A browser's gene table written from the documents, and symbols and coordinates looked up in it."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n"))
    text = lambda *c: F.concat_ws("\t", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    d = F.col("doc_id")
    chrom = F.concat(F.lit("chr"), (d % 7).cast("string"), F.when(d % 11 == 0, "_alt").otherwise(""))
    line = text("0", F.concat(F.lit("NM_"), d.cast("string")), chrom, F.when(d % 2 == 0, "+").otherwise("-"), d * 13, d * 13 + F.col("n"), "0", "0", "0", "", "", "0", F.concat(F.lit("g"), (d % 97).cast("string")))
    path = scratch(spark, "genes")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    target = F.when(d % 3 == 0, F.concat(F.lit("chr"), (d % 7).cast("string"), F.lit(":"), F.format_number(d * 13 + 1, 0), F.lit("-"), F.format_number(d * 13 + 100, 0))).otherwise(F.concat(F.lit("G"), (d % 97).cast("string")))
    found = genes.resolved(docs.select("doc_id", target.alias("target")), genes.read_genes(spark, path), 100, strict=False)
    return found.select("doc_id", F.coalesce("chrom", F.lit("none")).alias("chrom"), F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"), F.coalesce("strand", F.lit("none")).alias("strand"), "label")


def transcript_edits(spark, sf_dir):
    """One variant of a transcript of three exons for every sequence of 40 bases or more, put on the sequence and applied."""
    n, d = F.col("n"), F.col("doc_id")
    seqs = sequences(spark, sf_dir).where("length(seq) >= 40 and doc_id is not null").select("doc_id", F.concat(F.lit("d"), d.cast("string")).alias("name"), F.translate("seq", "N", "A").alias("seq"), F.length("seq").cast("long").alias("n"))
    div = lambda x, k: F.floor(x / k)
    strand = F.when(d % 2 == 0, "+").otherwise("-")
    known = seqs.select(F.concat(F.lit("NM_"), d.cast("string"), F.lit(".1")).alias("refseq_id"), F.col("name").alias("chrom"), F.lit(1).cast("long").alias("start"), n.alias("end"), strand.alias("strand"), F.array(F.lit(0).cast("long"), div(n, 3), div(2 * n, 3)).alias("exon_starts"), F.array(div(n, 4), div(n, 2), n).alias("exon_ends"))
    first = F.when(d % 2 == 0, div(n, 4)).otherwise(n - div(2 * n, 3)) + 2
    at = F.when(d % 2 == 0, div(n, 3) + 2).otherwise(div(n, 2) - 1).cast("int")
    base = F.col("seq").substr(at, F.lit(1))
    ref = F.when(d % 2 == 0, base).otherwise(F.translate(base, "ACGT", "TGCA"))
    span = lambda k: F.concat(first.cast("string"), F.lit("_"), (first + k).cast("string"))
    forms = [F.concat(first.cast("string"), ref, F.lit(">"), F.translate(ref, "ACGT", "GTAC")), F.concat(span(1), F.lit("delinsACG")), F.concat(span(2), F.lit("del")), F.concat(span(1), F.lit("dup"))]
    notation = F.concat(F.lit("NM_"), d.cast("string"), F.lit(".7:c."), F.element_at(F.array(*forms), (d % 4 + 1).cast("int")))
    placed = transcripts.on_genome(seqs.select(transcripts.variant_fields(notation).alias("v")), known)
    return prime.applied_edits(placed, seqs, "name").select("chrom", "kind", "start", "end", "ref", "alt", F.md5("edited").alias("edited_md5"))


def pe_candidates(spark, sf_dir):
    """Candidates for a substitution in the middle of every benchmark item, as PE2 and with the nearest nicking guide as
    PE3. Efficiencies and folding come from stated rules, in place of learned scorers: callers give their own columns."""
    seqs = items(spark, sf_dir).where(F.length("seq") >= 23)
    at = F.floor(F.length("seq") / 2)
    ref = F.col("seq").substr((at + 1).cast("int"), F.lit(1))
    edits = seqs.select("item_id", at.alias("start"), ref.alias("ref"), F.translate(ref, "ACGTN", "GTACA").alias("alt"))
    rows = prime.enumerate_pe2(edits, seqs, "item_id")
    nicks = rows.select("item_id", "strand", "nick", F.col("start").alias("edit_start"), (F.col("start") + 1).alias("edit_end")).distinct()
    best = prime.nicking_guides(nicks, matching.pam_sites(seqs, ["item_id"]), ["item_id"]).where("rank = 1").select("item_id", "strand", "nick", "nicking_spacer")
    two = rows.withColumn("nicking_spacer", F.lit(None).cast("string"))
    both = two.unionByName(rows.join(best, ["item_id", "strand", "nick"]))
    gc = lambda c: F.length(c) - F.length(F.translate(c, "CG", ""))
    efficiency = F.when(F.col("rtt").startswith("C"), float("nan")).otherwise(50.0 + gc("pbs") - 2 * F.abs(F.col("pbs_length") - 13) - (F.col("rtt_length") - 10) / 10)
    return both.withColumn("efficiency", efficiency).withColumn("mfe", -1.5 * (gc("rtt") + gc("pbs")))


def pe_ranking(spark, sf_dir):
    """The 20 best prime-editing guides of each benchmark item, with off-targets among all documents."""
    from . import catalog

    candidates = pe_candidates(spark, sf_dir)
    hits = matching.off_targets(matching.pam_sites(sequences(spark, sf_dir), ["doc_id"]), ranking.spacers_of(candidates), 4)
    scored = hits.withColumn("score", catalog.scoring.mismatch_score(F.col("spacer"), F.col("site")))
    flagged = matching.flag_in_spans(scored, catalog.cpg_islands_w40(spark, sf_dir), ["doc_id"], "start", "in_island")
    off = ranking.split_specificity(flagged, "in_island")
    off = off.withColumns({c: F.round(c, 6) for c in ("specificity", "paralog_specificity")})
    rows = ranking.ranked_pegrnas(candidates, off, "item_id")
    known = F.when(F.isnan("composite"), -1e9).otherwise(F.round("composite", 6))
    return rows.select("item_id", F.col("rank").cast("long").alias("rank"), "pegrna_id", "spacer", "strategy", known.alias("composite"), "specificity", "off_targets", "paralog_specificity", "paralog_hits", F.coalesce("nicking_spacer", F.lit("")).alias("nicking_spacer"), F.coalesce("nicking_specificity", F.lit(-1.0)).alias("nicking_specificity"), F.coalesce("nicking_off_targets", F.lit(-1)).alias("nicking_off_targets"))


def pe_result_cells(spark, sf_dir):
    """The numbers of ``pe_ranking`` as cells of result tables."""
    rows = pe_ranking(spark, sf_dir)
    unknown = F.when(F.col("composite") < -1e8, float("nan")).otherwise(F.col("composite"))
    nicking = F.when(F.col("nicking_specificity") >= 0, F.col("nicking_specificity"))
    return rows.select("item_id", "rank", results.general(unknown).alias("composite"), results.general(F.col("specificity")).alias("specificity"), results.general(nicking).alias("nicking_specificity"))


def kmer_blobs(spark, sf_dir):
    """All canonical 11-mers with their counts, written as binary records and read back."""
    path = scratch(spark, "kmers")
    kmer_tables.write_kmer_blobs(kmers.packed_counts(sequences(spark, sf_dir), 11, ["doc_id"]), path)
    return kmer_tables.read_kmer_blobs(spark, path, 1 << 20)


def guide_report(spark, sf_dir):
    """Report lines of the ten best benchmark guides for the middle third of every document, searched in the document."""
    from . import catalog

    seqs = sequences(spark, sf_dir).where("doc_id is not null")
    third = F.floor(F.length("seq") / 3)
    targets = seqs.select("doc_id", F.col("doc_id").cast("string").alias("chrom"), third.alias("start"), (2 * third).alias("end"))
    hits = catalog._scored(spark, sf_dir).withColumn("chrom", F.col("doc_id").cast("string"))
    on, off = design.locus_hits(hits, targets, "doc_id")
    activity = catalog._contexts(spark, sf_dir).select(F.col("spacer").alias("guide_id"), F.round(catalog.scoring.activity_score(F.col("context")), 9).alias("score")).groupBy("guide_id").agg(F.max("score").alias("score"))
    rows = design.ranked_guides(on, off, activity, "doc_id")
    lines = reports.report_lines(rows.drop("doc_id", "spacer"))
    return lines.select(F.col(lines.columns[0]).alias("line"))


QUERIES = {
    "seed_prefilter_mismatch": seed_prefilter_mismatch, "guide_rollup": guide_rollup, "record_agreement": record_agreement, "score_agreement": score_agreement, "score_lines": score_lines,
    "fasta_ranges": fasta_ranges, "fastq_ranges": fastq_ranges, "gene_targets": gene_targets, "transcript_edits": transcript_edits, "pe_ranking": pe_ranking, "pe_result_cells": pe_result_cells, "kmer_blobs": kmer_blobs, "guide_report": guide_report,
}
