"""Joins: mismatch-tolerant guide search, seeds, bands, intervals, positional differences, chains."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dna import hamming, pack
from .motifs import _fits, stranded_windows
from .seeds import ball
from .windows import CODE, Piece, choice, known, scan, strings

SPACER = 20
#: Neighbours of all guides that a task holds at most, and pairs of a site and a guide that it compares at once.
MOST_NEIGHBOURS, PAIRS = 1 << 23, 1 << 18


def pam_sites(seqs: DataFrame, ids: list[str]) -> DataFrame:
    """ids, start (of the 23-base window), strand, site (23 bases as the guide reads them), x (packed 20-mer): windows of
    A, C, G and T that end in GG, and, for the minus strand, that start with CC."""
    table = np.concatenate([*[_fits("N")] * (SPACER + 1), _fits("GG")])
    rows = stranded_windows(seqs, ids, SPACER + 3, table, "site").withColumnRenamed("pos", "start")
    return rows.withColumn("x", pack(F.col("site").substr(1, SPACER)))


def segments(spacer: Column, parts: int) -> Column:
    """array<struct<seg,value>>: a spacer cut into ``parts`` pieces whose lengths differ by one at most."""
    cuts = [SPACER * i // parts for i in range(parts + 1)]
    return F.array(*[F.struct(F.lit(i).alias("seg"), spacer.substr(a + 1, b - a).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def off_targets(sites: DataFrame, guides: DataFrame, mismatches: int = 3) -> DataFrame:
    """guide_id, spacer, the columns of sites and ``mismatches`` (``mismatches`` at most), for guides (guide_id, spacer).

    Pigeonhole: two 20-mers within m mismatches agree on one of m + 1 pieces, so an equality join on pieces meets every
    pair; each is reported at its first common piece alone, which needs no shuffle for distinct rows.
    """
    if not 0 <= mismatches <= 6:
        raise ValueError("mismatches must be 0 to 6: pieces get too short beyond")
    parts = mismatches + 1
    g = guides.select("guide_id", "spacer", pack(F.col("spacer")).alias("gx"), F.explode(segments(F.col("spacer"), parts)).alias("p")).select("guide_id", "spacer", "gx", "p.seg", "p.value")
    s = sites.withColumn("p", F.explode(segments(F.col("site"), parts))).select(*sites.columns, "p.seg", "p.value")
    met = s.join(g, ["seg", "value"]).withColumn("mismatches", hamming(F.col("x"), F.col("gx"))).where(F.col("mismatches") <= mismatches)
    # By bits alone: a later filter on mismatches may move this test before that of the mismatches, to every pair that met.
    cuts = [SPACER * i // parts for i in range(parts + 1)]
    differ = F.col("x").bitwiseXOR(F.col("gx"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit((4 ** (b - a) - 1) << 2 * (SPACER - b))) == 0, i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    return met.where(F.col("seg") == first).drop("seg", "value", "x", "gx")


def halves(mismatches: int) -> list[tuple[int, int, int]]:
    """(bits to the right of it, bases, mismatches) of two parts of a spacer: spacers within so many mismatches are as near as
    that in one part at least."""
    left, right = mismatches // 2, mismatches - mismatches // 2 - 1
    bases = SPACER // 2 - (left > right)
    return [(2 * bases, SPACER - bases, left), (0, bases, right)][: 1 + (right >= 0)]


class Neighbours:
    """Packed spacers by the values of their parts, changed in every way that ``halves`` allows."""

    def __init__(self, spacers: np.ndarray, mismatches: int):
        self.spacers, self.mismatches, self.parts = spacers, mismatches, []
        for shift, bases, radius in halves(mismatches):
            change = np.array(ball(bases, radius), np.int32)
            value = ((spacers >> shift & 4**bases - 1).astype(np.int32)[:, None] ^ change).ravel()
            first = np.r_[0, np.cumsum(np.bincount(value, minlength=4**bases))].astype(np.int32)
            self.parts.append((shift, 4**bases - 1, radius, first, (np.argsort(value, kind="stable") // len(change)).astype(np.int32)))

    def near(self, x: np.ndarray):
        """Parts of (place in x, place in the spacers, mismatches) of all pairs within the mismatches, each pair once."""
        for shift, mask, _, first, spacer in self.parts:
            value = x >> shift & mask
            low = first[value].astype(np.int64)
            count = first[value + 1] - low
            some = np.flatnonzero(count)
            low, count = low[some], count[some]
            ends = np.cumsum(count)
            start = 0
            while start < len(some):
                done = ends[start] - count[start]
                stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
                n = count[start:stop]
                site = np.repeat(some[start:stop], n)
                guide = spacer[np.arange(done, ends[stop - 1]) + np.repeat(low[start:stop] - ends[start:stop] + n, n)]
                differ = x[site] ^ self.spacers[guide]
                differ = (differ | differ >> 1) & 0x5555555555555555
                found = np.bitwise_count(differ)
                keep = found <= self.mismatches
                if not shift:  # pairs that are near on the left are found there
                    left, _, radius = self.parts[0][:3]
                    keep &= np.bitwise_count(differ >> left) > radius
                if keep.any():
                    yield site[keep], guide[keep], found[keep].astype(np.int32)
                start = stop


@lru_cache(maxsize=1)
def _neighbours(spacers: bytes, mismatches: int) -> Neighbours:
    return Neighbours(np.frombuffer(spacers, np.int64), mismatches)


def _spacers(bases: np.ndarray, where: np.ndarray, minus: bool) -> np.ndarray:
    """The first 20 bases, as the strand reads them, of the 23-base windows at some places, packed."""
    x = np.zeros(len(where), np.int64)
    for i in range(SPACER):
        x = x << 2 | (3 - CODE[bases[where + SPACER + 2 - i]] if minus else CODE[bases[where + i]])
    return x


def guide_hits(seqs: DataFrame, ids: list[str], guides: DataFrame, mismatches: int = 3) -> DataFrame:
    """``off_targets`` of the ``pam_sites`` of sequences, without a row for any other site: ids, start, strand, site, guide_id,
    spacer, mismatches. Spacers with other letters than A, C, G and T find nothing.

    Spacers within m mismatches are within m // 2 in their left part, or within the rest less one in the right. So each task
    holds the guides by all values that near in these parts, looks up its sites as it scans them, and compares what it
    meets. Guides with more than MOST_NEIGHBOURS such values meet the sites in ``off_targets``' join instead.
    """
    if not 0 <= mismatches <= 6:
        raise ValueError("mismatches must be 0 to 6: pieces get too short beyond")
    guides = guides.select("guide_id", "spacer").where(F.col("spacer").rlike(f"^[ACGT]{{{SPACER}}}$"))
    most = MOST_NEIGHBOURS // sum(len(ball(bases, radius)) for _, bases, radius in halves(mismatches))
    held = guides.limit(most + 1).toArrow()
    if len(held) > most:
        return off_targets(pam_sites(seqs, ids), guides, mismatches)
    names, texts = (held.column(c).combine_chunks() for c in ("guide_id", "spacer"))
    letters = np.array(texts.to_pylist(), dtype=f"S{SPACER}").view(np.uint8)
    packed = _spacers(np.r_[letters, np.zeros(3, np.uint8)], np.arange(0, len(letters), SPACER), False).tobytes()
    width = SPACER + 3

    def kernel(piece: Piece):
        bases = piece.bases
        on = piece.owns(width) & known(bases, width)
        is_g, is_c, n = bases == ord("G"), bases == ord("C"), len(on)
        sides = np.flatnonzero(on & is_g[width - 2 : width - 2 + n] & is_g[width - 1 :]), np.flatnonzero(on & is_c[:n] & is_c[1 : 1 + n])
        for minus, places in enumerate(sides):
            for site, guide, differ in _neighbours(packed, mismatches).near(_spacers(bases, places, bool(minus))):
                where, back = places[site], np.full(len(site), bool(minus))
                yield where, piece.pos(where), choice(["+", "-"], back), strings(bases, where, width, back), names.take(guide), texts.take(guide), differ

    kind = guides.schema["guide_id"].dataType.simpleString()
    return scan(seqs, ids, width, kernel, f"start long, strand string, site string, guide_id {kind}, spacer string, mismatches int")


def marked_site(site: Column, spacer: Column) -> Column:
    """The site with mismatched spacer bases in lower case."""
    bases = F.transform(F.sequence(F.lit(1), F.lit(SPACER)), lambda i: F.when(site.substr(i, F.lit(1)) == spacer.substr(i, F.lit(1)), site.substr(i, F.lit(1))).otherwise(F.lower(site.substr(i, F.lit(1)))))
    return F.concat(F.array_join(bases, ""), site.substr(SPACER + 1, 3))


def seed_hits(sites: DataFrame, guides: DataFrame, seed: int = 12) -> DataFrame:
    """Exact matches of the last ``seed`` bases of guides, with seed_hit_count: the sites that share the seed. Counted
    before the join, so a common seed's rows are not multiplied first."""
    keyed = sites.withColumn("seed", F.col("site").substr(SPACER - seed + 1, seed))
    counts = keyed.groupBy("seed").agg(F.count("*").alias("seed_hit_count"))
    g = guides.select("guide_id", "spacer", F.col("spacer").substr(SPACER - seed + 1, seed).alias("seed"))
    return keyed.join(g, "seed").join(counts, "seed")


def seed_lookup(query: DataFrame, index: DataFrame, key: str, most: int | None = 1000) -> DataFrame:
    """query joined with index on ``key``; keys that the index holds more than ``most`` times are skipped, as seeds
    (that cap is the operator's own rule, which also takes the skew away); None disables it."""
    if most is not None:
        allowed = index.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") <= most).select(key)
        index = index.join(allowed, key)
    return query.join(index, key)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, low: int, high: int) -> DataFrame:
    """Pairs with low <= abs(a - b) <= high and equal keys, by buckets as wide as the band."""
    l_rows = left.withColumn("_bucket", F.floor(F.col(a) / high))
    r_rows = right.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(b) / high) + d for d in (-1, 0, 1)])))
    gap = F.abs(F.col(a) - F.col(b))
    return l_rows.join(r_rows, [*keys, "_bucket"]).where((gap >= low) & (gap <= high)).drop("_bucket")


def flag_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], point: str, name: str, width: int = 256) -> DataFrame:
    """points with ``name``: whether a half-open span [start, end) of equal keys holds the point. Both sides meet in
    buckets, so a key with many points is dealt over many tasks."""
    cut = spans.where("end > start").select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bucket"))
    per = cut.groupBy(*keys, "_bucket").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    rows = points.withColumn("_bucket", F.floor(F.col(point) / width)).join(per, [*keys, "_bucket"], "left")
    inside = F.coalesce(F.exists("_spans", lambda s: (F.col(point) >= s["start"]) & (F.col(point) < s["end"])), F.lit(False))
    return rows.withColumn(name, inside).drop("_bucket", "_spans")


def positional_difference(left: DataFrame, right: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Rows of two ordered lists that differ at one place: group, place, left_value, right_value (null past an end)."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select(*group, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("place"), F.col(value).alias(name))

    both = numbered(left, "left_value").join(numbered(right, "right_value"), [*group, "place"], "full")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def chain_seeds(hits: DataFrame, keys: list[str], diagonal_gap: int = 32, gap: int = 10_000, least: int = 2, strand: str | None = None) -> DataFrame:
    """Chains of seed hits (keys, query_pos, ref_pos): keys, score, query_start, query_end, ref_start, ref_end, diagonal.

    A hit may follow another of a lower query and reference position, at most ``gap`` before it in both, on a diagonal at
    most ``diagonal_gap`` away; it follows the one that ends the longest chain, the first of equals. So hits form trees, and a
    tree falls into chains: each hit goes to the chain of the longest line below it (first by position of equals).
    With a column ``strand``, hits on ``-`` run backwards in the query, and strands chain apart.

    Hits of far diagonals never chain, so keys are cut where sorted diagonals part by more than the gap; a task takes the
    hits of one cut and gives each the end of its chain. Chains are then a grouped sum.
    """
    import pyarrow as pa

    keys = [*keys, strand] if strand else keys
    ahead = F.when(F.col(strand) == "-", -F.col("query_pos")).otherwise(F.col("query_pos")) if strand else F.col("query_pos")
    placed = hits.select(*keys, "query_pos", "ref_pos", ahead.alias("_q")).withColumn("_d", F.col("ref_pos") - F.col("_q"))
    by_diagonal = Window.partitionBy(*keys).orderBy("_d")
    cut = F.when(F.col("_d") - F.lag("_d").over(by_diagonal) <= diagonal_gap, 0).otherwise(1)
    parts = placed.withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")
    group = [*keys, "_part"]
    schema = T.StructType([*parts.schema.fields, T.StructField("_end", T.LongType())])

    def ends(rows):
        rows = rows.sort_by([("ref_pos", "ascending"), ("_q", "ascending")])
        end = longest_lines(rows.column("_q").to_numpy(), rows.column("ref_pos").to_numpy(), diagonal_gap, gap)
        return rows.append_column("_end", pa.array(end))

    labelled = parts.groupBy(*group).applyInArrow(ends, schema)
    chains = labelled.groupBy(*group, "_end").agg(
        F.count("*").cast("int").alias("score"), F.min("query_pos").alias("query_start"), F.max("query_pos").alias("query_end"),
        F.min("ref_pos").alias("ref_start"), F.max("ref_pos").alias("ref_end"), F.bround(F.avg("_d")).cast("long").alias("diagonal"),
    )
    return chains.where(F.col("score") >= least).drop("_part", "_end")


def longest_lines(q: np.ndarray, r: np.ndarray, diagonal_gap: int, gap: int) -> np.ndarray:
    """For hits in order of r, then q: the hit that ends each one's chain. Hits lie in piles by the length of the longest
    chain that they end; a new hit asks the piles from the longest down for one that it may follow."""
    piles: list[list[int]] = []
    above = np.full(len(r), -1)
    depth = np.zeros(len(r), np.int64)
    for i in range(len(r)):
        for height in range(len(piles) - 1, -1, -1):
            near = np.array(piles[height])
            near = near[np.searchsorted(r[near], r[i] - gap) :]
            ok = (r[near] < r[i]) & (q[near] < q[i]) & (q[i] - q[near] <= gap) & (np.abs((r - q)[near] - (r[i] - q[i])) <= diagonal_gap)
            if ok.any():
                above[i], depth[i] = near[ok][0], height + 1
                break
        if depth[i] == len(piles):
            piles.append([])
        piles[depth[i]].append(i)
    end = np.arange(len(r))
    for i in range(len(r) - 1, -1, -1):  # what lies below a hit comes after it
        j = above[i]
        if j >= 0 and (end[j] == j or (-depth[end[i]], end[i]) < (-depth[end[j]], end[j])):
            end[j] = end[i]
    return end
