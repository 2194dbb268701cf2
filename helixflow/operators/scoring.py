"""Closed-form guide scores: position-weighted specificity, sequence activity, composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cleavage kept at one mismatch by distance from the PAM, 1 to 20 (Hsu et al. 2013; fixed values).
POSITION_WEIGHTS = [0.0, 0.0, 0.014, 0.0, 0.0, 0.395, 0.317, 0.0, 0.389, 0.079, 0.445, 0.508, 0.613, 0.851, 0.732, 0.828, 0.615, 0.804, 0.685, 0.583]
#: Weight of the two last PAM bases (Doench et al. 2016; fixed values; others are 0).
PAM_WEIGHTS = {"AG": 0.259259259, "CG": 0.107142857, "GA": 0.069444444, "GC": 0.022222222, "GG": 1.0, "GT": 0.016129032, "TG": 0.038961038}
#: Activity model of 30 bases (Doench et al. 2014, supplementary table 1; fixed values): position and bases to weight.
ACTIVITY_INTERCEPT, ACTIVITY_GC_LOW, ACTIVITY_GC_HIGH = 0.59763615, -0.2026259, -0.1665878
ACTIVITY_WEIGHTS = {
    "1G": -0.2753771, "2A": -0.3238875, "2C": 0.17212887, "3C": -0.1006662, "4C": -0.2018029, "4G": 0.24595663, "5A": 0.03644004,
    "5C": 0.09837684, "6C": -0.7411813, "6G": -0.3932644, "11A": -0.466099, "14A": 0.08537695, "14C": -0.013814, "15A": 0.27262051,
    "15C": -0.1190226, "15T": -0.2859442, "16A": 0.09745459, "16G": -0.1755462, "17C": -0.3457955, "17G": -0.6780964, "18A": 0.22508903,
    "18C": -0.5077941, "19G": -0.4173736, "19T": -0.054307, "20G": 0.37989937, "20T": -0.0907126, "21C": 0.05782332, "21T": -0.5305673,
    "22T": -0.8770074, "23C": -0.8762358, "23G": 0.27891626, "23T": -0.4031022, "24A": -0.0773007, "24C": 0.28793562, "24T": -0.2216372,
    "27G": -0.6890167, "27T": 0.11787758, "28C": -0.1604453, "29G": 0.38634258, "1GT": -0.6257787, "4GC": 0.30004332, "5AA": -0.8348362,
    "5TA": 0.76062777, "6GG": -0.4908167, "11GG": -1.5169074, "11TA": 0.7092612, "11TC": 0.49629861, "11TT": -0.5868629, "12GG": -0.3345637,
    "13GA": 0.76384993, "13GC": -0.5370252, "16TG": -0.7981461, "18GG": -0.6668087, "18TC": 0.35318325, "19CC": 0.74807209, "19TG": -0.3672668,
    "20AC": 0.56820913, "20CG": 0.32907207, "20GA": -0.8364568, "20GG": -0.7822076, "21TC": -1.029693, "22CG": 0.85619782, "22CT": -0.4632077,
    "23AA": -0.5794924, "23AG": 0.64907554, "24AG": -0.0773007, "24CG": 0.28793562, "24TG": -0.2216372, "26GT": 0.11787758, "28GG": -0.69774,
}


def activity_weights() -> dict[str, float]:
    return ACTIVITY_WEIGHTS


def mismatch_score(spacer: Column, site: Column, weights: list[float] | None = None) -> Column:
    """Product, in order of positions, of the weights of mismatched positions; weights[0] is next to the PAM."""
    table = F.array(*map(F.lit, reversed(weights or POSITION_WEIGHTS)))
    step = lambda acc, i: acc * F.when(spacer.substr(i, F.lit(1)) == site.substr(i, F.lit(1)), F.lit(1.0)).otherwise(F.element_at(table, i))
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(1.0), step)


def pair_score(spacer: Column, site: Column, matrix: dict[str, float]) -> Column:
    """Product, in order of positions, of the weights of mismatched base pairs; matrix: ``<rna base><dna base><position>``
    to weight, the dna base being the one that pairs (the complement of the site's), position 1 the farthest from the PAM.
    A pair that the matrix lacks is an error."""
    table = F.create_map(*[F.lit(x) for kv in matrix.items() for x in kv])

    def step(acc, i):
        r, d = F.translate(F.upper(spacer.substr(i, F.lit(1))), "T", "U"), F.upper(site.substr(i, F.lit(1)))
        key = F.concat(r, F.translate(d, "ACGTU", "TGCAA"), i.cast("string"))
        weight = F.coalesce(F.element_at(table, key), F.raise_error(F.concat(F.lit("no weight for "), key)).cast("double"))
        return acc * F.when(F.translate(r, "U", "T") == F.translate(d, "U", "T"), F.lit(1.0)).otherwise(weight)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(1.0), step)


def pam_weight(site: Column) -> Column:
    """Weight of the last two bases of a 23-base site."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PAM_WEIGHTS.items() for x in kv]), F.upper(site.substr(22, 2))), F.lit(0.0))


def activity_score(context: Column) -> Column:
    """Logistic score of a 30-base context (4 before, 20 spacer, 3 PAM, 3 after); terms are added in position order."""
    table = F.create_map(*[F.lit(x) for kv in activity_weights().items() for x in kv])
    one = lambda acc, i: acc + F.coalesce(F.element_at(table, F.concat(i.cast("string"), context.substr(i, F.lit(1)))), F.lit(0.0))
    two = lambda acc, i: acc + F.coalesce(F.element_at(table, F.concat(i.cast("string"), context.substr(i, F.lit(2)))), F.lit(0.0))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(ACTIVITY_INTERCEPT), one)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(29)), total, two)
    gc = F.length(F.regexp_replace(context.substr(5, 20), "[^GC]", ""))
    total = total + F.when(gc < 10, ACTIVITY_GC_LOW).when(gc > 10, ACTIVITY_GC_HIGH).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def exact_sum(score: Column) -> Column:
    """A sum that doesn't depend on the order of rows: of scores as whole numbers of 1e-15."""
    return F.sum(F.round(score * 1e15).cast("decimal(38,0)")).cast("double") / 1e15


def specificity(hits: DataFrame, by: str = "guide_id", score: str = "score") -> DataFrame:
    """by, specificity (100 * 100 / (100 + 100 * sum)), off_targets. Hits without mismatch are left out of the sum and
    the count, but their guides stay."""
    off = F.when(F.col("mismatches") > 0, F.col(score))
    total = F.coalesce(exact_sum(off), F.lit(0.0))
    return hits.groupBy(by).agg((F.lit(10000.0) / (100.0 + 100.0 * total)).alias("specificity"), F.count(off).alias("off_targets"))


def top_in_group(hits: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_list(hits: DataFrame, by: str, where: str, pos: str, k: int = 5) -> DataFrame:
    """by, top: ``where:pos:mismatches;score`` of the k best hits, joined by ``;``. Hits without ``where`` come after their equals
    and have no item; top is null where all k have none."""
    best = top_in_group(hits, [by], [F.desc("score"), F.asc_nulls_last(where), F.asc(pos), F.asc("strand")], k)
    item = F.concat(F.col(where).cast("string"), F.lit(":"), F.col(pos).cast("string"), F.lit(":"), F.col("mismatches").cast("string"), F.lit(";"), F.format_string("%.4f", F.col("score")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"])
    return best.groupBy(by).agg(F.nullif(F.array_join(items, ";"), F.lit("")).alias("top"))


def composite(activity: Column, specific: Column) -> Column:
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return 0.5 * clip(activity) + 0.5 * clip(specific / 100)


def guide_notes(spacer: Column, low: float = 25, high: float = 75) -> Column:
    from ..functions.dna import gc_percent

    gc = gc_percent(spacer)
    return F.concat_ws(";", F.when(gc < low, "LOW_GC"), F.when(gc > high, "HIGH_GC"), F.when(spacer.contains("TTTT"), "POLY_T_RUN"))


def smoke_score(parts: list[Column], seed: int) -> Column:
    """A score in [0, 1) from the first eight bytes of SHA-256 over a seed (eight bytes) and the parts joined by ``|``;
    little-endian. It stands in for a model where only determinism matters."""
    text = F.concat(F.lit(seed.to_bytes(8, "little")), F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    h = F.sha2(text, 256)
    little = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(little, 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def raw_off_target_sum(hits: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, off_score, off_targets: the plain sum of scores, without the first perfect hit."""

    rank = F.row_number().over(Window.partitionBy(by, F.col("mismatches") == 0).orderBy(*order))
    rows = hits.withColumn("_rank", rank).where((F.col("mismatches") > 0) | (F.col("_rank") > 1))
    return rows.groupBy(by).agg(exact_sum(F.col("score")).alias("off_score"), F.count("*").alias("off_targets"))


def editing_rank(in_window: Column, bystanders: Column, off_score: Column) -> Column:
    """1 for a target in the window, less 0.2 for each bystander, less half the off-target sum (0 where unknown)."""
    return F.when(in_window, 1.0).otherwise(0.0) - 0.2 * bystanders - 0.5 * F.coalesce(off_score, F.lit(0.0))
