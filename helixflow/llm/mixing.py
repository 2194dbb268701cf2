"""Mixing sources to target weights by hierarchical budgets.

Weights flow down a tree domain -> language -> source. Where a node holds less than its share, its siblings take what
is missing in proportion to their weights; only what all siblings together cannot supply goes to the ancestors'
siblings. A leaf's budget is met from seeded epochs: whole passes over its documents, then the prefix, by tokens, of
one more pass in the order of a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
#: Leaves are lines of a mixing plan, which the driver holds; more than this is an error, not a truncation.
MOST_LEAVES = 200_000


@dataclass(frozen=True)
class Mix:
    """weights by path, e.g. ("web",) or ("web", "en") or ("web", "en", "src1"); a missing one is 1. Siblings' weights
    are taken in proportion. ``domains`` maps a source to its domain, others are in ``other``. The target is
    ``tokens``, or ``share`` of all there are. A document appears in ``most_epochs`` passes at most."""

    weights: dict = field(default_factory=dict)
    domains: dict = field(default_factory=dict)
    other: str = "curated"
    share: float = 0.5
    tokens: int | None = None
    most_epochs: int = 3
    seed: int = 17


PRODUCTION = Mix(
    weights={("crawl",): 0.3, ("curated",): 0.7, **{(d, lang): w for d in ("crawl", "curated") for lang, w in (("en", 0.4), ("fr", 0.2), ("de", 0.2), ("es", 0.2))}},
    domains={"src0": "crawl"},
)


def fill(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """Whole numbers that sum to min(budget, sum(room)): shares by weight, and what exceeds a node's room goes to its
    siblings by weight. Single tokens left over by rounding go to the first nodes with room. Weight 0 gets nothing."""
    got = [0] * len(room)
    live = [i for i in range(len(room)) if weights[i] > 0 and room[i] > 0]
    left = min(budget, sum(room[i] for i in live))
    while live and left > 0:
        total = sum(weights[i] for i in live)
        full = [i for i in live if left * weights[i] / total >= room[i] - got[i]]
        if full:
            for i in full:
                left -= room[i] - got[i]
                got[i] = room[i]
            live = [i for i in live if i not in full]
            continue
        shares = [int(left * weights[i] / total) for i in live]
        for i, s in zip(live, shares, strict=True):
            got[i] += s
        left -= sum(shares)
        for i in live:
            if left and got[i] < room[i]:
                got[i] += 1
                left -= 1
        if left == 0:
            break
    return got


def plan(supply: dict[tuple, int], mix: Mix) -> dict[tuple, int]:
    """Budget in tokens of each leaf (domain, lang, source)."""
    budget = mix.tokens if mix.tokens is not None else int(sum(supply.values()) * mix.share)
    room: dict[tuple, int] = {}
    for leaf, n in supply.items():
        for k in range(len(LEVELS) + 1):
            room[leaf[:k]] = room.get(leaf[:k], 0) + n * mix.most_epochs
    given = {(): min(budget, room.get((), 0))}
    children: dict[tuple, list[tuple]] = {}
    for node in sorted(room):
        if node:
            children.setdefault(node[:-1], []).append(node)
    for k in range(len(LEVELS)):
        for node in [n for n in given if len(n) == k]:
            below = children.get(node, [])
            for child, n in zip(below, fill(given[node], [mix.weights.get(c, 1.0) for c in below], [room[c] for c in below]), strict=True):
                given[child] = n
    return {leaf: given.get(leaf, 0) for leaf in supply}


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _leaf(mix: Mix) -> list[Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(NONE))
    domain = F.lit(mix.other)
    for s, d in mix.domains.items():
        domain = F.when(source == s, d).otherwise(domain)
    return [domain.alias("m_domain"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("m_lang"), source.alias("m_source")]


def mix_sources(docs: DataFrame, mix: Mix = PRODUCTION, n_tokens: Column | None = None, rows_a_bucket: int = 20_000) -> DataFrame:
    """docs (all columns), repeated by epoch, with domain, n_tokens and epoch (0, 1, ...).

    Tokens are words unless given. Null lang or source counts as the name ``(none)``; documents without tokens are
    taken with the passes that reach them at no cost. Documents of equal id share their place in the order, and so
    are all in a prefix or all out; a prefix never exceeds its budget. Columns domain, n_tokens, epoch are replaced.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    tokens = n_tokens if n_tokens is not None else words(F.col("text"))
    leaf = ["m_domain", "m_lang", "m_source"]
    slim = materialise(docs.select("doc_id", *_leaf(mix), tokens.alias("m_tokens")))
    found = slim.groupBy(*leaf).agg(F.sum("m_tokens").alias("supply"), F.count("*").alias("rows")).limit(MOST_LEAVES + 1).collect()
    if len(found) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves of domain, language and source")
    supply = {(r.m_domain, r.m_lang, r.m_source): r.supply for r in found}
    rows = {(r.m_domain, r.m_lang, r.m_source): r["rows"] for r in found}
    budget = plan(supply, mix)
    lines = []
    for key, b in budget.items():
        whole = b // supply[key] if supply[key] else 0
        lines.append((*key, int(whole), int(b - whole * supply[key]), int(max(1, -(-rows[key] // rows_a_bucket)))))
    spec = "m_domain string, m_lang string, m_source string, whole int, rest long, buckets int"
    leaves = F.broadcast(spark.createDataFrame(lines, spec))  # MOST_LEAVES rows at most

    # The place of a document in its leaf's pass of number ``whole``.
    place = F.xxhash64(F.lit(mix.seed), F.col("whole"), F.col("doc_id"))
    bucket = F.floor(F.shiftrightunsigned(place, 11) / F.lit(float(2**53)) * F.col("buckets")).cast("int")
    # Places as unsigned numbers keep the order of their buckets.
    order = F.shiftrightunsigned(place, 1)
    at = slim.join(leaves, leaf).where("rest > 0").select(*leaf, "rest", "m_tokens", order.alias("place"), bucket.alias("bucket"))
    sums = at.groupBy(*leaf, "rest", "bucket").agg(F.sum("m_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("bucket"))
    edge = sums.withColumn("upto", upto).where("upto > rest").groupBy(*leaf).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("edge")).select(*leaf, "edge.*")
    edge = F.broadcast(materialise(edge))
    inside = at.join(edge, [*leaf, "bucket"]).groupBy(*leaf, "rest", "before", "place").agg(F.sum("m_tokens").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("place"))
    # Within the edge bucket (rows_a_bucket rows or so) the first place that no longer fits.
    stop = inside.withColumn("upto", upto).where("upto > rest").groupBy(*leaf).agg(F.min("place").alias("stop"))
    stop = F.broadcast(materialise(stop))

    out = docs.select(*own, *_leaf(mix), tokens.alias("n_tokens")).join(leaves, leaf, "left").join(stop, leaf, "left")
    partial = (F.col("rest") > 0) & (order < F.coalesce("stop", F.lit(2**63 - 1)))
    passes = F.col("whole") + F.when(partial, 1).otherwise(0)
    out = out.where(passes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    return out.select(*own, F.col("m_domain").alias("domain"), "n_tokens", "epoch")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix_sources(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")
