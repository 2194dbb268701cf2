"""URL filters by link-graph propagation, in DataFrame functions alone.

Rules decide the URLs that they fit. Their pages seed the hosts with trust (allowed pages) and distrust (blocked
pages). Personalised PageRank carries trust along host edges and distrust against them; a host whose distrust
outweighs its trust by a threshold is blocked, and so are its pages that no rule fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Rules are configuration: one branch for each."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, r_host, r_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == r_host) | host.endswith(f".{r_host}")) & path.startswith(r_path)
        out = F.when(fits, F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(judged: DataFrame) -> DataFrame:
    """src, dst, weight (links). A link is an absolute href in the html, or the step from a host to the host one label
    above it, which speaks for its subdomains as they do for it; links inside a host don't count."""
    href = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
    links = judged.where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(href), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER))
    # One label above, where at least two labels are left.
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    up = judged.groupBy("host").agg(F.count("*").alias("n")).withColumn("parent", parent).where("parent <> ''")
    ladder = up.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e"), F.lit(1).cast("long").alias("weight")).select("e.*", "weight")
    counted = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return counted.unionByName(ladder).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 2000, cut_every: int = 5, threshold: float | None = None) -> DataFrame:
    """host, trust, distrust: both ranks in one pass for each round.

    seeds: host, trust0, distrust0. Trust follows src -> dst; distrust goes back, dst -> src. Each round is one join
    with the edges and one aggregation by host; every ``cut_every`` rounds the ranks are written and compared with those written
    before. As a round brings ranks nearer to their limits by the damping, that change bounds all that is to come. Rounds end
    when the bound, summed over all hosts, is ``tolerance`` of the seeds' mass or less; with ``threshold`` also when every host that
    can be reached has been, and the bound is too small to turn distrust > threshold * trust for any of them. An error if
    ``most_rounds`` don't get there.
    """
    both = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), "weight", F.lit(0).alias("back")).unionByName(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), "weight", F.lit(1).alias("back")))
    total = both.groupBy("host", "back").agg(F.sum("weight").alias("total"))
    steps = materialise(both.join(total, ["host", "back"]).select("host", "to", "back", (F.col("weight") / F.col("total")).alias("share")))
    mass = seeds.agg(F.sum(F.col("trust0") + F.col("distrust0")).alias("x")).first()["x"] or 1.0
    # One scale for all sizes of tables; the ranks get theirs back in the end.
    seeds = seeds.select("host", (F.col("trust0") / mass).alias("trust"), (F.col("distrust0") / mass).alias("distrust"))
    kept = seeds.select("host", *[(F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")])
    rank, old, zero = seeds, None, F.lit(0.0)
    shrink = damping**cut_every
    for i in range(most_rounds):
        moved = steps.join(rank, "host").select(
            F.col("to").alias("host"),
            F.when(F.col("back") == 0, F.col("trust") * F.col("share") * damping).otherwise(zero).alias("trust"),
            F.when(F.col("back") == 1, F.col("distrust") * F.col("share") * damping).otherwise(zero).alias("distrust"),
        )
        rank = moved.unionByName(kept).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if (i + 1) % cut_every:
            continue
        rank = materialise(rank)
        if old is not None:
            less = old.select("host", *[(-F.col(c)).alias(c) for c in ("trust", "distrust")], F.lit(-1).alias("n"))
            gap = rank.withColumn("n", F.lit(1)).unionByName(less).groupBy("host").agg(*[F.abs(F.sum(c)).alias(c) for c in ("trust", "distrust")], F.sum("n").alias("n"))
            moving = gap.agg(F.sum(F.col("trust") + F.col("distrust")).alias("change"), F.sum("n").alias("new")).first()
            bound = (moving["change"] or 0.0) * shrink / (1 - shrink)
            done = bound <= tolerance
            if not done and threshold is not None and not moving["new"]:
                margin = F.abs(F.col("distrust") - threshold * F.col("trust"))
                done = rank.where(margin <= (1 + threshold) * bound).isEmpty()
            release(old)
            if done:
                release(steps)
                return rank.select("host", *[(F.col(c) * mass).alias(c) for c in ("trust", "distrust")])
        old = rank
    raise RuntimeError(f"ranks still change after {most_rounds} rounds")


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 1.0, damping: float = 0.85, tolerance: float = 1e-6, ranks: bool = True) -> DataFrame:
    """page_id, url, host, path, rule, verdict, trust, distrust for each row of pages.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Null html has no links.
    Repeated rows are judged alike and count once each. A host without either mass is allowed; distrust must exceed
    ``threshold`` times trust to block. Ranks are off by ``tolerance`` of all seeds at most, summed over all hosts; without ``ranks``
    rounds end as soon as no verdict can turn, and trust and distrust are rougher. Empty pages give an empty result; further columns are ignored.
    """
    judged = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("fit", first_rule(F.col("host"), F.col("path"), rules))
    tally = lambda v: F.sum(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0))
    seeds = materialise(judged.where("host <> ''").groupBy("host").agg(tally("allow").alias("trust0"), tally("block").alias("distrust0")))
    rank = propagate(seeds, host_edges(judged), damping, tolerance, threshold=None if ranks else threshold)
    release(seeds)
    hosts = rank.withColumn("blocked", (F.col("distrust") > 1e-12) & (F.col("distrust") > threshold * F.col("trust")))
    out = judged.drop("html").join(hosts, "host", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), ranks=False).select("page_id", "host", "path", "rule", "verdict")
