"""URL filters: rules first, link-graph propagation for the rest (DataFrame operations only).

Rules (host, path prefix) judge every url they fit; the longest wins. Urls without a rule get their host's verdict
from the link graph: personalised PageRank spreads trust from hosts whose pages the rules allow, and the same walk on
reversed edges spreads distrust from hosts whose pages they block. A host that has more distrust than trust, times
RATIO, is blocked.

Scale: edges are distinct (source host, target host) pairs with counts, so a hot host is as many rows as it has
neighbours; each step is one join and one grouped sum with map-side partial sums, cut to files every few steps until no
verdict can change (whether there is such a host goes to the driver). The verdict returns to the pages by a join on host whose two sides are exchanges, which AQE can split. The rule list is a
parameter of at most MAX_RULES entries and is checked; it travels inside the plan.

Defined cases: a null url or one without :// has an empty host and path, fits no rule and is allowed, as is a host
without links; null html has no links; links to the own host count for nothing; repeated rows are judged alike; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, release

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MAX_RULES = 1000
DAMPING, TOLERANCE, CUT_EVERY, RATIO = 0.85, 1e-9, 6, 1.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(at + start).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, share: the share of a host's links that go to another host."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("(?i)href\\s*=\\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\\s>]+|//[^\"'\\s>]+)"), F.lit(1))
    links = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(hrefs).alias("to"))
    links = links.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("dst"))
    counts = links.filter("src != dst and dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return counts


def propagate(edges: DataFrame, seeds: DataFrame, ratio: float = RATIO, tolerance: float = TOLERANCE) -> DataFrame:
    """node, trust, distrust of personalised PageRank. edges: kind, src, dst, share; seeds: kind, node, seed (1 in all for a kind).

    Ranks are sums over walks, so they only grow, and after n steps DAMPING ** (n + 1) of a kind's mass is still to come. It
    ends when the last CUT_EVERY steps reached no host that was not reached before, and every host is settled: its trust and
    distrust are farther apart than all that is to come, or these steps moved each by at most `tolerance` of itself.
    """
    base = F.col("seed") * (1 - DAMPING)
    state = seeds.select("kind", "node", base.alias("rank"), base.alias("front"), F.lit(0.0).alias("moved"))
    last, n = None, 0
    while True:
        for _ in range(CUT_EVERY):
            gone = state.filter("front > 0").join(edges, (state["kind"] == edges["kind"]) & (state["node"] == edges["src"]))
            gone = gone.select(state["kind"], F.col("dst").alias("node"), (F.col("front") * F.col("share") * DAMPING).alias("front")).select("kind", "node", F.col("front").alias("rank"), "front", F.col("front").alias("moved"))
            stays = state.select("kind", "node", "rank", F.lit(0.0).alias("front"), "moved")
            state = gone.unionByName(stays).groupBy("kind", "node").agg(*[F.sum(c).alias(c) for c in ("rank", "front", "moved")])
        state, n = cut(state, "page-rank"), n + CUT_EVERY
        if last is not None:
            release(last)
        last, state = state, state.withColumn("moved", F.lit(0.0))
        of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0.0))
        ranks = last.groupBy("node").agg(*[of(kind, c).alias(f"{name}{kind}") for kind in ("trust", "distrust") for name, c in (("", "rank"), ("moved_", "moved"))], F.max(F.col("rank") == F.col("moved")).alias("new"))
        still = (F.col("moved_trust") <= tolerance * F.col("trust")) & (F.col("moved_distrust") <= tolerance * F.col("distrust"))
        apart = F.abs(F.col("distrust") - ratio * F.col("trust")) > (1 + ratio) * DAMPING ** (n + 1)
        if ranks.filter(F.col("new") | ~(still | apart)).isEmpty():
            return ranks.select("node", "trust", "distrust")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, ratio: float = RATIO, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per input row."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = parts.withColumn("by", rule_for(F.col("host"), F.col("path"), rules))
    counts = cut(host_edges(parts), "host-edges")
    both = counts.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(counts.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    outs = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = cut(both.join(outs, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "host-shares")
    seed_rows = ruled.filter("by is not null").groupBy(F.when(F.col("by.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), F.col("host").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    totals = seed_rows.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = cut(seed_rows.join(F.broadcast(totals), "kind").select("kind", "node", (F.col("n") / F.col("all")).alias("seed")), "host-seeds")
    by_host = propagate(edges, seeds, ratio, tolerance)
    joined = ruled.drop("html").join(by_host, ruled["host"] == by_host["node"], "left")
    spread = F.when(F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", spread).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
