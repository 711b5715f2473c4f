"""URL filters: ordered host and path rules, and link-graph propagation for what no rule judges.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks are
distrusted ones, each by its number of such pages. Trust flows along links between hosts as a
personalised PageRank (restart at the seeds), distrust flows against them: a host that links to
blocked hosts takes over a share of their distrust. A page without a rule gets its host's verdict:
block if distrust makes up at least THRESHOLD of the host's trust, distrust and pages without a rule.

Everything is DataFrame expressions. Link counts are summed by (from, to) before they are shuffled,
hosts' scores are one row per host, and each round of the iteration is a written table.

Defined cases: a null url or one without `://` has empty host and path and no rule; null html has no
links; a page without a host is allowed unless a rule says otherwise; repeated rows are judged alike
and count as links and seeds again; links are looked for in the whole of a very long page; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoq.llm.common import bounded, dropped, written

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING = 0.85
THRESHOLD = 0.5
#: Scores are settled when what still moves is this share of all seed mass; 85 rounds bring 0.85^n there in any graph.
SETTLED, MAX_ROUNDS = 1e-6, 120
#: The host of every absolute or scheme-relative link in a page.
LINK_REGEX = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(F.coalesce(after, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict): the longest rule that fits, null without one. Conditions stand in order of length."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts: n pages of src link to dst, however often and in whichever case."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK_REGEX), F.lit(1)), lower_ascii))
    found = pages.select(host_of(F.col("url").cast("string")).alias("src"), F.explode(links).alias("dst")).where("src <> dst and src <> ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, settled: float = SETTLED, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(host, score): seeds (host, seed) plus what flows along edges (src, dst, share), shares of a src summing to 1.

    score = seed + damping * sum(share * score of src). Rounds end when the mass that still moves is at most
    the share settled of all seed mass; what is left out is then at most settled / (1 - damping) of it.
    """
    mass = seeds.agg(F.sum("seed")).first()[0] or 0.0
    state = written(seeds.select("host", F.col("seed").alias("score"), F.col("seed").alias("moved")), "scores")
    for _ in range(rounds):
        flow = edges.join(state.where("moved > 0"), F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("share") * F.col("moved") * damping).alias("moved"))
        both = state.select("host", "score", F.lit(0.0).alias("moved")).union(flow.select("dst", "moved", "moved"))
        before, state = state, written(both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("moved").alias("moved")), "scores")
        dropped(before)
        if (state.agg(F.sum("moved")).first()[0] or 0.0) <= settled * mass:
            return state.select("host", "score")
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def host_scores(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """(host, trust, distrust, unruled): what the link graph says of each host in judged (host, verdict)."""
    hosts = judged.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").cast("double").alias("allowed"),
        F.count_if(F.col("verdict") == "block").cast("double").alias("blocked"),
        F.count_if(F.col("verdict").isNull()).cast("double").alias("unruled"),
    )
    hosts = written(hosts, "hosts")
    links = written(host_links(pages), "links")
    outgoing = links.groupBy("src").agg(F.sum("n").alias("total")).withColumnRenamed("src", "s")
    incoming = links.groupBy("dst").agg(F.sum("n").alias("total")).withColumnRenamed("dst", "d")
    along = links.join(outgoing, F.col("src") == F.col("s")).select("src", "dst", (F.col("n") / F.col("total")).alias("share"))
    against = links.join(incoming, F.col("dst") == F.col("d")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("share"))
    trust = propagate(hosts.where("allowed > 0").select("host", F.col("allowed").alias("seed")), written(along, "edges"))
    distrust = propagate(hosts.where("blocked > 0").select("host", F.col("blocked").alias("seed")), written(against, "edges"))
    dropped(links)
    both = hosts.select("host", "unruled").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    return both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), "unruled")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_trust, host_distrust) for every page."""
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict"))
    scores = written(host_scores(pages, ruled.select("host", "verdict")), "host_scores")
    weight = F.col("trust") + F.col("distrust") + F.col("unruled")
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * weight)
    verdicts = scores.select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("host_verdict"))
    return ruled.join(bounded(verdicts), "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("host_trust"), F.coalesce("distrust", F.lit(0.0)).alias("host_distrust"),
    )
