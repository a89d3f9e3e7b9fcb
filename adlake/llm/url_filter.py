"""URL filters: rules by host and path, and trust that spreads over the graph of hosts.

Hosts are nodes; an edge leads from a page's host to each other host it links to, and from a host to the
site it belongs to (``blog.a.org`` to ``a.org``) if that has pages. Trust spreads along the edges from hosts
that rules allow, as a personalised PageRank; distrust spreads against them from hosts that
rules block. A url no rule fits goes by its host: blocked if distrust is above a threshold and above trust.
Scores are whole numbers (billionths of a seed), so that no order of summation changes a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import stored

SEED = 1_000_000_000
DAMPING = 85                 # hundredths that move on
ROUNDS = 10
#: A walk has settled if three more rounds move no more than this in all (a ten-thousandth of the threshold).
SETTLED = SEED // 200_000
THRESHOLD = SEED // 20       # a third of what a host has whose pages are all blocked
LINK = r"""(?i)(?:href|src)\s*=\s*["']([^"']*)["']"""
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) that a rule fits; the longest rule wins.

    ``rules`` has rule_host, rule_path and verdict. Of equally long rules block wins.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    each = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    best = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), (F.col("verdict") == "block").alias("b"),
                          F.concat("rule_host", "rule_path").alias("rule"), "verdict"))
    return (each.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
            .groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different hosts: links of pages (host, html), and hosts to the site above them."""
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    links = (pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
             .select("src", host_of(link).alias("dst")))
    hosts = pages.select("host").distinct()
    above = (hosts.withColumn("dst", F.regexp_extract("host", r"^[^.]*\.(.*)$", 1))
             .join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
             .select(F.col("host").alias("src"), "dst"))
    return links.unionByName(above).filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def _settled(before: DataFrame, after: DataFrame) -> bool:
    """Whether the masses of all hosts together differ by at most ``SETTLED``; a host that only one side has had nothing."""
    change = before.withColumn("mass", -F.col("mass")).unionByName(after).groupBy("kind", "host").agg(
        F.sum("mass").alias("change"))
    return change.agg(F.coalesce(F.sum(F.abs("change").cast("double")), F.lit(0.0))).first()[0] <= SETTLED


def spread(edges: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust).

    After ``rounds`` rounds from the whole seeds; without ``rounds`` from the share that stays, until all
    hosts together change by at most ``SETTLED``. Masses only grow then, and what moves shrinks by ``DAMPING``
    a round, so no host can still get twice that.
    """
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degrees = ways.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    ways = stored(ways.join(degrees, ["kind", "src"]), "ways")
    start = stored(seeds.select("host", F.explode(F.create_map(
        F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "mass")).filter("mass > 0"), "seeds")
    held = start.select("kind", "host", F.expr(f"mass * {100 - DAMPING} div 100").alias("mass"))
    state = start if rounds is not None else stored(held, "state")
    before, i = state, 0
    while rounds is None or i < rounds:
        moved = state.withColumnRenamed("host", "src").join(ways, ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), F.expr(f"mass * {DAMPING} div 100 div degree").alias("mass"))
        state = held.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        i += 1
        if i % 3 == 0 or i == rounds:
            state = stored(state, "state")
            if rounds is None and _settled(before, state):
                break
            before = state
    one = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k) for k in ("trust", "distrust")}
    return state.groupBy("host").agg(*one.values())


def judged(pages: DataFrame, rules: DataFrame, rounds: int | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of pages (page_id, url, html).

    A null url or one without ``://`` has empty host and path, fits no rule, is no seed and is
    allowed. A host's seed is the share of its pages that rules allow or block. Null html has
    no links; repeated pages come back as often as they came.
    """
    cut = stored(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html"), "pages")
    ruled = stored(by_rules(cut, rules), "ruled")
    marked = cut.select("page_id", "host", "path").join(ruled, ["host", "path"], "left")

    def share(verdict: str) -> str:
        return f"{SEED} * count_if(verdict = '{verdict}') div count(*)"

    seeds = marked.filter("host <> ''").groupBy("host").agg(
        F.expr(share("allow")).alias("trust"), F.expr(share("block")).alias("distrust"))
    scores = spread(host_edges(cut), seeds, rounds)
    out = marked.join(scores, "host", "left")
    low = F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust")
    out = out.select("page_id", "host", "path", "rule", "verdict", *low)
    method = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", method))
