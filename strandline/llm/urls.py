"""Url filter by rules and, where none fits, by trust and distrust that spread over the links between hosts.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks are blocked seeds, each by
its number of such pages. Trust is the personalised PageRank from the trusted seeds along links; distrust is that
from the blocked seeds against them, for who links to bad hosts is bad. Edges are links in the pages' html to other
hosts, counted before they are shuffled, and, with DOMAIN_WEIGHT, ties between a host and its parent domain in both
directions. Both ranks are one iteration over edges and ranks keyed by kind and host, and every few rounds are written
to the shared folder. A host is blocked if its share of distrust exceeds the threshold.

Everything is a DataFrame operation; sums over a frequent host are aggregated before the shuffle, and joins on it are
split by adaptive execution.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule and the verdict allow; hosts without
evidence are allowed; html may be null, empty or very long; repeated pages count again; an empty table gives an empty
table; other columns play no part, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.scratch import stored

DAMPING = 0.85
ROUNDS = 20
ROUNDS_AT_ONCE = 5
DOMAIN_WEIGHT = 0.5
THRESHOLD = 0.5
# Fixed value: a link to another host, in href or src, with or without a scheme.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight`` between different hosts; ``pages``: host, html."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    linked = links.select(F.col("host").alias("src"), lowered(F.col("link")).alias("dst")).filter("src != dst AND src != ''")
    linked = linked.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select("host").distinct().union(linked.select("dst")).filter("host != ''").distinct()
    # A host and each of its parent domains down to two labels, each tied to the next.
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    tied = hosts.select(chain.alias("chain")).filter("size(chain) > 1")
    pairs = tied.select(F.explode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("low"), F.slice("chain", 2, F.size("chain") - 1).alias("high"))).alias("t"))
    pairs = pairs.select("t.low", "t.high").distinct()
    weight = F.lit(DOMAIN_WEIGHT).alias("weight")
    ties = pairs.select(F.col("low").alias("src"), F.col("high").alias("dst"), weight).union(pairs.select(F.col("high").alias("src"), F.col("low").alias("dst"), weight))
    return linked.union(ties).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``kind``, ``host``, ``rank`` with a sum of 1 per kind; ``seeds``: kind, host, weight.

    Mass that reaches a host without links returns to the seeds: that only scales a kind's ranks, so it is left out
    and the ranks are scaled at the end.
    """
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("distrust"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = ways.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    ways = stored(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "ways")
    sums = {r["kind"]: r["total"] for r in seeds.groupBy("kind").agg(F.sum("weight").alias("total")).collect()}  # two rows
    scale = F.lit(0.0)
    for kind, total in sums.items():
        scale = F.when(F.col("kind") == kind, F.lit(1.0 / total)).otherwise(scale)
    start = stored(seeds.select("kind", "host", (F.col("weight") * scale).alias("rank")), "seeds")
    now = start
    for done in range(1, rounds + 1):
        spread = now.join(ways, (now["kind"] == ways["kind"]) & (now["host"] == ways["src"])).select(
            now["kind"], F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank")
        )
        now = spread.union(start.select("kind", "host", F.col("rank") * (1 - damping))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if done % ROUNDS_AT_ONCE == 0 or done == rounds:
            now = stored(now, "ranks")
    whole = {r["kind"]: r["total"] for r in now.groupBy("kind").agg(F.sum("rank").alias("total")).collect()}  # two rows
    scale = F.lit(1.0)
    for kind, total in whole.items():
        scale = F.when(F.col("kind") == kind, F.lit(1.0 / total)).otherwise(scale)
    return now.withColumn("rank", F.col("rank") * scale)


def judge_urls(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, id_column: str = "page_id") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust`` of every page (columns url and html)."""
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col(f"`{id_column}`").alias("id"), host.alias("host"), path.alias("path"), F.col("html"))
    ruled = split.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    edges = stored(host_edges(split.select("host", "html")), "host-edges")
    seeds = ruled.filter("fit IS NOT NULL").groupBy(F.when(F.col("fit.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    found = ranks(edges, stored(seeds, "seed-counts"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    by_host = stored(found.groupBy("host").agg(of("trust"), of("distrust")), "by-host")
    judged = ruled.drop("html").join(by_host, "host", "left").fillna(0.0, ["trust", "distrust"])
    evidence = F.col("trust") + F.col("distrust")
    bad = (evidence > 0) & (F.col("distrust") > threshold * evidence)
    return judged.select(
        "id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust",
    )
