"""URL filter: rules first, link-graph propagation for the hosts that no rule settles.

Rules name a host and a path; one fits its host and all subdomains if the path starts with the rule's, the longest
wins. Pages that rules allow make their hosts trusted seeds, pages that rules block make theirs blocked seeds, in
proportion to their number. Personalised PageRank carries trust along host edges; the same on reversed edges
carries distrust from blocked hosts to those that point at them. Edges come from absolute links in the pages and
lead from each host to its parent domain and back, with the pages of the host and the hosts below it as weight. A
host's trust and distrust are its mass by its weight, as multiples of the mean over all pages. They decide the
pages without a rule: block from ``BAR`` times the mean distrust on, if it exceeds the trust.

Native expressions and joins only. Ranks are a table with one row per host and kind; each round is a join and an
aggregation, written to the shared folder. Mass that leaves at hosts without links need not be followed: giving it back
to the seeds only scales the result, which is normalised at the end.

Edge cases: a null url or one without ``://`` has empty host and path, fits no rule and is allowed; a null page has no
links; repeated rows are judged alike and each counts as a page. No blocked pages: nothing more is blocked. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.llm.common import barrier, materialize, release

DAMPING = 0.85
#: Share of the seed mass whose further spread may be left out; fixes the number of rounds.
TOLERANCE = 1e-2
BAR = 1.0
_LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column; both empty for null or without ``://``."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged_by_rules(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, rule_verdict. Rules are tried from the longest to the shortest."""
    host, path = host_and_path(F.col(f"`{url}`"))
    df = barrier(pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path")),
                 host=F.col("host"), path=F.col("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict == "block")):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


def domain_edges(per_host: DataFrame) -> DataFrame:
    """src, dst, weight: both ways between each host and its parent domain, up to domains of two labels."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))),
                        lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    below = per_host.where("host <> ''").select(F.explode(above).alias("host"), "pages")
    weighed = below.groupBy("host").agg(F.sum("pages").cast("double").alias("weight"))
    up = weighed.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst"), "weight").where("dst <> ''")
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def host_edges(pages: DataFrame, per_host: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: pages of a host that link to another, and the ``domain_edges``."""
    host, _ = host_and_path(F.col(f"`{url}`"))
    targets = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lit(_LINK), F.lit(1)))
    found = pages.select(host.alias("src"), F.explode(targets).alias("dst"))
    found = found.select("src", lower_ascii(F.regexp_replace("dst", r"^.*@", "")).alias("dst"))
    linked = found.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    both = linked.unionByName(domain_edges(per_host)).where("src <> '' AND dst <> '' AND src <> dst")
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score) from seeds of that shape; ``edges`` has (kind, src, dst, weight). Scores of a kind sum to 1.

    The rounds add up how seed mass spreads. A round spreads ``damping`` of what the one before did, so the number of
    rounds after which less than ``tolerance`` is left is known; they end earlier where hosts without links take the mass.
    """
    out = materialize(edges.groupBy("kind", "src").agg(F.sum("weight").alias("_out")), "host-out")
    steps = edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("_out")).alias("p"))
    steps = materialize(steps, "host-steps")
    start = materialize(seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score")), "host-ranks")
    ranks, total = start, 0.0
    for _ in range(math.ceil(math.log(tolerance, damping)) if damping else 0):
        now = ranks.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        if now - total < tolerance * (1 - damping):
            break
        total = now
        moved = ranks.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
        before, ranks = ranks, materialize(moved.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score")), "host-ranks")
        if before is not start:
            release(before)
    sums = ranks.groupBy("kind").agg(F.sum("score").alias("_all"))  # one row per kind
    return ranks.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("score") / F.col("_all")).alias("score"))


def host_scores(pages: DataFrame, judged: DataFrame, url: str = "url", html: str = "html", damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust: propagated seed mass by weight, as a multiple of that of all hosts."""
    per_host = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("rule_verdict") == "allow").alias("allow"),
        F.count_if(F.col("rule_verdict") == "block").alias("block"))
    per_host = materialize(per_host, "host-pages")
    seeds = per_host.select("host", F.explode(F.map_from_arrays(
        F.array(F.lit("allow"), F.lit("block")), F.array("allow", "block"))).alias("kind", "n")).where("n > 0")
    totals = seeds.groupBy("kind").agg(F.sum("n").alias("_all"))  # one row per kind
    seeds = seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("_all")).alias("score"))
    edges = host_edges(pages, per_host, url, html)
    directed = edges.select(F.explode(F.array(
        F.struct(F.lit("allow").alias("kind"), F.col("src"), F.col("dst"), F.col("weight")),
        F.struct(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight")))).alias("e"))
    directed = materialize(directed.select("e.*"), "host-edges")
    scores = propagate(directed, seeds, damping)
    ends = directed.select("kind", F.explode(F.array("src", "dst")).alias("host"), (F.col("weight") / 2).alias("weight"))
    weighed = per_host.where("host <> ''").select(F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("kind"), "host", F.col("pages").alias("own"))
    weighed = weighed.join(ends.groupBy("kind", "host").agg(F.sum("weight").alias("weight")), ["kind", "host"], "full").select(
        "kind", "host", "own", F.greatest(F.coalesce("weight", F.lit(0.0)), F.coalesce("own", F.lit(0))).alias("weight"))
    lifts = materialize(weighed.join(scores, ["kind", "host"], "left"), "host-lifts")
    density = F.coalesce(F.col("score") / F.col("weight"), F.lit(0.0))
    common = lifts.groupBy("kind").agg((F.sum(density * F.col("own")) / F.sum("own")).alias("_common"))  # one row per kind
    lift = F.coalesce(density / F.nullif(F.col("_common"), F.lit(0.0)), F.lit(0.0))
    wide = lifts.join(F.broadcast(common), "kind").groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "allow", lift)).alias("trust"), F.sum(F.when(F.col("kind") == "block", lift)).alias("distrust"))
    return per_host.select("host").join(wide, "host", "left").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def filtered(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html",
             damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per page. With ``damping`` 0 nothing is propagated."""
    judged = materialize(judged_by_rules(pages, rules, page_id, url), "pages-judged")
    scores = materialize(host_scores(pages, judged, url, html, damping), "host-scores")
    bad = (F.col("distrust") >= BAR) & (F.col("distrust") > F.col("trust")) & (F.col("host") != "")
    return judged.join(scores, "host").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
