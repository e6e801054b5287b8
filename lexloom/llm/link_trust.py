"""URL filtering by rules and by trust that spreads over links.

Rules (host, path) decide what they fit; the share of a host's pages that they allow or block
is its seed. For other pages there are two personalised PageRanks over the graph of hosts.

* Seen from the seeds: trust walks from allowed hosts along links, distrust from blocked ones
  against links. A seed's rank is dealt out to all its neighbours, so the more hosts link to a
  blocked one the less each gets: these ranks tell which of the two a host has more of.
* Seen from the host: of its own PageRank, the share that ends on blocked hosts along its links,
  and on allowed ones against them, where decided pages end a walk. That share doesn't depend on
  how many others link to the same place. One backward pass gives it for all hosts at once.

A host's open pages are blocked if the share of distrust exceeds that of trust by more than a
half, and its distrust from the seeds exceeds its trust from them. So one blocked folder doesn't condemn a site.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed rules of the query: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), *_LETTERS)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2])


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule as text (null: none) and its verdict."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the last that fits wins
        name = F.when(fits(host, path, r), F.lit(r[1] + r[2])).otherwise(name)
        verdict = F.when(fits(host, path, r), F.lit(r[0])).otherwise(verdict)
    return name, verdict


#: Addresses in links: with a scheme, or beginning with two slashes.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'<>\s]+)"""


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts that pages (url, html) link."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    whole = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    return found.select("src", host_of(whole).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 30, least_change: float = 1e-7, mean: bool = False) -> DataFrame:
    """edges (src, dst, links), seeds (host, trust, distrust) -> host, trust, distrust.

    Both scores go in one pass: distrust walks the reversed edges. A score is (1 - damping)
    times the seed, plus damping times what the neighbours hand on in proportion to links.
    Each round is a join on the sender and a sum for each receiver, stored; only the
    largest change goes to the driver. Without edges the seeds decide at once.

    mean: the same walk seen from its end. A host's score is the share of its own personalised
    PageRank that ends on seeds: a walk from it ends on a decided page, else it goes on
    with the chance ``damping`` along one of its links. So the score is the whole seed, plus,
    for the share of the host that has none, damping times the mean of its neighbours."""
    start = 1.0 if mean else 1 - damping
    seeds = seeds.select("host", (start * F.col("trust")).alias("trust"), (start * F.col("distrust")).alias("distrust"))
    free = F.lit(damping) * (1 - F.coalesce("trust", F.lit(0.0)) - F.coalesce("distrust", F.lit(0.0)) if mean else F.lit(1.0))
    side = "to" if mean else "host"
    walks = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), "links", F.lit(True).alias("ahead")).unionAll(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), "links", F.lit(False).alias("ahead")))
    total = walks.groupBy(side, "ahead").agg(F.sum("links").alias("all"))
    walks = common.store(walks.join(total, [side, "ahead"]).select("host", "to", "ahead", (F.col("links") / F.col("all")).alias("w")), "host-walks")
    score = common.store(seeds, "host-seeds")
    if walks.isEmpty():
        return score
    seeds = score
    for _ in range(rounds):
        sent = walks.join(score, "host").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.when(F.col("ahead"), F.col("w") * F.col("trust")).otherwise(0.0)).alias("t"), F.sum(F.when(~F.col("ahead"), F.col("w") * F.col("distrust")).otherwise(0.0)).alias("d")
        )
        every = seeds.join(sent, "host", "full").select("host", *((F.coalesce(a, F.lit(0.0)) + free * F.coalesce(b, F.lit(0.0))).alias(a) for a, b in (("trust", "t"), ("distrust", "d"))))
        after = common.store(every, "host-scores")
        change = after.join(score.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), "host", "left").agg(
            F.max(F.greatest(F.abs(F.col("trust") - F.coalesce("t", F.lit(0.0))), F.abs(F.col("distrust") - F.coalesce("d", F.lit(0.0)))))
        ).first()[0]
        if score is not seeds:
            common.discard(score)
        score = after
        if change is None or change < least_change:
            break
    return score


@common.scratch()
def judge(pages: DataFrame, rules=RULES, damping: float = 0.85) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, host, path, rule, verdict.

    Null urls and urls without ``://`` have an empty host and path; null html has no links.
    Html of any length is searched whole. Rows that repeat stay. Hosts without pages take part in the graph only.
    Of fitting rules of equal length the one later by (host, path) counts. Other columns are not
    read; an empty table gives no rows."""
    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    share = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    seeds = ruled.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    edges = common.store(host_edges(pages), "host-edges")
    seeds = common.store(seeds, "host-seeds")
    # The damping brings the change of any graph below the least one within these rounds.
    rounds = math.ceil(math.log(1e-7) / math.log(damping)) + 1
    shares = propagate(edges, seeds, damping, rounds, mean=True).where(F.col("distrust") - F.col("trust") > 0.5)
    ranks = propagate(edges, seeds, damping, rounds).where(F.col("distrust") > F.col("trust"))
    blocked = common.keep(common.store(shares.join(ranks, "host", "left_semi").select("host", F.lit("block").alias("method")), "hosts-blocked"))
    open_ = ruled.where("rule is null").join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("method", F.lit("allow")).alias("verdict"))
    return ruled.where("rule is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict")).unionAll(open_)


#: For tables whose links stay within their host: seeds then decide alone.
ORACLE = """
with a as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
rules(verdict, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
r as (select p.page_id, p.host, p.path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(verdict, length(rh || rp)) as said
      from p left join rules on (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp) group by all),
h as (select host, avg(case when said = 'block' then 1 else 0 end) - avg(case when said = 'allow' then 1 else 0 end) as d from r group by host)
select r.page_id, r.host, r.path, r.rule, coalesce(r.said, case when h.d > 0.5 then 'block' else 'allow' end) as verdict from r join h using (host)
"""
