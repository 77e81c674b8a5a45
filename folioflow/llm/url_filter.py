"""URL filtering: host rules, and trust propagated over the link graph for what no rule decides.

The graph has hosts as nodes and an edge for the links of one host's pages to another
host, and for each host to the domain it is under. Seeds are hosts that rules judge for
the larger part of their pages, with that share as weight, and hosts of a seed table.
Words of a host's name are evidence where a caller names some, as the query does. Trust spreads from trusted hosts along edges (personalised
PageRank); distrust spreads from blocked hosts against them, to hosts that link there
and to hosts under them. A host is blocked when its distrust passes a threshold and
exceeds its trust. Everything runs on host tables: pages meet the result in one join
on host, of which Spark splits a hot host.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("block", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Words of a host name, between dots and hyphens, that make it a blocked seed of the query.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "viagra", "warez")
#: Rounds of propagation that make one staged table.
STEP = 5
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(text_or_empty(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(text_or_empty(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last that fits wins
        fit = fits(rule, host, path)
        name, verdict = F.when(fit, F.lit(rule.name)).otherwise(name), F.when(fit, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted; summed in every task before they move."""
    dst = F.explode(F.regexp_extract_all(text_or_empty(pages[html_col]), F.lit(LINK), 1))
    links = pages.select(host_of(pages[url_col]).alias("src"), dst.alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): each host to the domain it is under and so on up to two labels; numbers are no domains."""
    labels = F.split("host", "[.]")
    named = hosts.where((F.size(labels) > 2) & ~F.element_at(labels, -1).rlike(r"^(\d|$)")).select(labels.alias("labels"))
    chain = F.sequence(F.lit(1), F.size("labels") - 2)
    up = lambda k: F.array_join(F.slice("labels", k, F.size("labels")), ".")
    return named.select(F.explode(F.transform(chain, lambda k: F.struct(up(k).alias("src"), up(k + 1).alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1).cast("long").alias("n")).distinct()


def propagate(scratch: Scratch, edges: DataFrame, seeds: DataFrame, name: str, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank of (host, seed) over (src, dst, n), in units of one seed's restart: (host, score).

    Mass that reaches a host without outgoing links is lost. ``STEP`` rounds make a staged table. They go on until no score
    moves by ``tolerance`` in the last round; what moves falls by ``damping`` a round, from the sum of the seeds, so that they end.
    """
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    flow = scratch.put(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), f"{name}-flow")
    start = scratch.put(seeds.select("host", F.col("seed").cast("double").alias("score")), f"{name}-seeds")
    mass = start.agg(F.sum("score")).first()[0] or 0.0
    most = 2 + max(0, math.ceil(math.log(tolerance / max(mass, tolerance)) / math.log(damping)))
    rank, last = start, None
    for k in range(-(-most // STEP)):
        new = rank
        for _ in range(STEP):
            old = new
            spread = old.join(flow, old["host"] == flow["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score"))
            new = spread.unionByName(start).groupBy("host").agg(F.sum("score").alias("score"))
        staged = scratch.put(new.join(old.withColumnRenamed("score", "old"), "host", "left"), f"{name}-{k}")
        moved = staged.agg(F.max(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        if last:
            scratch.drop(last)
        rank, last = staged.drop("old"), f"{name}-{k}"
        if moved < tolerance:
            return rank
    raise RuntimeError(f"{name}: scores still move by {moved} after {most} rounds")


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    blocked_words: tuple[str, ...] = (),
    trusted_hosts: tuple[str, ...] = (),
    seeds: DataFrame | None = None,
    seed_share: float = 0.5,
    threshold: float = 0.2,
    damping: float = 0.85,
    tolerance: float = 1e-3,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Seeds are hosts. Blocked ones are of ``seeds`` (host, verdict), those with a word of ``blocked_words`` in their name, or
    under a rule that blocks a whole host, with weight one, and those of which rules block ``seed_share`` of the pages or
    more, with that share as weight; trusted ones are named, of ``seeds``, under a rule that allows a whole host, or have
    pages that rules allow, by their share. A seed of both kinds has the larger weight of each.

    * A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.
    * A null html has no links. Repeated rows are judged alike, and count twice. An empty table gives no rows.
    * Very long urls and pages count whole. Hosts of ``seeds`` that are null or not in the graph do nothing.
    * Only the three named columns are read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    url = pages[url_col]
    rows = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = longest(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    counts = rows.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocked"), F.sum((F.col("ruled") == "allow").cast("long")).alias("allowed")
    )
    counts = scratch.put(counts, "counts")
    links = scratch.put(host_edges(pages, url_col, html_col), "links")
    hosts = counts.select("host").unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"))).distinct()
    edges = links.unionByName(domain_edges(hosts)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    edges = scratch.put(edges, "edges")
    known = hosts.unionByName(edges.select(F.col("dst").alias("host"))).distinct().join(counts, "host", "left")
    whole = [r for r in rules if r.path in ("", "/")]
    no = F.lit(False)
    bad = F.arrays_overlap(F.split("host", "[.-]"), F.lit(list(blocked_words))) if blocked_words else no
    good = F.col("host").isin(*trusted_hosts) if trusted_hosts else no
    for r in whole:
        under = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        bad, good = (bad | under, good) if r.verdict == "block" else (bad, good | under)
    if seeds is not None:
        named = seeds.where("host is not null").groupBy(F.translate("host", UPPER, LOWER).alias("host")).agg(F.max((F.col("verdict") == "block").cast("int")).alias("seed_bad"), F.max((F.col("verdict") == "allow").cast("int")).alias("seed_good"))
        known = known.join(named, "host", "left")
        bad, good = bad | (F.coalesce("seed_bad", F.lit(0)) == 1), good | (F.coalesce("seed_good", F.lit(0)) == 1)
    share = lambda c: F.coalesce(F.col(c) / F.col("pages"), F.lit(0.0))
    by_rules = F.when(share("blocked") >= seed_share, share("blocked")).otherwise(0.0)
    weights = known.select("host", F.when(bad, 1.0).otherwise(by_rules).alias("bad"), F.when(good, 1.0).otherwise(share("allowed")).alias("good"))
    weights = scratch.put(weights.where("bad > 0 or good > 0"), "seeds")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = propagate(scratch, edges, weights.where("good > 0").select("host", F.col("good").alias("seed")), "trust", damping, tolerance)
    distrust = propagate(scratch, back, weights.where("bad > 0").select("host", F.col("bad").alias("seed")), "distrust", damping, tolerance)
    scores = distrust.select("host", F.col("score").alias("distrust")).join(trust.select("host", F.col("score").alias("trust")), "host", "left")
    scores = scores.withColumn("trust", F.coalesce("trust", F.lit(0.0))).where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")))
    judged = rows.join(scores, "host", "left")
    return judged.select(
        F.col("page_id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("distrust").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), blocked_words=BLOCKED_WORDS)


#: The same in SQL for link graphs without cycles of more than 60 steps' weight: each round of the recursion is a step of the mass.
ORACLE_SQL = r"""
with recursive p as (
  select page_id, html,
    case when instr(coalesce(url, ''), '://') = 0 then '' else translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as host,
    case when instr(coalesce(url, ''), '://') = 0 then '' else regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) end as path from pages),
ruled as (
  select page_id, html, host, path,
    case when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/en/7') then 'example.com/en/7'
         when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/de/8') then 'example.net/de/8'
         when (host = 'com' or suffix(host, '.com')) and prefix(path, '/en/') then 'com/en/'
         when (host = 'net' or suffix(host, '.net')) and prefix(path, '/de/') then 'net/de/'
         when (host = 'org' or suffix(host, '.org')) and prefix(path, '/es/') then 'org/es/' end as rule from p),
judged as (select *, case when rule is null then null when rule = 'example.com/en/7' then 'allow' else 'block' end as ruled from ruled),
counts as (select host, sum((ruled = 'block')::int) / count(*) as blocked, sum((ruled = 'allow')::int) / count(*) as allowed from judged where host <> '' group by host),
hrefs as (select host as src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)) as dst from judged),
links as (select src, lower(dst) as dst, count(*) as n from hrefs where src <> '' and dst <> '' group by 1, 2 having src <> lower(dst)),
hosts as (select host from counts union select src from links union select dst from links),
parts as (select string_split(host, '.') as l from hosts where len(string_split(host, '.')) > 2 and not regexp_matches(string_split(host, '.')[-1], '^([0-9]|$)')),
ups as (select distinct array_to_string(l[k:], '.') as src, array_to_string(l[k + 1:], '.') as dst, 1 as n from (select l, unnest(range(1, len(l) - 1)) as k from parts)),
edges as (select src, dst, sum(n) as n from (select * from links union all select * from ups) group by all),
weights as (
  select host, case when regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|porn|spam|viagra|warez)([.-]|$)') then 1.0 when coalesce(blocked, 0) >= 0.5 then blocked else 0 end as bad, coalesce(allowed, 0) as good
  from (select host from hosts union select dst from edges) left join counts using (host)),
forth as (select src, dst, n / sum(n) over (partition by src) as share from edges),
back as (select dst as src, src as dst, n / sum(n) over (partition by dst) as share from edges),
t as (select 0 as k, host, good::double as m from weights where good > 0 union all select k + 1, dst, 0.85 * sum(m * share) from t join forth on host = src where k < 60 group by 1, 2),
d as (select 0 as k, host, bad::double as m from weights where bad > 0 union all select k + 1, dst, 0.85 * sum(m * share) from d join back on host = src where k < 60 group by 1, 2),
trust as (select host, sum(m) as s from t group by host), distrust as (select host, sum(m) as s from d group by host)
select page_id, j.host, path, rule, coalesce(ruled, case when distrust.s >= 0.2 and distrust.s > coalesce(trust.s, 0) then 'block' else 'allow' end) as verdict
from judged j left join distrust on j.host = distrust.host left join trust on j.host = trust.host
"""
