"""URL verdicts from rules and link-graph propagation, in DataFrame operations only.

A rule (action, "host/path") fits the pages of its host and all subdomains whose path starts with its
path; the longest rule wins (block before allow among equals). Pages without a rule get the verdict of
their host. A host's seed weights are the shares of its pages that a rule allows and blocks.

Edges are the absolute links between different hosts, weighted by their number. Trust is personalised
PageRank along them from trusted seeds: a host passes on the damped part of its rank by weight and takes in what
comes for its share that isn't blocked. It is divided by the rank that the host would have if every host were a trusted seed, so it is the
share of a host's rank that comes from trusted pages, within 0 and 1. Distrust runs back along the edges from blocked
seeds: a host has its own blocked share and, for the rest, the damped mean distrust of what it links to, within 0 and 1 too.
So it doesn't hang on how many other hosts link to the same place: each host of a farm gets what a farm of one gets.
A host is blocked if its distrust is THRESHOLD or more and exceeds its trust. One trusted link doesn't launder a host: it makes less than half of
the host's rank. STEPS steps leave 0.85 ** STEPS, half a hundredth, of the way to the fixed point at most; a graph that stands still before
takes no more of them.

Null urls and urls without "://" have an empty host and path and are judged like one more host. Null
html has no links. Repeated rows and null page_ids are returned like any other; each counts as a page. Other
columns are not read. No pages, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm._common import table, written

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
STEPS, DAMPING, THRESHOLD = 32, 0.85, 0.5
CUT_EVERY = 4
STILL = 1e-9
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _longest(rules) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))


def rule_of(rules, h: Column, p: Column) -> Column:
    """A struct (rule, action) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in reversed(_longest(rules)):
        of, slash, start = rule.partition("/")
        fits = ((h == of) | h.endswith("." + of)) & p.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, action) by rules alone."""
    out = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return out.withColumn("r", rule_of(rules, F.col("host"), F.col("path"))).select("page_id", "host", "path", "r.rule", "r.action")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): the links between different hosts."""
    pairs = pages.select(host(F.col("url")).alias("src"), F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)).alias("to"))
    away = pairs.select("src", F.explode("to").alias("dst")).where("src <> dst")
    return away.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """seeds(host, st, sd) -> (host, trust, distrust) after the given number of steps, for every host of seeds or edges; both within 0 and 1."""
    out = edges.where("src <> dst").groupBy("src").agg(F.sum("n").alias("o"))
    e = written(edges.where("src <> dst").join(out, "src").select("src", "dst", (F.col("n") / F.col("o")).alias("w")), "url-edges")
    hosts = seeds.select("host", "st", "sd").union(e.select(F.col("dst").alias("host"), F.lit(0.0), F.lit(0.0))).groupBy("host").agg(F.max("st").alias("st"), F.max("sd").alias("sd"))
    base = written(hosts, "url-hosts")
    zero, one = F.lit(0.0), F.lit(1.0)
    # t: rank from trusted seeds, u: rank if every host were one, d: distrust; old: before the last step, for how far it moved
    now = base.select("host", "st", "sd", F.col("st").alias("t"), one.alias("u"), F.col("sd").alias("d"), *(zero.alias(f"old_{c}") for c in "tud"))
    for k in range(steps):
        ahead = e.join(now, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("t") * F.col("w")).alias("t"), (F.col("u") * F.col("w")).alias("u"), zero.alias("d"))
        back = e.join(now, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), zero.alias("t"), zero.alias("u"), (F.col("d") * F.col("w")).alias("d"))
        got = ahead.union(back).groupBy("host").agg(*(F.sum(c).alias(f"in_{c}") for c in "tud"))
        came = lambda c: damping * F.coalesce(f"in_{c}", zero)
        new = {"t": F.col("st") + (1 - F.col("sd")) * came("t"), "u": one + came("u"), "d": F.col("sd") + (1 - F.col("sd")) * came("d")}
        now = now.join(got, "host", "left").select("host", "st", "sd", *(v.alias(c) for c, v in new.items()), *(F.col(c).alias(f"old_{c}") for c in new))
        if k % CUT_EVERY == CUT_EVERY - 1 or k == steps - 1:
            now = written(now, "url-ranks")
            moved = F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"old_{c}")) for c in "tud")))
            if (now.agg(moved).first()[0] or 0) < STILL:
                break
    return now.select("host", (F.col("t") / F.col("u")).alias("trust"), F.col("d").alias("distrust"))


def url_verdicts(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages."""
    by_rule = judged(pages, rules)
    share = lambda a: F.avg(F.when(F.col("action") == a, 1.0).otherwise(0.0))
    seeds = written(by_rule.groupBy("host").agg(share("allow").alias("st"), share("block").alias("sd")), "url-seeds")
    ranks = propagate(host_edges(pages), seeds)
    bad = (F.round("distrust", 6) >= threshold) & (F.round(F.col("distrust") - F.col("trust"), 6) > 0)
    hosts = ranks.select(F.col("host").alias("h"), bad.alias("bad"))
    judge = F.coalesce("action", F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow"))
    return by_rule.join(hosts, F.col("host") == F.col("h"), "left").select("page_id", "host", "path", "rule", judge.alias("verdict"))


def op5_url_trust(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def oracle(rules=RULES, steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    case = lambda k: "case " + " ".join(
        f"when (host = '{of}' or suffix(host, '.{of}')) and starts_with(path, '/{start}') then '{x}'"
        for a, r in _longest(rules) for of, _, start in [r.partition("/")] for x in [(r, a)[k]]
    ) + " end"
    low = "translate({}, '" + UPPER + "', '" + LOWER + "')"
    sql = f"""with base as (select page_id, html, {low.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
by_rule as (select page_id, host, path, {case(0)} as rule, {case(1)} as action from base),
seeds as (select host, avg(case when action = 'allow' then 1.0::double else 0 end) as st, avg(case when action = 'block' then 1.0::double else 0 end) as sd from by_rule group by host),
linked as (select host as src, {low.format("x")} as dst from (select host, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) as x from base)),
edges as (select src, dst, count(*)::double as n from linked where src <> dst group by src, dst),
e as materialized (select src, dst, n / sum(n) over (partition by src) as w from edges),
hosts as materialized (select host, max(st) as st, max(sd) as sd from (select * from seeds union all select dst, 0, 0 from e) group by host),
r0 as materialized (select host, st as t, 1.0::double as u, sd as d from hosts)"""
    for k in range(steps):
        sql += f""",
r{k + 1} as materialized (select h.host, st + {damping} * (1 - sd) * coalesce(in_t, 0) as t, 1 + {damping} * coalesce(in_u, 0) as u, sd + {damping} * (1 - sd) * coalesce(in_d, 0) as d
  from hosts h join r{k} r on h.host = r.host left join (select host, sum(t) as in_t, sum(u) as in_u, sum(d) as in_d from (select dst as host, t * w as t, u * w as u, 0 as d from e join r{k} on src = host
  union all select src, 0, 0, d * w from e join r{k} on dst = host) group by host) g on h.host = g.host)"""
    return sql + f"""
select page_id, b.host, path, rule, coalesce(action, case when round(d, 6) >= {threshold} and round(d - t / u, 6) > 0 then 'block' else 'allow' end) as verdict from by_rule b left join r{steps} r on b.host = r.host"""
