"""URL filters: rules, then trust and distrust over the host graph.

A url's verdict is that of the longest rule that fits its host (or a parent
domain) and path. Where none fits, its host's standing decides: trust starts
at hosts with pages that a rule allows and follows links (personalised
PageRank); distrust starts at hosts with pages that a rule blocks and follows
links backwards, to those who point at them. A host whose distrust makes up
more than ``threshold`` of both is blocked.

Links are absolute hrefs to other hosts, the host named after a page's
copyright sign, and the hosts of mail addresses in a page. A host that they
give no standing may inherit one: the ranks are also propagated over a wider
graph, of the links and of edges between a host and its parent domain, both
ways. Column ``by`` tells whether a verdict comes of a rule, of links, of the
domain, or of nothing. Top-level domains and ``SHARED_SUFFIXES`` are nobody's
domain.

Rank that reaches a host without links goes back to the seeds. As that only
scales a kind's ranks, it is done once, at the end: each kind's sum is 1.

Scale: pages are read once for the edges, which are summed to host pairs
before the shuffle; every round is one equi-join of ranks and edges and one
map-side sum. Every ``STEPS`` rounds the ranks are written to the shared
folder, so that plans stay short; only the last two of those are held. Rounds end when no host is new and no host's rank
moves by more than a share of itself, so that ranks count however small they
are and however far from a seed. Nothing of host size reaches the driver.
Rules are a short parameter and become one CASE expression.

Defined results: a null url, or one without "://", has empty host and path,
fits no rule and is allowed; null html has no links; hosts without links or
seeds have no score and are allowed; without seeds all scores are 0; repeated
pages are judged row by row, and their links count as often; other columns are not used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import Scratch, table

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ROUNDS, DAMPING, THRESHOLD = 64, 0.85, 0.5
#: Ranks are final once none moves by this share of itself; a verdict needs
#: more than the share of both ranks that may then be missing.
CONVERGED, MARGIN = 1e-4, 1e-3
#: What is added to a kind's name for its ranks over the wider graph.
WIDE = "_wide"
#: Rounds between two that are written.
STEPS = 8
# Suffixes of two labels under which anyone may have a name.
SHARED_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp com.br com.mx com.ar com.cn com.tw com.hk co.in co.kr co.za com.tr co.il com.sg".split()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href\s*=\s*["']?(?:https?:)?//([a-z0-9.-]+)"""
OWNER = r"""&copy;\s*((?:[a-z0-9-]+\.)+[a-z]+)"""
MAIL = r"""(?i)[a-z0-9._%+-]@((?:[a-z0-9-]+\.)+[a-z]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url as the rules see them."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def named_hosts(judged: DataFrame) -> DataFrame:
    """(src, dst, n): how often pages of src name dst."""
    named = lambda pattern: F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(1))
    found = judged.filter("host != ''").select(F.col("host").alias("src"), F.explode(F.concat(named(HREF), named(OWNER), named(MAIL))).alias("dst"))
    found = found.withColumn("dst", F.regexp_replace(F.translate("dst", _UPPER, _LOWER), r"\.+$", "")).filter("src != dst and dst != ''")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def domain_edges(judged: DataFrame) -> DataFrame:
    """(src, dst, n): each host and its parent domain, both ways, n times for
    the pages below."""
    hosts = judged.filter("host rlike '[.][a-z][a-z0-9-]*$'").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split("host", "[.]")
    from_label = lambda i: F.concat_ws(".", F.slice(labels, i + 1, F.size(labels)))
    steps = F.transform(F.sequence(F.lit(0), F.size(labels) - 3), lambda i: F.struct(from_label(i).alias("sub"), from_label(i + 1).alias("domain")))
    pairs = hosts.filter(F.size(labels) > 2).select("n", F.inline(steps)).filter(~F.col("domain").isin(SHARED_SUFFIXES) & (F.col("sub") != ""))
    pairs = pairs.groupBy("sub", "domain").agg(F.sum("n").alias("n"))
    return pairs.select(F.col("sub").alias("src"), F.col("domain").alias("dst"), "n").union(pairs.select("domain", "sub", "n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank) after ``rounds`` rounds, or once they are final.

    edges: (kind, src, dst, n), along which each kind flows; seeds: (kind,
    host), of which each has an equal part of its kind's start.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    flow = scratch.save(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    number = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("number"))  # two rows
    start = scratch.save(seeds.join(F.broadcast(number), "kind").select("kind", "host", (1.0 / F.col("number")).alias("start")))
    ranks, held, turn = start.withColumnRenamed("start", "rank"), None, 0

    def step(ranks: DataFrame, was: DataFrame | None = None) -> DataFrame:
        moved = flow.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (damping * F.col("share") * F.col("rank")).alias("rank"))
        now = moved.unionByName(start.select("kind", "host", ((1 - damping) * F.col("start")).alias("rank")))
        if was is None:
            return now.groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        both = now.withColumn("was", F.lit(0.0)).unionByName(was.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
        return both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was"))

    while rounds is None or turn < rounds:
        fresh, n = Scratch(start.sparkSession, "ranks"), STEPS if rounds is None else min(STEPS, rounds - turn)
        for _ in range(n - 1):
            ranks = step(ranks)
        ranks = fresh.save(ranks) if n > 1 else ranks
        now = fresh.save(step(ranks, ranks))
        final = rounds is None and now.filter(F.abs(F.col("rank") - F.col("was")) > CONVERGED * F.greatest("rank", "was")).isEmpty()
        if held:
            held.drop()
        ranks, held, turn = now.select("kind", "host", "rank"), fresh, turn + n
        if final:
            break
    sums = ranks.groupBy("kind").agg(F.sum("rank").alias("sum"))  # two rows
    ranks = scratch.save(ranks.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("rank") / F.col("sum")).alias("rank")))
    if held:
        held.drop()
    return ranks


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, rounds: int | None = None, damping: float = DAMPING, edges: DataFrame | None = None, inherit: bool = True) -> DataFrame:
    """(page_id, host, path, rule, verdict, by, links_in, links_out, trust,
    distrust) of every page; the last two are those that its host has by links,
    or else by its domain, links_in and links_out how often hosts name each
    other.

    edges: links (src, dst, n) to go by instead of the pages' own; inherit:
    whether a host without standing may have its domain's.
    """
    scratch = Scratch(pages.sparkSession, "links")
    host, path = host_and_path(pages["url"])
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": name, "given": verdict})
    links = scratch.save(named_hosts(judged) if edges is None else edges)
    graphs = {"": links}
    if inherit:
        graphs[WIDE] = scratch.save(links.union(domain_edges(judged)).groupBy("src", "dst").agg(F.sum("n").alias("n")))
    way = lambda kind, e, a, b: e.select(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "n")
    both = reduce(DataFrame.union, [way(kind + wide, e, *ends) for wide, e in graphs.items() for kind, ends in (("trust", ("src", "dst")), ("distrust", ("dst", "src")))])
    kinds = F.explode(F.array(*map(F.lit, graphs)))
    seeds = judged.filter("given is not null").select(F.when(F.col("given") == "allow", "trust").otherwise("distrust").alias("kind"), "host").distinct()
    seeds = seeds.withColumn("wide", kinds).select(F.concat("kind", "wide").alias("kind"), "host")
    ranks = propagate(both, seeds, scratch, rounds, damping)
    # what each host has by kind, and how often it names others and is named
    rank = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    times = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).cast("long").alias(kind)
    count = lambda kind, end: links.select(F.lit(kind).alias("kind"), F.col(end).alias("host"), F.col("n").cast("double").alias("rank"))
    facts = ranks.union(count("links_in", "dst")).union(count("links_out", "src"))
    facts = facts.groupBy("host").agg(*[rank(k + w) for w in ("", WIDE) for k in ("trust", "distrust")], times("links_in"), times("links_out"))
    hosts = Scratch(pages.sparkSession, "standing").save(facts.withColumnRenamed("host", "h"))
    scratch.drop()
    rows = judged.drop("html").join(hosts, F.col("host") == F.col("h"), "left")
    own = F.coalesce(F.col("trust") + F.col("distrust") > 0, F.lit(False))
    trust, distrust = (F.coalesce(F.when(own, F.col(k)).otherwise(F.col(k + WIDE)), F.lit(0.0)) for k in ("trust", "distrust"))
    standing = F.when(distrust - threshold * (trust + distrust) > MARGIN * (trust + distrust), "block").otherwise("allow")
    by = F.when(F.col("given").isNotNull(), "rule").when(own, "links").when(trust + distrust > 0, "domain").otherwise("none")
    named = [F.coalesce(c, F.lit(0)).alias(c) for c in ("links_in", "links_out")]
    return rows.select("page_id", "host", "path", "rule", F.coalesce("given", standing).alias("verdict"), by.alias("by"), *named, trust.alias("trust"), distrust.alias("distrust"))


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict", "by", "links_in", "links_out")


def oracle() -> str:
    """The same in SQL, ``ROUNDS`` rounds written out."""
    fits = {h + p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in RULES}
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits[h + p]} THEN '{value(h + p, v)}'" for h, p, v in order) + " END"
    steps = ["r0 AS (SELECT kind, host, start AS rank FROM start)"]
    for k in range(ROUNDS):
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (
  SELECT flow.kind, flow.dst AS host, {DAMPING} * share * rank AS rank FROM flow JOIN r{k} ON flow.kind = r{k}.kind AND flow.src = r{k}.host
  UNION ALL SELECT kind, host, {1 - DAMPING} * start FROM start) GROUP BY ALL)""")
    quoted = [p.replace("'", "''") for p in (HREF, OWNER, MAIL)]
    named = "list_concat(" + ", ".join(f"regexp_extract_all(coalesce(html, ''), '{p}', 1)" for p in quoted) + ")"
    sums = ", ".join(f"coalesce(sum(rank) FILTER (kind = '{k}{w}'), 0) AS {k}{w}" for k in ("trust", "distrust") for w in ("", WIDE))
    shared = ", ".join(f"'{x}'" for x in SHARED_SUFFIXES)
    return f"""
WITH rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
judged AS (SELECT *, {case(lambda n, v: n)} AS rule, {case(lambda n, v: v)} AS given FROM parts),
named AS (SELECT host AS src, unnest({named}) AS d FROM judged WHERE host <> ''),
links AS (SELECT src, regexp_replace(lower(d), '\\.+$', '') AS dst, count(*) AS n FROM named GROUP BY ALL HAVING src <> dst AND dst <> ''),
hosted AS (SELECT string_split(host, '.') AS l, count(*) AS n FROM judged WHERE regexp_matches(host, '[.][a-z][a-z0-9-]*$') GROUP BY host),
below AS (SELECT l, n, unnest(range(1, len(l) - 1)) AS i FROM hosted),
pairs AS (SELECT array_to_string(l[i:], '.') AS sub, array_to_string(l[i + 1:], '.') AS domain, sum(n) AS n FROM below GROUP BY ALL HAVING domain NOT IN ({shared}) AND sub <> ''),
edges AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM links UNION ALL SELECT sub, domain, n FROM pairs UNION ALL SELECT domain, sub, n FROM pairs) AS u(src, dst, n) GROUP BY ALL),
flows AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links
  UNION ALL SELECT 'trust{WIDE}' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust{WIDE}', dst, src, n FROM edges),
flow AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM flows),
seeds AS (SELECT DISTINCT CASE given WHEN 'allow' THEN 'trust' ELSE 'distrust' END || wide AS kind, host FROM judged, (VALUES (''), ('{WIDE}')) AS w(wide) WHERE given IS NOT NULL),
start AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS start FROM seeds),
{", ".join(steps)},
scaled AS (SELECT kind, host, rank / sum(rank) OVER (PARTITION BY kind) AS rank FROM r{ROUNDS}),
sums AS (SELECT host, {sums} FROM scaled GROUP BY host),
hosts AS (SELECT *, trust + distrust > 0 AS own, CASE WHEN own THEN trust ELSE trust{WIDE} END AS t, CASE WHEN own THEN distrust ELSE distrust{WIDE} END AS d FROM sums)
SELECT page_id, judged.host, path, rule, coalesce(given, CASE WHEN d - {THRESHOLD} * (t + d) > {MARGIN} * (t + d) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN given IS NOT NULL THEN 'rule' WHEN own THEN 'links' WHEN t + d > 0 THEN 'domain' ELSE 'none' END AS by,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM links WHERE dst = judged.host) AS links_in, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM links WHERE src = judged.host) AS links_out
FROM judged LEFT JOIN hosts ON judged.host = hosts.host"""
