"""URL verdicts by rules, and by link-graph propagation where no rule fits.

Rules.  A rule names a host and a path; it fits its host and all subdomains when
the url's path starts with the rule's path.  The longest fitting rule decides.

Propagation.  Hosts are nodes; a link from a page to another host is an edge,
weighted by its count.  Hosts of whose pages the rules allow more than half are
trusted seeds, hosts of whose pages they block more than half are blocked seeds,
each weighted by those pages; a host with fewer such pages is no seed.
Trust is personalised PageRank from the trusted seeds along the edges; distrust is
personalised PageRank from the blocked seeds along the reversed edges (who links
to blocked hosts is distrusted).  A host with distrust - trust above `threshold` is
blocked, and its pages with it where no rule speaks.  Links without a host stay on
their page's host, which moves no rank.

Edges and seeds are summed per host before any join, so a host with a large share
of all pages is one row there; its pages get their verdict by a bounded broadcast.
Equal trust and distrust, and neither, allow.

Defined results.  A null url or one without `://` has an empty host and path, fits
no rule, takes no part in the graph and is allowed.  Null html has no links.  An anchor's tag ends at
the next `>` or `<`, so the work grows in proportion to a page of any form; long urls are read whole.
Repeated rows are judged each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import join_classes, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.0
#: A host is cut from an absolute or scheme-relative link of an anchor. A tag ends at the next < too, so that open tags are not read twice.
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links): the links between different hosts."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)).alias("dst"))
    return found.withColumn("dst", ascii_lower(F.col("dst"))).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass): personalised PageRank of each kind.

    edges is (kind, src, dst, links) and seeds (kind, host, weight).  Mass on a host without edges goes back to the seeds.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    seeds = materialize(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("seed")), "url-seeds")
    outs = edges.groupBy("kind", "src").agg(F.sum("links").alias("out"))
    shares = materialize(edges.join(outs, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("out")).alias("share")), "url-shares")
    mass = seeds.select("kind", "host", F.col("seed").alias("mass"))
    if shares.isEmpty():
        return mass  # all mass goes back to the seeds in every round
    for step in range(1, rounds + 1):
        moved = shares.join(mass, (shares.kind == mass.kind) & (shares.src == mass.host)).groupBy(shares.kind, F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("came"))
        kept = moved.groupBy("kind").agg(F.sum("came").alias("kept"))  # one row for each kind
        back = seeds.join(F.broadcast(kept), "kind", "left").select(
            "kind", "host", (F.col("seed") * (1 - damping + damping * (1 - F.coalesce("kept", F.lit(0.0))))).alias("mass")
        )
        mass = back.unionByName(moved.select("kind", "host", (damping * F.col("came")).alias("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        mass = materialize(mass, "url-mass")
    return mass


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page."""
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("fit", longest_rule(rules, F.col("host"), F.col("path")))
    links = materialize(host_edges(pages, url_col=url_col, html_col=html_col), "url-edges")
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    counted = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), *[F.count_if(F.col("fit.verdict") == v).alias(v) for v in ("allow", "block")])
    counted = materialize(counted, "url-hosts")
    kind = F.when(2 * F.col("allow") > F.col("pages"), "trust").when(2 * F.col("block") > F.col("pages"), "distrust")
    seeds = counted.select(kind.alias("kind"), "host", F.greatest("allow", "block").alias("weight")).where("kind IS NOT NULL")
    mass = propagate(edges, seeds, damping=damping, rounds=rounds)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0))
    hosts = mass.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    by_method = F.when(F.coalesce(F.col("distrust"), F.lit(0.0)) - F.coalesce(F.col("trust"), F.lit(0.0)) > threshold, "block").otherwise("allow")
    total = counted.agg(F.sum("pages")).first()[0] or 0
    classes = counted.select("host", "pages").join(hosts, "host", "left").unionByName(pages.sparkSession.sql(f"SELECT '' AS host, {total + 1}L AS pages, 0D AS trust, 0D AS distrust"))
    return join_classes(ruled, classes, ["host"], "pages", total).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), by_method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def url_filter_sql(rules: Sequence[Rule] = RULES) -> str:
    """(page_id, host, path, rule, verdict) in DuckDB SQL over `pages`."""
    cases = sorted(rules, key=lambda r: (-len(r.text), r.text))
    when = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{}}'".format(r.text) for r in cases)
    verdicts = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in rules)
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    steps = []
    for k in range(1, ROUNDS + 1):
        steps.append(f"""
moved{k} AS (SELECT s.kind, dst AS host, sum(mass * share) AS came FROM shares s JOIN mass{k - 1} m ON s.kind = m.kind AND s.src = m.host GROUP BY s.kind, dst),
kept{k} AS (SELECT kind, sum(came) AS kept FROM moved{k} GROUP BY kind),
mass{k} AS (SELECT kind, host, sum(mass) AS mass FROM (
  SELECT s.kind, host, seed * (1 - {DAMPING} + {DAMPING} * (1 - coalesce(kept, 0))) AS mass FROM seeds s LEFT JOIN kept{k} k ON s.kind = k.kind
  UNION ALL SELECT kind, host, {DAMPING} * came FROM moved{k}) GROUP BY kind, host)""")
    link = LINK.replace("'", "''")
    return f"""
WITH parsed AS (
  SELECT page_id, html, {lower.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, CASE {when} END AS rule FROM parsed),
found AS (SELECT host AS src, {lower.format("unnest(regexp_extract_all(coalesce(html, ''), '" + link + "', 1))")} AS dst FROM ruled),
links AS (SELECT src, dst, count(*) AS links FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
edges AS (SELECT 'trust' AS kind, src, dst, links FROM links UNION ALL SELECT 'distrust', dst, src, links FROM links),
shares AS (SELECT kind, src, dst, links / sum(links) OVER (PARTITION BY kind, src) AS share FROM edges),
judged AS (SELECT host, CASE rule {verdicts} END AS verdict FROM ruled WHERE host <> ''),
votes AS (SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked FROM judged GROUP BY host),
counted AS (SELECT CASE WHEN 2 * allowed > pages THEN 'trust' ELSE 'distrust' END AS kind, host, greatest(allowed, blocked) AS weight
  FROM votes WHERE 2 * allowed > pages OR 2 * blocked > pages),
seeds AS (SELECT kind, host, weight / sum(weight) OVER (PARTITION BY kind) AS seed FROM counted),
mass0 AS (SELECT kind, host, seed AS mass FROM seeds),{",".join(steps)},
hosts AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM mass{ROUNDS} GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(CASE rule {verdicts} END,
  CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN hosts h ON r.host = h.host
"""
