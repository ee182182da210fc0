"""Graph queries: orders link to their parts, parts to parts of the same orders, regions to nations to suppliers to parts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import graph, merge
from marlstone.operators.linkindex import CAP, LinkIndex
from marlstone.plans.registry import load, query
from marlstone.sources.versioned import Store
from marlstone.sources.workspace import materialize, shared_dir

E_SQL = """e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""
P_SQL = E_SQL + """, pp AS (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM e a JOIN e b ON a.src = b.src WHERE a.dst <> b.dst),
pn AS (SELECT DISTINCT dst AS node FROM e)"""
T_SQL = """t AS (SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION SELECT DISTINCT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
tn AS (SELECT src AS node FROM t UNION SELECT dst FROM t)"""
IN_SQL = "d AS (SELECT node, (SELECT count(*) FROM {e} x WHERE x.dst = n.node) AS i, (SELECT count(*) FROM {e} x WHERE x.src = n.node) AS o FROM {n} n)"


def order_parts(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


def part_parts(spark: SparkSession, sf: str) -> DataFrame:
    e = order_parts(spark, sf)
    a, b = e.select(F.col("src").alias("o"), F.col("dst").alias("src")), e.select(F.col("src").alias("o"), "dst")
    return a.join(b, "o").where("src <> dst").select("src", "dst").distinct()


def part_links(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    """(src, dsts): the links of part_parts by the parts (node) that they leave; keys stay numbers until links are told apart."""
    e = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    named = lambda c: F.concat(F.lit("p"), c)

    def links_of(nodes: DataFrame) -> DataFrame:
        asked = graph.written_small(nodes.select(F.substring("node", F.lit(2), F.char_length("node")).cast(e.schema["p"].dataType).alias("p")))
        own = graph.written_small(materialize(e.join(asked, "p", "left_semi").select("o", F.col("p").alias("from")).distinct(), "part-orders"))
        near = own.join(e, "o").where("`from` <> p").groupBy("from").agg(F.collect_set("p").alias("all"))
        return near.select(named("from").alias("src"), F.transform("all", named).alias("dsts"))

    return links_of


def part_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return order_parts(spark, sf).select(F.col("dst").alias("node")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def territory(spark: SparkSession, sf: str) -> DataFrame:
    def link(df: DataFrame, p: str, a: str, q: str, b: str) -> DataFrame:
        return df.select(F.concat(F.lit(p), a).alias("src"), F.concat(F.lit(q), b).alias("dst")).distinct()

    n, s, li = (load(spark, sf, t) for t in ("nation", "supplier", "lineitem"))
    return link(n, "r", "n_regionkey", "n", "n_nationkey").union(link(s, "n", "s_nationkey", "s", "s_suppkey")).union(link(li, "s", "l_suppkey", "p", "l_partkey"))


def top_parts(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """(seed): the k parts on most orders.

    A part is on no more orders than it has rows. The k parts of most rows are counted by orders, and the least of these counts
    is the number of rows below which no part can be among the k, so only the orders of the other parts are told apart.
    """
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.concat(F.lit("p"), "l_partkey").alias("seed"), F.col("l_partkey").alias("p"))
    sizes = materialize(li.groupBy("p").agg(F.count("*").alias("n")), "part-rows")

    def orders_of(some: DataFrame) -> DataFrame:
        held = li.join(graph.written_small(some.select(F.col("p").alias("some"))), F.col("p").eqNullSafe(F.col("some")), "left_semi")
        return held.select("o", "seed").distinct().groupBy("seed").agg(F.count("*").alias("n"))

    first = orders_of(materialize(sizes.orderBy(F.col("n").desc()).limit(k).select("p"), "part-most")).agg(F.min("n")).first()[0]
    able = materialize(sizes.where(F.col("n") >= F.lit(first)).select("p"), "part-able")
    return materialize(orders_of(able).orderBy(F.col("n").desc(), "seed").limit(k).select("seed"), "part-top")


def top_sql(k: int) -> str:
    return f"seeds AS (SELECT dst AS seed FROM (SELECT dst, count(*) AS n FROM e GROUP BY dst ORDER BY n DESC, dst LIMIT {k}))"


@query("in_degree", f"WITH {E_SQL} SELECT node, count(src) AS in_degree FROM nodes LEFT JOIN e ON e.dst = node GROUP BY node")
def in_degree(spark: SparkSession, sf: str) -> DataFrame:
    e = order_parts(spark, sf)
    return graph.degrees(nodes_of(e), e).select("node", "in_degree")


@query("total_degree", f"WITH {E_SQL}, x AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*) AS total_degree FROM x GROUP BY node")
def total_degree(spark: SparkSession, sf: str) -> DataFrame:
    e = order_parts(spark, sf)
    return graph.degrees(nodes_of(e), e).select("node", "total_degree")


@query("reverse_adjacency", f"WITH {E_SQL} SELECT dst AS node, string_agg(src, ' ' ORDER BY src) AS sources FROM e GROUP BY dst")
def reverse_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    r = graph.reverse(order_parts(spark, sf))
    return r.groupBy(F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("dst")), " ").alias("sources"))


HUB_SQL = """c AS (SELECT dst AS node, count(*) AS i FROM {e} GROUP BY dst HAVING count(*) >= 2),
k AS (SELECT node, i, i::DOUBLE / max(i) OVER () AS composite, row_number() OVER (ORDER BY i) - 1 AS idx, count(*) OVER () AS n FROM c),
bar AS (SELECT max(composite) FILTER (idx = floor(n * 0.7)) AS bar FROM k)"""


@query("hubs", f"WITH {E_SQL}, {HUB_SQL.format(e='e')} SELECT node, i AS in_degree, round(composite, 6) AS composite, composite >= bar AND composite > 0 AS is_hub FROM k CROSS JOIN bar QUALIFY row_number() OVER (ORDER BY composite DESC, node) <= 10")
def hub_list(spark: SparkSession, sf: str) -> DataFrame:
    e = order_parts(spark, sf)
    return graph.hubs(nodes_of(e), e).select("node", "in_degree", F.round("composite", 6).alias("composite"), "is_hub")


@query("hub_flags", f"WITH {P_SQL}, {HUB_SQL.format(e='pp')} SELECT node, i AS in_degree, composite >= bar AS is_hub FROM k CROSS JOIN bar QUALIFY row_number() OVER (ORDER BY composite DESC, node) <= 1000")
def hub_flags(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hubs(part_nodes(spark, sf), part_parts(spark, sf), top=1000).select("node", "in_degree", "is_hub")


CLUSTER_SQL = """deg AS (SELECT src AS node, count(*) AS degree FROM pp GROUP BY src),
tri AS (SELECT a.src AS node, count(*) AS links FROM pp a JOIN pp b ON a.src = b.src AND a.dst < b.dst JOIN pp c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src),
cl AS (SELECT deg.node, degree, CASE WHEN degree < 2 THEN 0 ELSE 2.0::DOUBLE * coalesce(links, 0) / (degree * (degree - 1)) END AS clustering FROM deg LEFT JOIN tri ON tri.node = deg.node)"""


@query("clustering_coefficient", f"WITH {P_SQL}, {CLUSTER_SQL} SELECT node, degree, round(clustering, 6) AS clustering FROM cl")
def clustering_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    return graph.clustering(part_parts(spark, sf)).withColumn("clustering", F.round("clustering", 6))


VERDICT_SQL = f"""WITH {P_SQL}, {CLUSTER_SQL}, h AS (SELECT * FROM cl QUALIFY row_number() OVER (ORDER BY degree DESC, node) <= 50),
v AS (SELECT node, degree, round(clustering, 6) AS clustering, round(percent_rank() OVER (ORDER BY round(clustering, 9)), 6) AS percentile FROM h),
w AS (SELECT *, CASE WHEN degree < 30 THEN 'building' WHEN percentile >= 0.75 THEN 'crystallized' WHEN percentile >= 0.5 THEN 'transition' ELSE 'star' END AS verdict FROM v)"""


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    e = materialize(part_parts(spark, sf), "verdict-links")
    best = graph.hubs(part_nodes(spark, sf), e, top=50).select("node")
    measured = graph.clustering(e, best).withColumn("clustering", F.round("clustering", 9))
    return graph.hub_verdicts(measured).select("node", "degree", F.round("clustering", 6).alias("clustering"), F.round("percentile", 6).alias("percentile"), "verdict")


@query("hub_verdicts", VERDICT_SQL + " SELECT * FROM w")
def hub_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf)


@query("crystallized", VERDICT_SQL + " SELECT node, degree, clustering, percentile FROM w WHERE verdict = 'crystallized'")
def crystallized(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).where("verdict = 'crystallized'").drop("verdict")


def _cocite_sql(least: int, cap: int | None) -> str:
    rare = f"HAVING count(*) < {cap}" if cap else ""
    return f"""WITH {E_SQL}, c AS (SELECT dst, count(*) AS citing FROM e GROUP BY dst {rare}), d AS (SELECT src, count(*) AS degree FROM e GROUP BY src),
s AS (SELECT a.src AS self, b.src AS candidate, count(*) AS shared, round(sum(1.0::DOUBLE / (1 + citing)), 9) AS weight, min(citing) AS rarest
  FROM e a JOIN c ON a.dst = c.dst JOIN e b ON b.dst = a.dst AND b.src <> a.src GROUP BY a.src, b.src HAVING count(*) >= {least})
SELECT self, candidate, shared, round(weight, 6) AS weight, rarest, row_number() OVER (PARTITION BY self ORDER BY shared DESC, weight DESC, rarest, degree, candidate) AS rank
FROM s JOIN d ON d.src = candidate QUALIFY rank <= 5"""


def _cocite(spark: SparkSession, sf: str, **how: int) -> DataFrame:
    e = order_parts(spark, sf)
    found = graph.co_citation(e, e.select(F.col("src").alias("self")).distinct(), limit=5, **how)
    return found.select("self", "candidate", "shared", F.round("weight", 6).alias("weight"), "rarest", F.col("rank").cast("long").alias("rank"))


@query("co_citation", _cocite_sql(2, None))
def co_citation(spark: SparkSession, sf: str) -> DataFrame:
    return _cocite(spark, sf)


#: Each part goes into the one that most orders have together with it.
MERGE_SQL = f"""WITH RECURSIVE {E_SQL}, pr AS (SELECT a.dst AS source, b.dst AS target, count(*) AS score FROM e a JOIN e b ON a.src = b.src AND a.dst <> b.dst GROUP BY ALL),
go AS (SELECT source, target FROM pr QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, target) = 1),
walk AS (SELECT source, target AS node, [source] AS seen FROM go UNION ALL SELECT w.source, g.target, list_append(seen, node) FROM walk w JOIN go g ON g.source = w.node WHERE NOT list_contains(seen, node)),
fin AS (SELECT source, node, seen FROM walk QUALIFY row_number() OVER (PARTITION BY source ORDER BY len(seen) DESC) = 1),
mv AS (SELECT * FROM (SELECT source, CASE WHEN list_contains(seen, node) THEN list_min(seen[list_position(seen, node):]) ELSE node END AS target FROM fin) WHERE source <> target)"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    e = materialize(order_parts(spark, sf), "merge-links")
    together = e.select("src", F.col("dst").alias("source")).join(e.select("src", F.col("dst").alias("target")), "src").where("source <> target")
    return merge.redirects(together.groupBy("source", "target").agg(F.count("*").alias("score")))


@query("merge_targets", MERGE_SQL + " SELECT source, target FROM mv")
def merge_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


@query("links_merged", MERGE_SQL + " SELECT DISTINCT src, coalesce(target, dst) AS dst FROM e LEFT JOIN mv ON mv.source = e.dst")
def links_merged(spark: SparkSession, sf: str) -> DataFrame:
    return merge.redirect_links(order_parts(spark, sf), materialize(_merged(spark, sf), "merge-moved"))


KEPT_SQL = f"""WITH {E_SQL}, c AS (SELECT dst, count(*) AS citing FROM e GROUP BY dst)"""


def changed_links(spark: SparkSession, sf: str, paired: bool) -> LinkIndex:
    """The orders' links to parts, after a start with links missing, others added and some orders that are gone."""
    e = materialize(order_parts(spark, sf), "links-all")
    draw = F.pmod(F.hash("src"), F.lit(7))
    former = e.where(draw != 3).withColumn("dst", F.when((draw == 1) & (F.pmod(F.hash("dst"), F.lit(2)) == 0), F.lit("p1")).otherwise(F.col("dst")))
    gone = e.where(draw == 5).select(F.concat(F.lit("x"), "src").alias("src"), "dst")
    index = LinkIndex(Store(spark, f"{shared_dir(spark)}/links-{uuid.uuid4().hex}", 8), paired=paired).update(former.unionByName(gone))
    index.update(e.where(draw.isin(1, 3)))
    return index.update(e.where("false"), gone.select("src"))


@query("links_after_changes", KEPT_SQL + " SELECT dst AS node, citing AS in_degree FROM c")
def links_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changed_links(spark, sf, False).in_degrees()


@query("co_cited_after_changes", KEPT_SQL + f""" SELECT a.src AS a, b.src AS b, count(*) AS shared FROM e a JOIN c USING (dst) JOIN e b USING (dst) WHERE citing < {CAP} AND a.src <> b.src GROUP BY ALL""")
def co_cited_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changed_links(spark, sf, True).co_cited()


@query("co_citation_specific", _cocite_sql(1, 25))
def co_citation_specific(spark: SparkSession, sf: str) -> DataFrame:
    return _cocite(spark, sf, specificity=25)


@query("incremental_edges", f"WITH {E_SQL}, m AS (SELECT max(src) AS page FROM e) SELECT src, dst FROM e, m WHERE src <> page UNION SELECT page, 'p' || p_partkey FROM m, part WHERE p_size = 1")
def incremental_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = order_parts(spark, sf)
    page = e.agg(F.max("src")).first()[0]
    fresh = load(spark, sf, "part").where("p_size = 1").select(F.lit(page).alias("src"), F.concat(F.lit("p"), "p_partkey").alias("dst"))
    return graph.replace_out_edges(e, F.lit(page), fresh)


def ppr_sql(edges: str, seeds: str = "seeds") -> str:
    steps = [f"mv AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM {edges}), m0 AS (SELECT DISTINCT seed, seed AS node, 1.0::DOUBLE AS mass FROM {seeds})"]
    for k in range(1, 11):
        steps.append(f"""g{k} AS (SELECT seed, dst AS node, sum(mass * share * 0.7::DOUBLE) AS mass FROM m{k - 1} m JOIN mv ON mv.src = m.node GROUP BY seed, dst),
m{k} AS (SELECT seed, node, sum(mass) AS mass FROM (SELECT * FROM g{k} UNION ALL SELECT s.seed, s.seed, 1 - coalesce((SELECT sum(mass) FROM g{k} g WHERE g.seed = s.seed), 0) FROM m0 s) GROUP BY seed, node)""")
    union = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(11))
    return ",\n".join(steps) + f", ppr AS (SELECT seed, node, sum(mass) / 11 AS score FROM ({union}) GROUP BY seed, node)"


@query("ppr_single_seed", f"WITH {P_SQL}, {top_sql(1)}, {ppr_sql('pp')} SELECT node, round(score, 8) AS score FROM ppr")
def ppr_single_seed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.personalised_pagerank(part_links(spark, sf), top_parts(spark, sf, 1)).select("node", F.round("score", 8).alias("score"))


@query("ppr_multi_seed_max", f"WITH {P_SQL}, {top_sql(5)}, {ppr_sql('pp')} SELECT node, round(max(score), 8) AS score FROM ppr GROUP BY node")
def ppr_multi_seed_max(spark: SparkSession, sf: str) -> DataFrame:
    ranks = graph.personalised_pagerank(part_links(spark, sf), top_parts(spark, sf, 5))
    return graph.merge_seeds(ranks).withColumn("score", F.round("score", 8))


#: The eight parts most often ordered with each of the ten parts on most orders.
RELATED_SQL = f"""{top_sql(10)}, rel AS (SELECT seed AS hub, b.dst AS target FROM seeds JOIN e a ON a.dst = seed JOIN e b ON b.src = a.src AND b.dst <> seed GROUP BY seed, b.dst
  QUALIFY row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, b.dst) <= 8), targets AS (SELECT DISTINCT target AS seed FROM rel)"""
DISTINCT_SQL = f"""WITH {P_SQL}, {RELATED_SQL}, {ppr_sql("pp", "targets")},
red AS (SELECT r.hub, r.target, avg(coalesce(score, 0)) AS red FROM rel r JOIN rel s ON r.hub = s.hub AND r.target <> s.target LEFT JOIN ppr ON ppr.seed = s.target AND ppr.node = r.target GROUP BY r.hub, r.target),
dis AS (SELECT hub, target, CASE WHEN max(red) OVER (PARTITION BY hub) <= 1e-4 THEN 1 ELSE 1 - red / max(red) OVER (PARTITION BY hub) END AS d FROM red)"""


def _distinct(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    hub = li.join(F.broadcast(top_parts(spark, sf, 10)), F.col("dst") == F.col("seed")).select(F.col("dst").alias("hub"), "o").distinct()
    pairs = graph.written_small(materialize(hub, "hub-orders")).join(li, "o").where("dst <> hub").distinct().groupBy("hub", F.col("dst").alias("target")).agg(F.count("*").alias("n"))
    related = pairs.withColumn("at", F.row_number().over(Window.partitionBy("hub").orderBy(F.col("n").desc(), "target"))).where("at <= 8").select("hub", "target")
    return graph.link_distinctiveness(part_links(spark, sf), graph.materialize(related, "related"))


@query("link_distinctiveness", DISTINCT_SQL + " SELECT hub, target, round(d, 6) AS distinctiveness FROM dis")
def link_distinctiveness(spark: SparkSession, sf: str) -> DataFrame:
    return _distinct(spark, sf).withColumn("distinctiveness", F.round("distinctiveness", 6))


@query("hub_density", DISTINCT_SQL + ", m AS (SELECT hub, count(*) AS links, avg(d) AS mean FROM dis GROUP BY hub) SELECT hub, links, round(mean, 6) AS mean, CASE WHEN mean < 0.3 THEN 'strip' WHEN mean < 0.5 THEN 'review' ELSE 'keep' END AS advice FROM m")
def hub_density(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hub_density(_distinct(spark, sf)).select("hub", "links", F.round("mean", 6).alias("mean"), "advice")


@query("reach_directed", f"""WITH RECURSIVE {T_SQL}, w AS (SELECT DISTINCT src AS seed, src AS node, 0 AS hop FROM t WHERE src LIKE 'r%' UNION SELECT seed, t.dst, hop + 1 FROM w JOIN t ON t.src = w.node WHERE hop < 3)
SELECT seed, node, min(hop) AS hop FROM w GROUP BY seed, node""")
def reach_directed(spark: SparkSession, sf: str) -> DataFrame:
    t = territory(spark, sf)
    return graph.reachable(t, t.where("src LIKE 'r%'").select(F.col("src").alias("seed")).distinct(), 3)


@query("reach_undirected", f"""WITH {P_SQL}, {top_sql(1)}, h1 AS (SELECT DISTINCT seed, dst AS node FROM seeds JOIN pp ON src = seed), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN pp ON src = node),
a AS (SELECT seed, seed AS node, 0 AS hop FROM seeds UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) SELECT seed, node, min(hop) AS hop FROM a GROUP BY seed, node""")
def reach_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reachable(part_parts(spark, sf), top_parts(spark, sf, 1), 2, both_ways=True)


@query("weak_component_share", f"""WITH RECURSIVE {T_SQL}, u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), c AS (SELECT min(node) AS node FROM tn UNION SELECT u.dst FROM c JOIN u ON u.src = c.node),
m AS (SELECT (SELECT count(*) FROM tn) AS pages, (SELECT count(*) FROM t) AS edges, (SELECT count(*) FROM c) AS component)
SELECT pages, edges, component, round(edges / pages, 6) AS density, round(component / pages, 6) AS share, pages >= 30 AND edges >= 30 AND edges / pages >= 1 AND component / pages > 0.5 AS mature FROM m""")
def weak_component_share(spark: SparkSession, sf: str) -> DataFrame:
    t = territory(spark, sf)
    return graph.mature(nodes_of(t), t).select("pages", "edges", "component", F.round("density", 6).alias("density"), F.round("share", 6).alias("share"), "mature")


@query("graph_audit", f"""WITH {P_SQL}, top AS (SELECT dst AS node, count(*) AS i FROM pp GROUP BY dst ORDER BY i DESC, node LIMIT 10)
SELECT (SELECT count(*) FROM pn) AS nodes, (SELECT count(*) FROM pp) AS edges, round((SELECT sum(i) FROM top) / (SELECT count(*) FROM pp), 6) AS top_share,
round((SELECT count(*) FROM pp WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)) / 90.0, 6)::DOUBLE AS top_density""")
def graph_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = graph.audit(part_nodes(spark, sf), part_parts(spark, sf))
    return a.select("nodes", "edges", F.round("top_share", 6).alias("top_share"), F.round("top_density", 6).alias("top_density"))


@query("intra_source_edges", f"WITH {P_SQL}, b AS (SELECT 'p' || p_partkey AS node, p_brand AS source FROM part), x AS (SELECT s.source AS ss, d.source AS ds FROM pp LEFT JOIN b s ON s.node = src LEFT JOIN b d ON d.node = dst) SELECT count(*) AS edges, count(ss || ds) AS attributed, count(*) FILTER (ss = ds) AS within, round(count(*) FILTER (ss = ds) / count(ss || ds), 6) AS share FROM x")
def intra_source_edges(spark: SparkSession, sf: str) -> DataFrame:
    brands = load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_brand").alias("source"))
    return graph.source_edge_share(part_parts(spark, sf), brands).withColumn("share", F.round("share", 6))


@query("undirected_adjacency", f"WITH {E_SQL}, x AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS node, count(*) AS neighbours FROM x GROUP BY src")
def undirected_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.undirected(order_parts(spark, sf)).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("neighbours"))
