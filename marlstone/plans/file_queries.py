"""What is written to files and read back, edits of texts in place, and names that links go by.

The SQL of these queries takes the values from the tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import frontedit, markup
from marlstone.operators import corpus, graph, upkeep
from marlstone.plans.registry import load, query
from marlstone.sources import wiki
from marlstone.sources.workspace import shared_dir

S = F.col
#: Characters of the log that log_kept keeps.
LOG_CHARS = 4000


def _say(form: str, *columns: str | Column) -> Column:
    return F.format_string(form, *[(S(c) if isinstance(c, str) else c).cast("string") for c in columns])


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(S("p_partkey").alias("id"), S("p_size").alias("size"), S("p_name").alias("name"), F.pmod("p_partkey", F.lit(7)).alias("k"))


PARTS = "WITH p AS (SELECT p_partkey AS id, p_size AS size, p_name AS name, p_partkey % 7 AS k FROM part)"


@query("front_spliced", PARTS + r""", c AS (SELECT *, CASE WHEN k = 0 THEN '' ELSE '---~type: entity~tags:~  - b' || k || '~  - c~odd: v' || id || '~---' END AS head, '~Body ' || name || '~tags: no~---~' AS tail FROM p)
  SELECT id, replace(CASE WHEN k = 0 THEN '---~type: t' || size || '~---~~' || tail ELSE replace(head, 'type: entity', 'type: t' || size) || tail END, '~', chr(10)) AS typed,
  replace(CASE WHEN k = 0 THEN '---~hash: $' || id || '~---~~' || tail ELSE left(head, length(head) - 4) || '~hash: $' || id || '~---' || tail END, '~', chr(10)) AS stamped,
  replace(replace(head, '~  - b' || k || '~  - c', '~  - "x' || size || '"') || tail, '~', chr(10)) AS listed,
  replace(replace(head, '~tags:~  - b' || k || '~  - c', '') || tail, '~', chr(10)) AS cleared,
  replace(CASE WHEN k = 0 THEN '---~tags:~  - "c"~  - "d' || k || '"~---~~' || tail ELSE replace(head, '~  - b' || k || '~  - c', '~  - "b' || k || '"~  - "c"~  - "d' || k || '"') || tail END, '~', chr(10)) AS added FROM c""")
def front_spliced(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(S("k") == 0, "").otherwise(_say("---\ntype: entity\ntags:\n  - b%s\n  - c\nodd: v%s\n---", "k", "id"))
    p = _parts(spark, sf).withColumn("content", F.concat(head, _say("\nBody %s\ntags: no\n---\n", "name")))
    p = p.withColumn("tags", markup.front_matter("content")["tags"])
    c = S("content")
    return p.select(
        "id", frontedit.set_field(c, "type", _say("t%s", "size")).alias("typed"), frontedit.set_field(c, "hash", _say("$%s", "id")).alias("stamped"),
        frontedit.set_list(c, "tags", F.array(_say("x%s", "size"))).alias("listed"), frontedit.replace_list(c, "tags", F.array().cast("array<string>")).alias("cleared"),
        frontedit.add_to_list(c, "tags", S("tags"), F.array(F.lit("c"), _say("d%s", "k"))).alias("added"),
    )


@query("index_written", PARTS + """ SELECT 'f' || k || '/p' || id AS path, 'p' || id AS title, CASE WHEN k > 2 THEN 'a' || size || '|b c' ELSE '' END AS aliases, CASE WHEN k > 0 THEN 's' || size END AS source_slug,
  CASE WHEN k = 1 THEN 'No summary' ELSE rtrim(left('First of ' || name || repeat(' more', 20), 100)) END AS summary FROM p""")
def index_written(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(S("k") == 1, _say("---\ntype: x\n---\n# %s\n\n---\n", "name")).otherwise(_say("---\ntype: x\n---\n# %s\n\nFirst of %s%s\nlater", "name", "name", F.repeat(F.lit(" more"), F.lit(20))))
    sources = F.when(S("k") > 0, F.array(F.lit("[[notes/n]]"), _say("[[sources/s%s.md|shown]]", "size"), F.lit("[[sources/later]]"))).otherwise(F.array(F.lit("[[notes/n]]")))
    aliases = F.when(S("k") > 2, F.array(_say("a%s", "size"), F.lit("b c"))).otherwise(F.array().cast("array<string>"))
    pages = _parts(spark, sf).select(_say("f%s", "k").alias("folder"), _say("f%s/p%s", "k", "id").alias("path"), _say("p%s", "id").alias("title"), aliases.alias("aliases"), wiki.primary_source(sources).alias("source_slug"), wiki.first_body_line(text).alias("summary"))
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    wiki.write_index(pages, path)
    return wiki.read_index(spark, path).withColumn("aliases", F.array_join("aliases", "|"))


@query("log_kept", f"""WITH e AS (SELECT s_suppkey AS id, 2 * s_suppkey AS pos, '## [2024-05-0' || (1 + s_suppkey % 9) || '] ingest | n' || s_suppkey AS line FROM supplier UNION ALL
  SELECT s_suppkey, 2 * s_suppkey + 1, '- Created: ' || s_nationkey || ', updated: ' || s_suppkey FROM supplier),
  t AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY pos DESC) AS after FROM e), k AS (SELECT * FROM t WHERE after <= {LOG_CHARS})
  SELECT pos, line FROM k WHERE pos >= (SELECT min(pos) FROM k WHERE line LIKE '## %')""")
def log_kept(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").select(S("s_suppkey").alias("id"), _say("2024-05-0%s", 1 + S("s_suppkey") % 9).alias("date"), F.lit("ingest").alias("operation"), _say("n%s", "s_suppkey").alias("title"), S("s_nationkey").alias("created"), S("s_suppkey").alias("updated"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for half in (S("created") < 12, S("created") >= 12):  # two appends; together they are the whole table
        wiki.append_log(s.where(half), path)
    entries = spark.read.schema(s.schema).parquet(path)
    told = F.array(_say("## [%s] %s | %s", "date", "operation", "title"), _say("- Created: %s, updated: %s", "created", "updated"))
    return upkeep.trim_log(entries.select("id", F.posexplode(told).alias("at", "line")).select((2 * S("id") + S("at")).cast("long").alias("pos"), "line"), LOG_CHARS)


@query("page_paths", PARTS + " SELECT id, k IN (0, 6) AS page FROM p")
def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    forms = ("wiki/entities/p%s.md", "wiki/a%s/index.md", "wiki/b%s/log.md", "wiki/schema/p%s.md", "wiki/contradictions/p%s.md", "wikis/p%s.md", "wiki/p%s/indexed.md")
    path = F.element_at(F.array(*[_say(f, "id") for f in forms]), (S("k") + 1).cast("int"))
    return _parts(spark, sf).select("id", wiki.is_page(path, "wiki/").alias("page"))


@query("bodies_attached", "SELECT p_partkey AS path, p_name AS title, text IS NULL AS missing, md5(text) AS body FROM part LEFT JOIN documents ON p_partkey = doc_id")
def bodies_attached(spark: SparkSession, sf: str) -> DataFrame:
    refs = load(spark, sf, "part").select(S("p_partkey").alias("path"), S("p_name").alias("title"), F.lit("begin").alias("text"))
    joined = corpus.attach_bodies(refs, load(spark, sf, "documents").select(S("doc_id").alias("path"), "text"))
    return joined.select("path", "title", S("text").isNull().alias("missing"), F.md5("text").alias("body"))


@query("incoming_by_name", """WITH p AS (SELECT p_partkey AS pos, 'e/p' || p_partkey || '.md' AS path, 't' || p_partkey // 2 AS title, p_partkey AS id, p_size AS size FROM part),
  l AS (SELECT path AS src, 0 AS place, 't' || size AS link FROM p UNION ALL SELECT path, 1, 'p' || (id + 1) || '.md' FROM p UNION ALL SELECT path, 2, 'e/p' || size FROM p
    UNION ALL SELECT path, 3, 'p' || id FROM p UNION ALL SELECT path, 4, 't' || size FROM p),
  t AS (SELECT title, max_by(path, pos) AS titled FROM p GROUP BY 1),
  r AS (SELECT src, place, coalesce(titled, n.path) AS dst FROM l LEFT JOIN t ON t.title = link LEFT JOIN p n ON 'p' || n.id = regexp_replace(link, '\\.md$', ''))
  SELECT src, dst, min(place)::INTEGER AS pos FROM r WHERE dst <> src GROUP BY 1, 2""")
def incoming_by_name(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    content = _say("[[t%s]] and [[ p%s.md |x]], [[e/p%s]] [[p%s#h]] [[t%s|again]]", "size", S("id") + 1, "size", "id", "size")
    return graph.incoming_index(p.select(S("id").alias("pos"), _say("e/p%s.md", "id").alias("path"), _say("t%s", F.floor(S("id") / 2)).alias("title"), content.alias("content")))
