"""Data-quality, upkeep and evaluation queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import fnv1a, format_bytes, hex32, source_slug
from marlstone.operators import evaluation, lint, retrieval, upkeep
from marlstone.plans import retrieval_queries as rq
from marlstone.plans.registry import load, query

FOLD_SQL = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
Q_SQL = f"qn AS (SELECT item_id, {FOLD_SQL.format('text')} AS q FROM benchmark), dn AS (SELECT doc_id, {FOLD_SQL.format('coalesce(text, chr(32))')} AS b FROM documents)"


def _quotes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    quotes = load(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return quotes, load(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("body"))


@query("quote_grounded", f"WITH {Q_SQL} SELECT item_id AS quote_id, doc_id AS source_id FROM qn JOIN dn ON contains(b, q) WHERE q <> ''")
def quote_grounded(spark: SparkSession, sf: str) -> DataFrame:
    return lint.grounded(*_quotes(spark, sf))


@query("ungrounded_quotes", f"WITH {Q_SQL} SELECT item_id AS quote_id FROM qn WHERE NOT EXISTS (SELECT 1 FROM dn WHERE contains(b, q))")
def ungrounded_quotes(spark: SparkSession, sf: str) -> DataFrame:
    quotes, sources = _quotes(spark, sf)
    return quotes.select("quote_id").join(lint.grounded(quotes, sources).select("quote_id").distinct(), "quote_id", "left_anti")


@query("contamination_rate", f"WITH {Q_SQL}, h AS (SELECT DISTINCT doc_id FROM qn JOIN dn ON contains(b, q) WHERE q <> '') SELECT count(*) AS docs, (SELECT count(*) FROM h) AS leaked, round((SELECT count(*) FROM h) / count(*), 6) AS share FROM documents")
def contamination_rate(spark: SparkSession, sf: str) -> DataFrame:
    leaked = lint.grounded(*_quotes(spark, sf)).agg(F.count_distinct("source_id").alias("leaked"))
    return load(spark, sf, "documents").agg(F.count("*").alias("docs")).crossJoin(leaked).withColumn("share", F.round(F.col("leaked") / F.col("docs"), 6))


@query("statement_partial_6gram", f"""WITH {Q_SQL}, qw AS (SELECT item_id, q, string_split(q, ' ') AS w FROM qn), dw AS (SELECT doc_id, b, string_split(b, ' ') AS w FROM dn),
qr AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 5], ' ') AS run FROM qw, unnest(range(1, len(w) - 4)) AS u(i)), dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 5], ' ') AS run FROM dw, unnest(range(1, len(w) - 4)) AS u(i)),
h AS (SELECT DISTINCT item_id, doc_id FROM qr JOIN dr ON qr.run = dr.run)
SELECT h.item_id AS statement_id, h.doc_id AS body_id, CASE WHEN contains(b, q) THEN 'exact' ELSE 'partial' END AS match FROM h JOIN qn ON qn.item_id = h.item_id JOIN dn ON dn.doc_id = h.doc_id""".replace("FROM documents)", "FROM documents)"))
def statement_partial_6gram(spark: SparkSession, sf: str) -> DataFrame:
    quotes, sources = _quotes(spark, sf)
    strip = lambda c: F.regexp_replace(c, r"[*_`~>#\[\]^|]", "")  # noqa: E731  markup marks, as the fold drops them
    return lint.statement_match(quotes.select(F.col("quote_id").alias("statement_id"), strip(F.col("quote")).alias("statement")), sources.select(F.col("source_id").alias("body_id"), strip(F.col("body")).alias("body")))


HREF_SQL = "l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<a href=\"/([^\"]*)\"', 1)) AS target FROM pages), s AS (SELECT page_id, regexp_extract(url, '://[^/]*/[a-z]+/([0-9]+)', 1) AS slug, '/' || regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages)"


def _hrefs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select(F.col("page_id").alias("source"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="/([^"]*)"'), 1)).alias("target")).distinct()


def _slugs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select(F.col("page_id").alias("path"), F.regexp_extract("url", r"://[^/]*/[a-z]+/([0-9]+)", 1).alias("slug"))


@query("dead_links", f"WITH {HREF_SQL} SELECT page_id AS source, target FROM l WHERE target NOT IN (SELECT slug FROM s) AND lower(target) NOT IN (SELECT slug FROM s)")
def dead_links(spark: SparkSession, sf: str) -> DataFrame:
    return lint.dead_links(_hrefs(spark, sf), _slugs(spark, sf).select(F.col("slug").alias("target"))).select("source", "target")


@query("orphans", f"WITH {HREF_SQL} SELECT page_id AS path FROM s WHERE slug NOT IN (SELECT target FROM l)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    slugs = _slugs(spark, sf)
    return slugs.join(_hrefs(spark, sf).select(F.col("target").alias("slug")).distinct(), "slug", "left_anti").select("path")


@query("known_targets", """WITH f AS (SELECT DISTINCT string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS parts FROM pages), x AS (SELECT DISTINCT array_to_string(parts[i:], '/') AS t FROM f, unnest(range(1, len(parts) + 1)) AS u(i)),
y AS (SELECT t FROM x UNION SELECT t || '.md' FROM x) SELECT DISTINCT target FROM (SELECT t AS target FROM y UNION ALL SELECT lower(t) FROM y)""")
def known_targets(spark: SparkSession, sf: str) -> DataFrame:
    return lint.known_targets(load(spark, sf, "pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("path")).distinct())


@query("tag_violations", """WITH p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'entity' WHEN lang = 'de' THEN 'concept' ELSE 'source' END AS type, [lang, source] AS tags FROM documents),
v AS (SELECT doc_id AS path, type, [t FOR t IN tags IF t NOT IN ('en', 'de', 'fr', 'src0', 'src1', 'src2') OR (type = 'concept' AND t = 'src2')] AS invalid FROM p) SELECT path, type, array_to_string(invalid, ' ') AS invalid FROM v WHERE len(invalid) > 0""")
def tag_violations(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "entity").when(F.col("lang") == "de", "concept").otherwise("source")
    pages = load(spark, sf, "documents").select(F.col("doc_id").alias("path"), kind.alias("type"), F.array("lang", "source").alias("tags"))
    common = ["en", "de", "fr", "src0", "src1", "src2"]
    allowed = spark.createDataFrame([("entity", common), ("concept", common[:-1]), ("source", common)], "type string, tags array<string>")
    return lint.tag_violations(pages, allowed).withColumn("invalid", F.array_join("invalid", " "))


@query("empty_pages", r"SELECT doc_id AS path FROM documents WHERE length(regexp_replace(coalesce(text, ''), '[#*\-_>\s\[\]|—]', '', 'g')) < 50")
def empty_pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").where(lint.is_empty_page(F.coalesce("text", F.lit("")))).select(F.col("doc_id").alias("path"))


@query("finding_counters", f"""WITH {Q_SQL}, {HREF_SQL} SELECT 'dead_links' AS kind, count(*) AS n FROM l WHERE target NOT IN (SELECT slug FROM s)
UNION ALL SELECT 'orphans', count(*) FROM s WHERE slug NOT IN (SELECT target FROM l)
UNION ALL SELECT 'ungrounded', count(*) FROM qn WHERE NOT EXISTS (SELECT 1 FROM dn WHERE contains(b, q))""")
def finding_counters(spark: SparkSession, sf: str) -> DataFrame:
    return lint.count_findings({"dead_links": dead_links(spark, sf), "orphans": orphans(spark, sf), "ungrounded": ungrounded_quotes(spark, sf)})


ENTRY_SQL = "c AS (SELECT event_id AS key, floor(value * 1000)::BIGINT AS size, ts AS mtime FROM events)"


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(F.col("event_id").alias("key"), F.floor(F.col("value") * 1000).cast("long").alias("size"), F.col("ts").alias("mtime"))


@query("lru_eviction", f"""WITH {ENTRY_SQL}, r AS (SELECT key, size, coalesce(sum(size) OVER w, 0) AS gone, coalesce(count(*) OVER w, 0) AS gone_n, sum(size) OVER () AS total, count(*) OVER () AS n FROM c WINDOW w AS (ORDER BY mtime, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, size FROM r WHERE total - gone > 104857600 OR n - gone_n > 5000""")
def lru_eviction(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.evicted(_entries(spark, sf), upkeep.CACHE["bytes"], 5000).select("key", "size")


@query("ttl_purge", f"WITH {ENTRY_SQL} SELECT count(*) AS removed, coalesce(sum(size), 0)::BIGINT AS freed FROM c WHERE mtime < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def ttl_purge(spark: SparkSession, sf: str) -> DataFrame:
    gone = upkeep.expired(_entries(spark, sf), F.lit("2024-02-15").cast("timestamp"))
    return gone.agg(F.count("*").alias("removed"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("freed"))


@query("ingest_caps_running", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents QUALIFY place <= 20")
def ingest_caps_running(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.capped(load(spark, sf, "documents").select("doc_id", "source"), 20, "source", "doc_id").select("doc_id", "source", F.col("at").cast("long").alias("place"))


@query("batch_limits", """SELECT doc_id, 20 AS batch, least(18, greatest(2, ceil(n_chars / 2000) + 2))::INTEGER AS batches, (CASE WHEN n_chars < 20000 THEN least(50, greatest(5, ceil(n_chars / 600))) ELSE 50 END)::INTEGER AS items FROM documents""")
def batch_limits(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", upkeep.batch_limits(F.col("n_chars")).alias("l")).select("doc_id", "l.*")


@query("cumulative_limits", "WITH b AS (SELECT source, lang AS batch, count(*) AS new FROM documents GROUP BY ALL) SELECT source, batch, new, (sum(new) OVER (PARTITION BY source ORDER BY batch))::BIGINT AS total, sum(new) OVER (PARTITION BY source ORDER BY batch) >= 30 AS stop FROM b")
def cumulative_limits(spark: SparkSession, sf: str) -> DataFrame:
    new = load(spark, sf, "documents").groupBy("source", F.col("lang").alias("batch")).agg(F.count("*").alias("new"))
    return upkeep.cumulative_stop(new, 30)


def _step(part: str) -> str:
    """A batch's size, whether it is the last, and what the next one starts with, from p.next and p.was of the batch before."""
    low = "(o.raw > 0 AND o.fresh > 0 AND o.raw::DOUBLE / {n} < 0.5 AND {n} > 5)"
    return f"{{n}} AS size, o.raw = 0 OR o.fresh = 0 OR ({low} AND {{w}}) AS stop, CASE WHEN {low} AND NOT {{w}} THEN greatest(5, {{n}} // 2) ELSE {{n}} END AS next, {{w}} OR {low} AS was".format(**dict(zip("nw", part.split())))


CONVERGENCE_SQL = f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS source, datediff('day', DATE '2024-01-01', ts::DATE) AS batch, event_type FROM events),
f AS (SELECT source, event_type, min(batch) AS batch FROM e GROUP BY ALL),
b AS (SELECT source, batch, count(*) AS raw FROM e GROUP BY ALL), n AS (SELECT source, batch, count(*) AS fresh FROM f GROUP BY ALL),
o AS (SELECT b.source, b.batch, raw, coalesce(fresh, 0) AS fresh, row_number() OVER (PARTITION BY b.source ORDER BY b.batch) AS place FROM b LEFT JOIN n ON n.source = b.source AND n.batch = b.batch),
r AS (SELECT o.source, o.batch, o.place, {_step('20 FALSE')} FROM o WHERE place = 1
  UNION ALL SELECT o.source, o.batch, o.place, {_step('r.next r.was')} FROM r JOIN o ON o.source = r.source AND o.place = r.place + 1 WHERE NOT r.stop)
SELECT source, batch::INTEGER AS batch, size::INTEGER AS size, stop FROM r"""


@query("convergence_steps", CONVERGENCE_SQL)
def convergence_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Users are sources, days batches, events raw items; a kind of event is new on the user's first day with it."""
    e = load(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), F.datediff("ts", F.lit("2024-01-01")).alias("batch"), "event_type")
    first = e.groupBy("source", "event_type").agg(F.min("batch").alias("batch")).groupBy("source", "batch").agg(F.count("*").cast("int").alias("new"))
    raw = e.groupBy("source", "batch").agg(F.count("*").cast("int").alias("raw"))
    return upkeep.convergence(raw.join(first, ["source", "batch"], "left").fillna(0, ["new"]))


@query("batch_merge", """WITH i AS (SELECT p_brand AS source, p_size AS batch, p_partkey AS pos, p_type AS name, p_name AS mention, min(p_size) OVER (PARTITION BY p_brand, lower(trim(p_type))) AS first FROM part),
later AS (SELECT source, name, mention, min(struct_pack(b := batch, p := pos)) AS came FROM i WHERE batch > first GROUP BY ALL),
kept AS (SELECT source, name, batch, mention, row_number() OVER (PARTITION BY source ORDER BY batch, pos) - 1 AS place FROM i WHERE batch = first)
SELECT k.source, k.name, batch::INTEGER AS batch, concat_ws('|', k.mention, (SELECT string_agg(mention, '|' ORDER BY came) FROM later l WHERE l.source = k.source AND l.name = k.name AND l.mention <> k.mention)) AS mentions, place::INTEGER AS place FROM kept k""")
def batch_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Brands are sources, sizes batches, part types items that part names mention; types come again in later sizes."""
    items = load(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_size").cast("int").alias("batch"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array("p_name").alias("mentions"))
    return upkeep.merge_batches(items).withColumn("mentions", F.array_join("mentions", "|"))


@query("kpi_delta_lag", """WITH d AS (SELECT event_type AS kind, ts::DATE AS day, round(sum(value), 4) AS kpi FROM events GROUP BY ALL), l AS (SELECT *, lag(kpi) OVER (PARTITION BY kind ORDER BY day) AS previous FROM d)
SELECT kind, day::VARCHAR AS day, kpi, previous, round(coalesce(kpi - previous, 0), 4) AS delta, CASE WHEN previous IS NULL THEN NULL WHEN kpi = previous THEN 'same' WHEN kpi > previous THEN 'up' ELSE 'down' END AS label FROM l""")
def kpi_delta_lag(spark: SparkSession, sf: str) -> DataFrame:
    daily = load(spark, sf, "events").groupBy(F.col("event_type").alias("kind"), F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("value"), 4).alias("kpi"))
    d = upkeep.deltas(daily, "kind", "day", "kpi")
    return d.select("kind", "day", "kpi", "previous", F.round("delta", 4).alias("delta"), upkeep.delta_label(F.round("delta", 4), F.col("previous")).alias("label"))


@query("history_filter_range", """SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'error') AND contains(lower(props), '1')
  AND date_trunc('day', ts) + INTERVAL 1 DAY >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def history_filter_range(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now"))
    kept = events.crossJoin(F.broadcast(now)).where(F.col("event_type").isin("signup", "error") & F.contains(F.lower("props"), F.lit("1")) & upkeep.within(F.col("ts"), F.col("now"), 7))
    return kept.select("event_id", "event_type")


@query("folder_rollup", """WITH f AS (SELECT string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS parts FROM pages)
SELECT array_to_string(parts[1:d], '/') AS folder, d::INTEGER AS depth, count(*) FILTER (d = len(parts) - 1) AS files, count(*) AS below FROM f, unnest(range(0, len(parts))) AS u(d) GROUP BY ALL""")
def folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.folder_tree(load(spark, sf, "pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("path"))).select("folder", "depth", "files", "below")


@query("gaps_and_islands", """WITH x AS (SELECT user_id AS entry, event_id AS pos, event_type AS heading, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS start FROM events),
r AS (SELECT *, sum(start) OVER (PARTITION BY entry ORDER BY pos) AS run FROM x) SELECT entry, min(pos) AS pos, min(heading) AS heading, count(*) AS count FROM r GROUP BY entry, run""")
def gaps_and_islands(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(F.col("user_id").alias("entry"), F.col("event_id").alias("pos"), F.col("event_type").alias("heading"), F.lit(1).alias("count"))
    return upkeep.merge_adjacent(rows).select("entry", "pos", "heading", "count")


TRUTH_SQL = f"{Q_SQL}, truth AS (SELECT item_id AS query_id, doc_id AS path FROM qn JOIN dn ON contains(b, q) WHERE q <> '')"
EVAL_SQL = rq.TOP_SQL.rstrip() + f", {TRUTH_SQL}"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return rq.index(spark, sf).best(rq.questions(spark, sf), 20, out_of_vocabulary=False).drop("by")


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return lint.grounded(*_quotes(spark, sf)).select(F.col("quote_id").alias("query_id"), F.col("source_id").alias("path"))


@query("recall_mrr", EVAL_SQL + """, m AS (SELECT t.query_id, count(*) FILTER (rank <= 10) / count(*) AS recall, coalesce(1.0 / min(rank), 0) AS rr FROM truth t LEFT JOIN top ON top.query_id = t.query_id AND top.path = t.path GROUP BY t.query_id)
SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6)::DOUBLE AS mrr FROM m""")
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluation.summary(evaluation.recall_and_rank(_ranked(spark, sf), _truth(spark, sf)))
    return s.select("queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("rank_inversions", EVAL_SQL + """, k AS (SELECT top.query_id, rank, CASE WHEN t.path IS NULL THEN 0 ELSE 1 END AS ok FROM top LEFT JOIN truth t ON t.query_id = top.query_id AND t.path = top.path)
SELECT a.query_id, count(*) FILTER (a.ok = 1 AND b.ok = 0 AND b.rank < a.rank) AS inversions FROM k a JOIN k b ON a.query_id = b.query_id GROUP BY a.query_id""")
def rank_inversions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.inversions(_ranked(spark, sf), _truth(spark, sf))


@query("source_diversity", rq.TOP_SQL.rstrip() + """, x AS (SELECT query_id, source_slug, count(*) AS n FROM top JOIN page ON page.path = top.path WHERE rank <= 10 GROUP BY ALL)
SELECT query_id, sum(n)::BIGINT AS loaded, count(source_slug) AS sources, round(max(n) FILTER (source_slug IS NOT NULL) / sum(n), 6) AS dominant, coalesce(sum(n) FILTER (source_slug IS NULL), 0)::BIGINT AS unattributed FROM x GROUP BY query_id""")
def source_diversity(spark: SparkSession, sf: str) -> DataFrame:
    sources = load(spark, sf, "documents").select(F.col("doc_id").alias("path"), "source")
    return evaluation.source_diversity(_ranked(spark, sf), sources).withColumn("dominant", F.round("dominant", 6))


BOOTSTRAP_SQL = EVAL_SQL + """, h AS (SELECT t.query_id::VARCHAR AS asker, sum(CASE WHEN coalesce(rank, 99) <= 10 THEN 1 ELSE 0 END) AS hit, count(*) AS n FROM truth t LEFT JOIN top ON top.query_id = t.query_id AND top.path = t.path GROUP BY t.query_id),
d AS (SELECT asker, hit, n, round, CAST('0x' || md5(asker || ':' || round)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u FROM h, range(400) r(round)),
w AS (SELECT *, len([p FOR p IN [{poisson}]::DOUBLE[] IF u >= p]) AS times FROM d),
m AS (SELECT round, sum(times * hit) / sum(times * n) AS mean FROM w GROUP BY round HAVING sum(times * n) > 0),
o AS (SELECT list_sort(list(mean)) AS m FROM m)
SELECT round((SELECT sum(hit) / sum(n) FROM h), 6) AS mean, round(m[1 + floor(0.025 * (len(m) - 1))::INTEGER], 6) AS low, round(m[1 + floor(0.975 * (len(m) - 1))::INTEGER], 6) AS high FROM o""".replace("{poisson}", ", ".join(map(str, evaluation.POISSON)))


@query("cluster_bootstrap", BOOTSTRAP_SQL)
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    hits = _truth(spark, sf).join(_ranked(spark, sf), ["query_id", "path"], "left").select(F.col("query_id").alias("asker"), (F.coalesce("rank", F.lit(99)) <= 10).cast("int").alias("hit"))
    return evaluation.cluster_bootstrap(hits).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


COS_SQL = "n AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS own, d.vec_id, d.label, round(array_cosine_similarity(q.v, d.v), 6) AS score FROM n q JOIN n d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)"


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100."""
    v = load(spark, sf, "embeddings").select("vec_id", "embedding")
    return evaluation.nearest_by_cosine(v, v.where("vec_id % 100 = 0"), 10)


@query("knn_cosine_topk", f"WITH {COS_SQL} SELECT query_id, vec_id, score, rank FROM k")
def knn_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@query("knn_label_agreement", f"WITH {COS_SQL} SELECT query_id, round(avg(CASE WHEN own = label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM k GROUP BY query_id")
def knn_label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    labels = load(spark, sf, "embeddings").select("vec_id", "label")
    near = _nearest(spark, sf).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return near.groupBy("query_id").agg(F.round(F.avg((F.col("own") == F.col("label")).cast("double")), 6).alias("agreement"))


@query("conversation_hash")
def conversation_hash(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    stream = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\0"), F.coalesce(t["text"], F.lit("")), F.lit("\0"))), "")
    return load(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", hex32(fnv1a(stream)).alias("hash"))


@query("conversation_retention", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def conversation_retention(spark: SparkSession, sf: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return load(spark, sf, "conversations").select("conv_id", "turn", "role", back.alias("back")).where("back <= 4").drop("back")


@query("byte_labels", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576 * 10 + 0.5) / 10) END AS size FROM documents")
def byte_labels(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", format_bytes(F.col("n_chars")).alias("size"))


@query("source_slugs")
def source_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", source_slug(F.regexp_extract("url", r"://([^?#]*)", 1)).alias("slug"))


VALUE_SQL = """v AS (SELECT doc_id, 'date' AS kind, unnest(regexp_extract_all(coalesce(text, ''), '\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b')) AS value FROM documents
  UNION ALL SELECT doc_id, 'percent', unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)? ?%')) FROM documents
  UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(coalesce(text, ''), '\\b[0-9]{5,}\\b')) FROM documents)"""


@query("value_harvest", f"WITH {VALUE_SQL} SELECT doc_id, kind, value, count(*) AS n FROM v GROUP BY ALL")
def value_harvest(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    kinds = {"date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "percent": r"[0-9]+(?:[.,][0-9]+)? ?%", "number": r"\b[0-9]{5,}\b"}
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), 0).alias("values")) for k, p in kinds.items()])
    flat = load(spark, sf, "documents").select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.kind", F.explode("f.values").alias("value"))
    return flat.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


@query("value_survival_grouping_sets", f"""WITH {VALUE_SQL}, o AS (SELECT DISTINCT v.doc_id, kind, value, lang AS page_type, CASE WHEN strpos(text, value) <= 500 THEN 'head' WHEN strpos(text, value) > n_chars - 500 THEN 'tail' ELSE 'middle' END AS position,
  CASE WHEN EXISTS (SELECT 1 FROM benchmark b WHERE contains(b.text, value)) THEN 'quoted' WHEN strpos(text, value || '.') > 0 THEN 'prose' ELSE 'absent' END AS outcome FROM v JOIN documents d ON d.doc_id = v.doc_id)
SELECT position, kind, page_type, count(*) FILTER (outcome = 'quoted') AS quoted, count(*) FILTER (outcome = 'prose') AS prose, count(*) FILTER (outcome = 'absent') AS absent, count(*) AS n, round(count(*) FILTER (outcome = 'absent') / count(*), 6) AS absent_share
FROM o GROUP BY GROUPING SETS ((position), (kind), (page_type), ())""")
def value_survival(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "n_chars")
    values = value_harvest(spark, sf).select("doc_id", "kind", "value")
    at = F.position(F.col("value"), F.col("text"))
    position = F.when(at <= 500, "head").when(at > F.col("n_chars") - 500, "tail").otherwise("middle")
    quoted = values.select("value").distinct().join(load(spark, sf, "benchmark").select(F.col("text").alias("item")), F.contains("item", F.col("value")), "left_semi").withColumn("quoted", F.lit(True))
    placed = values.join(docs, "doc_id").join(quoted, "value", "left")
    outcome = F.when(F.col("quoted"), "quoted").when(F.contains("text", F.concat("value", F.lit("."))), "prose").otherwise("absent")
    rows = placed.select(position.alias("position"), "kind", F.col("lang").alias("page_type"), outcome.alias("outcome"))
    return evaluation.survival(rows).withColumn("absent_share", F.round("absent_share", 6))
