"""Retrieval queries over documents as pages, benchmark passages as questions and conversations as history."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import body_hash, context_keywords, estimate_tokens, lexically_reliable, spaced_words, tokenize_query, word_grams
from marlstone.operators import corpus, retrieval
from marlstone.operators.running import running_sum
from marlstone.operators.termindex import FORMAT, TermIndex, kept
from marlstone.plans.registry import load, query
from marlstone.sources.versioned import Store
from marlstone.sources.workspace import file_signature, shared_dir

#: Buckets of the kept index.
INDEX_BUCKETS = 16
WORD = r"[\p{L}\p{N}\p{M}]+"
FIELD_SQL = f"""
page AS (SELECT doc_id AS path, array_to_string(regexp_split_to_array(trim(coalesce(text, '')), '\\s+')[1:8], ' ') AS title,
  left(coalesce(text, ''), 200) AS summary, coalesce(text, '') AS text, source AS source_slug FROM documents),
ft AS (SELECT path, 'title' AS field, regexp_extract_all(lower(title), '{WORD}') AS terms FROM page
  UNION ALL SELECT path, 'alias', []::VARCHAR[] FROM page
  UNION ALL SELECT path, 'summary', regexp_extract_all(lower(summary), '{WORD}') FROM page
  UNION ALL SELECT path, 'text', regexp_extract_all(lower(text), '{WORD}') FROM page),
post AS (SELECT path, field, term, count(*) AS tf FROM (SELECT path, field, unnest(terms) AS term FROM ft) GROUP BY ALL),
len AS (SELECT path, field, len(terms) AS length FROM ft),
stats AS (SELECT count(*) FILTER (field = 'title') AS n, coalesce(avg(length) FILTER (field = 'title' AND length > 0), 0) AS avg_title, 0.0 AS avg_alias,
  coalesce(avg(length) FILTER (field = 'summary' AND length > 0), 0) AS avg_summary, coalesce(avg(length) FILTER (field = 'text' AND length > 0), 0) AS avg_text FROM len),
df AS (SELECT term, count(DISTINCT path) AS df FROM post GROUP BY term)"""
#: Questions: the benchmark passages, all their words.
QUESTION_SQL = f"""
q0 AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM benchmark),
q AS (SELECT DISTINCT query_id, term, 1.0 AS weight FROM q0)"""


def score_sql(queries: str, name: str) -> str:
    """CTEs that score the relation `queries` and leave (query_id, path, score, found) in `name`."""
    norm = "CASE p.field WHEN 'text' THEN 1 ELSE 1 - 0.75 + 0.75 * length / (CASE p.field WHEN 'title' THEN avg_title ELSE avg_summary END) END"
    return f"""
{name}_w AS (SELECT p.path, p.term, sum((CASE p.field WHEN 'title' THEN 3.0 WHEN 'alias' THEN 2.0 ELSE 1.0 END) * (tf / (1.2 * ({norm}) + tf))) AS w
  FROM post p JOIN len l ON p.path = l.path AND p.field = l.field CROSS JOIN stats WHERE p.term IN (SELECT term FROM {queries}) GROUP BY p.path, p.term),
{name} AS (SELECT query_id, path, round(sum(q.weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * w / (1.2 + w)), 9) AS score, count(*) AS found
  FROM {queries} q JOIN {name}_w w ON q.term = w.term JOIN df ON df.term = q.term CROSS JOIN stats GROUP BY query_id, path HAVING sum(q.weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * w / (1.2 + w)) > 0)"""


def rank_sql(source: str, name: str, k: int) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM {source} QUALIFY rank <= {k})"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.pages_from_documents(load(spark, sf, "documents"))


def terms(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.field_terms(pages(spark, sf))


def index(spark: SparkSession, sf: str) -> TermIndex:
    """The kept term index of the documents, made on first use and brought up to date when their files change."""
    root = f"{shared_dir(spark)}/term-index/{FORMAT}-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    return kept(TermIndex(Store(spark, root, INDEX_BUCKETS)), file_signature(spark, f"{sf}/documents.parquet"), pages(spark, sf))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(spaced_words(F.col("text"))).alias("pos", "term"))
    return retrieval.query_terms(words.withColumn("weight", F.lit(1.0)))


@query("corpus_stats", f"WITH {FIELD_SQL} SELECT n AS pages, round(avg_title, 6) AS avg_title, round(avg_alias, 6) AS avg_alias, round(avg_summary, 6) AS avg_summary, round(avg_text, 6) AS avg_text FROM stats")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = corpus.corpus_statistics(terms(spark, sf))
    return s.select("pages", *[F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in corpus.FIELDS])


@query("index_kept", f"WITH {FIELD_SQL} SELECT n AS pages, round(avg_title, 6) AS avg_title, round(avg_alias, 6) AS avg_alias, round(avg_summary, 6) AS avg_summary, round(avg_text, 6) AS avg_text, (SELECT count(*) FROM df) AS terms FROM stats")
def index_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What the kept index says of itself; makes it where it isn't there."""
    held = index(spark, sf)
    said = held.statistics()
    means = [F.lit(round(float(said[f"avg_{f}"]), 6)).alias(f"avg_{f}") for f in corpus.FIELDS]
    return held.frequencies().agg(F.count("*").alias("terms")).select(F.lit(said["pages"]).cast("long").alias("pages"), *means, "terms")


@query("term_df", f"WITH {FIELD_SQL} SELECT term, df FROM df")
def term_df(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.term_frequencies(corpus.postings(terms(spark, sf)))


@query("field_term_counts", f"WITH {FIELD_SQL} SELECT field, term, sum(tf)::BIGINT AS tf, count(*) AS pages FROM post GROUP BY field, term")
def field_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.postings(terms(spark, sf)).groupBy("field", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("pages"))


@query("field_lengths", f"WITH {FIELD_SQL} SELECT path, field, length FROM len")
def field_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.field_lengths(terms(spark, sf)).select("path", "field", F.col("length").cast("long").alias("length"))


@query("inverted_index", f"WITH {FIELD_SQL} SELECT term, array_to_string(list_sort(list_distinct(list(path))), ' ') AS paths FROM post GROUP BY term")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    index = corpus.inverted_index(corpus.postings(terms(spark, sf)))
    return index.select("term", F.array_join(F.col("paths").cast("array<string>"), " ").alias("paths"))


@query("posting_blocks", f"WITH {FIELD_SQL} SELECT term, count(DISTINCT path) AS n, min(path) AS first, max(path) AS last FROM post GROUP BY term")
def posting_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = corpus.posting_blocks(corpus.postings(terms(spark, sf)), 50)
    return blocks.groupBy("term").agg(F.sum(F.size("paths")).alias("n"), F.min(F.element_at("paths", 1)).alias("first"), F.max(F.element_at("paths", -1)).alias("last"))


@query("gram_df", rf"""WITH {FIELD_SQL},
g AS (SELECT DISTINCT path, unnest([substr(strip_accents(term), i, 3) FOR i IN range(1, length(strip_accents(term)) - 1)]) AS gram FROM (SELECT DISTINCT path, term FROM post))
SELECT gram, count(*) AS df FROM g GROUP BY gram""")
def gram_df(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.gram_frequencies(pages(spark, sf))


@query("df_tail", f"""WITH {FIELD_SQL}, o AS (SELECT df, row_number() OVER (ORDER BY df) - 1 AS i, count(*) OVER () AS terms FROM df)
SELECT max(n) AS docs, max(terms) AS terms, count(*) FILTER (df >= 0.5 * n) AS common, count(*) FILTER (df = 1) AS hapax,
  max(df) FILTER (i = floor(0.5 * terms)) AS median_df, max(df) FILTER (i = floor(0.9 * terms)) AS p90_df FROM o CROSS JOIN stats""")
def df_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Term counts at both ends of the frequency range; quantiles from the histogram of frequencies, which stays small."""
    t = terms(spark, sf)
    df = corpus.term_frequencies(corpus.postings(t))
    n = t.agg(F.count_if(F.col("field") == "title").alias("docs"))
    steps = df.groupBy("df").agg(F.count("*").alias("at"))
    total = steps.agg(F.sum("at").alias("terms"))
    upto = running_sum(steps.crossJoin(F.broadcast(total)), "at", "upto", "df")
    quantile = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("terms")), F.col("df")))
    return upto.crossJoin(F.broadcast(n)).agg(
        F.max("docs").alias("docs"), F.max("terms").alias("terms"), F.coalesce(F.sum(F.when(F.col("df") >= 0.5 * F.col("docs"), F.col("at"))), F.lit(0)).alias("common"),
        F.coalesce(F.sum(F.when(F.col("df") == 1, F.col("at"))), F.lit(0)).alias("hapax"), quantile(0.5).alias("median_df"), quantile(0.9).alias("p90_df"),
    )


def changed_index(spark: SparkSession, sf: str) -> TermIndex:
    """An index made of other pages and brought to the documents by changes: a third had another text, a fifth were missing, some others are gone."""
    now = pages(spark, sf)
    draw = F.pmod(F.col("path"), F.lit(15))
    earlier = now.where(draw % 5 != 2).withColumn("text", F.when(draw % 3 == 1, F.concat_ws(" ", F.reverse("text"), F.lit("former words"))).otherwise(F.col("text")))
    others = now.where(draw == 4).select((-1 - F.col("path")).alias("path"), "title", "aliases", "summary", F.lit("gone later").alias("text"), "source_slug")
    store = Store(spark, f"{shared_dir(spark)}/term-index-changed-{uuid.uuid4().hex}", INDEX_BUCKETS)
    made = TermIndex(store).update(earlier.unionByName(others), signature="earlier", whole=True)
    some = now.where(draw % 5 == 2)
    made.update(some, others.select("path"), signature="some")  # named changes first, the rest by comparison
    return made.update(now, signature="now", whole=True)


@query("index_df_after_changes", f"WITH {FIELD_SQL} SELECT term, df FROM df")
def index_df_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changed_index(spark, sf).frequencies()


TOP_SQL = f"WITH {FIELD_SQL}, {QUESTION_SQL}, {score_sql('q', 's')}, {rank_sql('s', 'top', 20)} "


@query("bm25f_topk", TOP_SQL + "SELECT query_id, path, round(score, 6) AS score, found, rank FROM top")
def bm25f_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = index(spark, sf).best(questions(spark, sf), 20, out_of_vocabulary=False)
    return top.select("query_id", "path", F.round("score", 6).alias("score"), F.col("found").cast("long").alias("found"), F.col("rank").cast("long").alias("rank"))


@query("index_topk_after_changes", TOP_SQL + "SELECT query_id, path, round(score, 6) AS score, found, rank FROM top")
def index_topk_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    top = changed_index(spark, sf).best(questions(spark, sf), 20, out_of_vocabulary=False)
    return top.select("query_id", "path", F.round("score", 6).alias("score"), F.col("found").cast("long").alias("found"), F.col("rank").cast("long").alias("rank"))


@query("bm25f_oov_grams", rf"""WITH {FIELD_SQL}, {QUESTION_SQL.replace("unnest(regexp_extract_all(lower(text), '" + WORD + "')) AS term", "unnest(['zz' || w || 'qx' FOR w IN regexp_extract_all(lower(text), '" + WORD + "')]) AS term")},
mg AS (SELECT query_id, q.term, list_distinct([substr(strip_accents(q.term), i, 3) FOR i IN range(1, length(strip_accents(q.term)) - 1)]) AS grams FROM q WHERE q.term NOT IN (SELECT term FROM df)),
m AS (SELECT * FROM mg WHERE len(grams) >= 3),
a AS (SELECT DISTINCT term, unnest(grams) AS gram FROM m),
pg AS (SELECT path, field, tf, unnest(list_distinct([substr(strip_accents(term), i, 3) FOR i IN range(1, length(strip_accents(term)) - 1)])) AS gram FROM post),
gp AS (SELECT path, field, gram, sum(tf) AS tf FROM pg WHERE gram IN (SELECT gram FROM a) GROUP BY ALL),
gw AS (SELECT g.path, gram, sum((CASE g.field WHEN 'title' THEN 3.0 WHEN 'alias' THEN 2.0 ELSE 1.0 END) * (tf / (1.2 * (CASE g.field WHEN 'text' THEN 1 ELSE 1 - 0.75 + 0.75 * length / (CASE g.field WHEN 'title' THEN avg_title ELSE avg_summary END) END) + tf))) AS w
  FROM gp g JOIN len l ON g.path = l.path AND g.field = l.field CROSS JOIN stats GROUP BY g.path, gram),
gd AS (SELECT gram, count(*) AS df FROM gw GROUP BY gram),
gs AS (SELECT a.term, path, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * w / (1.2 + w)) AS s FROM a JOIN gw ON a.gram = gw.gram JOIN gd ON gd.gram = a.gram CROSS JOIN stats GROUP BY a.term, path HAVING count(*) >= 2),
sc AS (SELECT query_id, path, round(sum(s / len(grams)), 9) AS score FROM m JOIN gs ON m.term = gs.term GROUP BY query_id, path),
{rank_sql("sc", "top", 10)}
SELECT query_id, path, round(score, 6) AS score, rank FROM top""")
def bm25f_oov_grams(spark: SparkSession, sf: str) -> DataFrame:
    made = F.transform(spaced_words(F.col("text")), lambda w: F.concat(F.lit("zz"), w, F.lit("qx")))
    asked = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(made).alias("term"), F.lit(1.0).alias("weight")).distinct()
    held = index(spark, sf)
    unknown = asked.join(held.frequencies(asked), "term", "left_anti")
    return held.best(unknown, 10).select("query_id", "path", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("name_tier_coverage", f"""WITH {FIELD_SQL}, {QUESTION_SQL},
k AS (SELECT query_id, q.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM q JOIN df ON q.term = df.term CROSS JOIN stats),
t AS (SELECT query_id, sum(idf) AS total FROM k GROUP BY query_id),
m AS (SELECT query_id, path, sum(idf) AS matched FROM k JOIN post p ON p.term = k.term AND field = 'title' GROUP BY query_id, path)
SELECT m.query_id, path, round(matched / total, 6) AS coverage FROM m JOIN t ON m.query_id = t.query_id WHERE matched / total >= 0.25""")
def name_tier_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = index(spark, sf).name_coverage(questions(spark, sf))
    return c.where("coverage >= 0.25").withColumn("coverage", F.round("coverage", 6))


NEEDLE_SQL = f"n AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS needles FROM benchmark)"


def needles(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(spaced_words(F.col("text"))).alias("needles"))


SPACED_SQL = "sp AS (SELECT path, ' ' || regexp_replace(lower(title), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g') AS title, ' ' || regexp_replace(lower(summary), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g') AS summary, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g') AS body FROM page)"


def _hit_sql(field: str) -> str:
    return f"contains({field}, ' ' || needle)"


@query("legacy_profile_score", f"""WITH {FIELD_SQL}, {NEEDLE_SQL}, {SPACED_SQL},
e AS (SELECT query_id, path, CASE WHEN {_hit_sql("title")} THEN 3 WHEN {_hit_sql("summary")} OR {_hit_sql("body")} THEN 1 ELSE 0 END AS p, {_hit_sql("title")} AS named
  FROM sp, (SELECT query_id, unnest(needles) AS needle FROM n)),
s AS (SELECT query_id, path, sum(p) AS score, count(*) FILTER (p > 0) AS found, count(*) FILTER (named) AS named FROM e GROUP BY query_id, path HAVING sum(p) > 0)
SELECT query_id, path, score::INTEGER AS score, found::INTEGER AS found, named::INTEGER AS named FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, found DESC, path) <= 20""")
def legacy_profile_score(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.profile_score(pages(spark, sf), needles(spark, sf))
    return retrieval.top_k(s, 20, F.col("score").desc(), F.col("found").desc(), F.col("path")).drop("rank")


@query("keyword_match_rank", f"""WITH {FIELD_SQL}, {NEEDLE_SQL},
e AS (SELECT query_id, path, CASE WHEN contains(lower(title), needle) THEN 3 ELSE 0 END AS p FROM page, (SELECT query_id, unnest(needles) AS needle FROM n)),
s AS (SELECT query_id, path, sum(p)::INTEGER AS score, (count(*) FILTER (p > 0))::INTEGER AS found FROM e GROUP BY query_id, path HAVING sum(p) > 0)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, found DESC, path) <= 20""")
def keyword_match_rank(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.keyword_ranking(pages(spark, sf), needles(spark, sf).withColumnRenamed("needles", "keywords"))
    return retrieval.top_k(s, 20, F.col("score").desc(), F.col("found").desc(), F.col("path")).drop("rank")


@query("candidate_window", f"""WITH {FIELD_SQL}, {NEEDLE_SQL},
c AS (SELECT DISTINCT item_id AS query_id, unnest([w FOR w IN regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}-]+') IF length(w) >= 5]) AS word FROM benchmark),
b AS (SELECT path, lower(text) AS body FROM page),
h AS (SELECT path, word FROM b, (SELECT DISTINCT word FROM c) WHERE contains(body, word)),
f AS (SELECT word FROM h GROUP BY word HAVING count(*) <= floor((SELECT count(*) FROM page) * 0.5)),
w AS (SELECT query_id, path, count(*) AS words FROM c JOIN f ON c.word = f.word JOIN h ON h.word = c.word GROUP BY query_id, path),
e AS (SELECT query_id, path, sum(CASE WHEN contains(lower(title), needle) THEN 3 ELSE 0 END) AS p FROM page, (SELECT query_id, unnest(needles) AS needle FROM n) GROUP BY query_id, path),
a AS (SELECT e.query_id, e.path, e.p + coalesce(words, 0) AS score FROM e LEFT JOIN w ON e.query_id = w.query_id AND e.path = w.path)
SELECT query_id, path, score::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM a QUALIFY rank <= 30""")
def candidate_window(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(context_keywords(F.col("text"))).alias("word")).distinct()
    w = retrieval.candidate_window(pages(spark, sf).withColumn("pos", F.col("path")), needles(spark, sf).withColumnRenamed("needles", "keywords"), words)
    return w.select("query_id", "path", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("prefilter_by_terms", f"""WITH {FIELD_SQL}, {QUESTION_SQL}, c AS (SELECT query_id, path, count(DISTINCT q.term) AS matched FROM q JOIN post p ON p.term = q.term GROUP BY query_id, path)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, path) AS rank FROM c QUALIFY rank <= 25""")
def prefilter_by_terms(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf)
    held = terms(spark, sf).select("path", F.explode("terms").alias("term")).join(retrieval.small(asked.select("term").distinct()), "term", "left_semi").distinct()
    c = asked.join(held, "term").groupBy("query_id", "path").agg(F.count("*").alias("matched"))
    return retrieval.top_k(c, 25, F.col("matched").desc(), F.col("path")).withColumn("rank", F.col("rank").cast("long"))


def _distinct_sql(chosen: str, said: str, name: str, m: int) -> str:
    return f"""
{name}_d AS (SELECT DISTINCT query_id, p.term FROM {chosen} c JOIN post p ON c.path = p.path), {name}_n AS (SELECT c.query_id, p.term, c.path FROM {chosen} c JOIN (SELECT DISTINCT path, term FROM post) p ON c.path = p.path),
{name} AS (SELECT query_id, x.term, round(sum(ln(n::DOUBLE / (df + 1))), 9) AS score FROM {name}_n x JOIN df ON df.term = x.term CROSS JOIN stats
  WHERE ln(n::DOUBLE / (df + 1)) > 0 AND NOT EXISTS (SELECT 1 FROM {said} s WHERE s.query_id = x.query_id AND s.term = x.term) GROUP BY query_id, x.term
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, x.term) <= {m})"""


EXPAND_SQL = f"WITH {FIELD_SQL}, {QUESTION_SQL}, {score_sql('q', 's1')}, {rank_sql('s1', 'c1', 5)}, {_distinct_sql('c1', 'q', 'd1', 10)}, q1 AS (SELECT query_id, term, weight FROM q UNION ALL SELECT query_id, term, 1.0 FROM d1)"


def _expanded(spark: SparkSession, sf: str, rounds: int, known_only: bool = False) -> DataFrame:
    grown = index(spark, sf).expand(questions(spark, sf), pages_of=(5,) * rounds, words_of=(10,) * rounds, out_of_vocabulary=known_only)
    return grown.select("query_id", "term")


@query("rocchio_expand_1", EXPAND_SQL + " SELECT query_id, term FROM q1")
def rocchio_expand_1(spark: SparkSession, sf: str) -> DataFrame:
    return _expanded(spark, sf, 1)


@query("rocchio_expand_2", EXPAND_SQL + f", {score_sql('q1', 's2')}, {rank_sql('s2', 'c2', 5)}, {_distinct_sql('c2', 'q1', 'd2', 10)} SELECT query_id, term FROM q1 UNION ALL SELECT query_id, term FROM d2")
def rocchio_expand_2(spark: SparkSession, sf: str) -> DataFrame:
    return _expanded(spark, sf, 2)


@query("rocchio_expand_backed_off")
def rocchio_expand_backed_off(spark: SparkSession, sf: str) -> DataFrame:
    """As in production: unknown words score by their trigrams in both rounds."""
    return _expanded(spark, sf, 2, True)


TURN_SQL = """u AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
  FROM conversations WHERE role = 'user' AND trim(coalesce(text, '')) <> '' QUALIFY back <= 6)"""


@query("history_last_n_turns", f"WITH {TURN_SQL} SELECT conv_id, max(said) FILTER (back = 1) AS current, string_agg(said, ' ' ORDER BY turn) AS query FROM u GROUP BY conv_id")
def history_last_n_turns(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.history_query(load(spark, sf, "conversations"))


@query("weighted_history_query", f"WITH {TURN_SQL} SELECT conv_id AS query_id, term, max(w) AS weight FROM (SELECT conv_id, unnest(regexp_extract_all(lower(said), '{WORD}')) AS term, CASE back WHEN 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS w FROM u) GROUP BY ALL")
def weighted_history_query(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.history_terms(load(spark, sf, "conversations"))


GATE_SQL = f"""WITH {FIELD_SQL}, {TURN_SQL}, cur AS (SELECT conv_id AS query_id, list_distinct(regexp_extract_all(lower(said), '[\\p{{L}}\\p{{N}}\\p{{M}}]{{2,}}')) AS tokens FROM u WHERE back = 1),
q AS (SELECT query_id, unnest(tokens) AS term FROM cur),
k AS (SELECT query_id, q.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM q JOIN df ON q.term = df.term CROSS JOIN stats),
t AS (SELECT query_id, sum(idf) AS total FROM k GROUP BY query_id),
m AS (SELECT query_id, path, sum(idf) AS matched FROM k JOIN post p ON p.term = k.term AND field = 'title' GROUP BY query_id, path),
b AS (SELECT m.query_id, max(matched / total) AS coverage, count(*) AS hits FROM m JOIN t ON m.query_id = t.query_id GROUP BY m.query_id),
g AS (SELECT cur.query_id, round(coalesce(coverage, 0), 6) AS coverage, coalesce(hits, 0) AS hits, len(tokens) >= 2 AS reliable FROM cur LEFT JOIN b ON cur.query_id = b.query_id)"""


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    asked = retrieval.history_query(load(spark, sf, "conversations")).select(F.col("conv_id").alias("query_id"), tokenize_query(F.regexp_replace("current", r"[^\p{L}\p{N}\p{M}]+", " ")).alias("tokens"))
    words = asked.select("query_id", F.explode("tokens").alias("term"))
    cover = index(spark, sf).best_coverage(words)
    return asked.join(cover, "query_id", "left").select(
        "query_id", F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"), F.coalesce("hits", F.lit(0)).alias("hits"), lexically_reliable(F.col("tokens")).alias("reliable")
    )


@query("seed_gate_flags", GATE_SQL + " SELECT *, coverage >= 0.5 AND hits >= 3 AND reliable AS strong FROM g")
def seed_gate_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _gate(spark, sf).withColumn("strong", (F.col("coverage") >= 0.5) & (F.col("hits") >= 3) & F.col("reliable"))


@query("escalation_ratio", GATE_SQL + " SELECT count(*) AS queries, round(avg(CASE WHEN coverage >= 0.5 AND hits >= 3 THEN 0.0 ELSE 1.0 END), 6) AS escalated FROM g")
def escalation_ratio(spark: SparkSession, sf: str) -> DataFrame:
    fails = ~((F.col("coverage") >= 0.5) & (F.col("hits") >= 3))
    return _gate(spark, sf).agg(F.count("*").alias("queries"), F.round(F.avg(fails.cast("double")), 6).alias("escalated"))


#: Two channels over the same questions: field-weighted ranks, and ranks by matched terms.
CHANNEL_SQL = TOP_SQL + """, ch AS (SELECT query_id, 0 AS channel, path AS key, rank FROM top
  UNION ALL SELECT query_id, 1, path, row_number() OVER (PARTITION BY query_id ORDER BY found DESC, path) AS rank FROM s QUALIFY rank <= 20)"""


def _channels(spark: SparkSession, sf: str) -> DataFrame:
    top = index(spark, sf).best(questions(spark, sf), 20, by=("score", "found"), out_of_vocabulary=False)
    return top.select("query_id", F.when(F.col("by") == "score", 0).otherwise(1).alias("channel"), F.col("path").alias("key"), "rank")


@query("rrf_fuse", CHANNEL_SQL + " SELECT query_id, key, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS channels FROM ch GROUP BY query_id, key")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rrf(_channels(spark, sf)).withColumn("score", F.round("score", 9))


FUSED_SQL = CHANNEL_SQL + """, sc AS (SELECT query_id, channel, key, (60 + min(rank) OVER (PARTITION BY query_id, channel))::DOUBLE / (60 + rank) AS score FROM ch),
fu AS (SELECT query_id, key, max(score) AS score, count(*) AS channels, (arg_max(channel, score - channel * 1e-12))::INTEGER AS channel FROM sc GROUP BY query_id, key)"""


@query("max_fuse", FUSED_SQL + " SELECT query_id, key, round(score, 9) AS score, channels, channel FROM fu")
def max_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.max_fusion(_channels(spark, sf)).withColumn("score", F.round("score", 9))


@query("coverage_pick", FUSED_SQL + """, c AS (SELECT fu.query_id, key, round(fu.score, 9) AS score, channel AS tier, source_slug, row_number() OVER (PARTITION BY fu.query_id ORDER BY fu.score DESC, channel, key) AS place FROM fu JOIN page ON page.path = key),
e AS (SELECT *, score / (1 + 0.5 * (CASE WHEN source_slug IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY query_id, source_slug ORDER BY tier, score DESC, place) - 1 END)) AS effective FROM c)
SELECT query_id, key, round(effective, 9) AS effective, row_number() OVER (PARTITION BY query_id ORDER BY tier, effective DESC, score DESC, place) AS pick FROM e QUALIFY pick <= 10""")
def coverage_pick(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    fused = retrieval.max_fusion(_channels(spark, sf)).withColumn("score", F.round("score", 9))
    placed = fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "channel", "key")))
    sourced = placed.join(pages(spark, sf).select(F.col("path").alias("key"), "source_slug"), "key").withColumn("tier", F.col("channel"))
    return retrieval.coverage_pick(sourced, 10, 0.5).select("query_id", "key", F.round("effective", 9).alias("effective"), F.col("pick").cast("long").alias("pick"))


WIDE_SQL = "[　-〿぀-ヿ㐀-䶿一-鿿가-힯豈-﫿＀-￯]"
COST_SQL = f"ceil(len(regexp_extract_all(text, '{WIDE_SQL}')) / 1.25::DOUBLE + (length(text) - len(regexp_extract_all(text, '{WIDE_SQL}'))) / 2.6::DOUBLE)::BIGINT"


@query("token_estimate", f"SELECT doc_id, {COST_SQL} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("budget_prefix", TOP_SQL + f""", c AS (SELECT query_id, rank, top.path, {COST_SQL} AS cost FROM top JOIN page ON page.path = top.path),
r AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM c)
SELECT query_id, rank, path, cost, used::BIGINT AS used FROM r WHERE rank = 1 OR used <= 8192 - 512""")
def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    top = index(spark, sf).best(questions(spark, sf), 20, out_of_vocabulary=False)
    costed = top.join(pages(spark, sf).select("path", estimate_tokens(F.col("text")).alias("cost")), "path").select("query_id", F.col("rank").cast("long").alias("rank"), "path", "cost")
    return retrieval.budget_prefix(costed, 8192, 512)


@query("content_signature")
def content_signature(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.content_signature(F.lit("documents"), pages(spark, sf))


@query("body_hash")
def body_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", body_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query("query_grams", rf"SELECT DISTINCT item_id, unnest(list_distinct([substr(strip_accents(w), i, 3) FOR i IN range(1, length(strip_accents(w)) - 1)])) AS gram FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM benchmark)")
def query_grams(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "benchmark").select("item_id", F.explode(spaced_words(F.col("text"))).alias("w"))
    return words.select("item_id", F.explode(word_grams(F.col("w"))).alias("gram")).distinct()
