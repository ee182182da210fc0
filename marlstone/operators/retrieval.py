"""Lexical retrieval: scoring, gates, expansion, fusion, coverage and budgets.

Queries come in batches: a relation (query_id, term, weight) is scored against all
pages at once.  The few distinct query terms are joined to the token stream before
anything is grouped, so only their postings are ever built.  Query terms are
broadcast where they are fewer than BROADCAST_TERMS, which is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import SPACED_RUN, WORD_CLASS, windows, word_grams
from marlstone.operators.corpus import FIELDS, WEIGHTS, corpus_statistics, term_frequencies
from marlstone.sources.workspace import materialize

K1, B = 1.2, 0.75
FUSION_K = 60
BROADCAST_TERMS = 100_000
#: Pages and queries that meet in one task of candidate_window.
WINDOW_PAGES, WINDOW_QUERIES = 4_000, 1_024


def small(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """df, marked for broadcast if it has at most limit rows."""
    return F.broadcast(df) if len(df.limit(limit + 1).take(limit + 1)) <= limit else df


def query_terms(terms: DataFrame) -> DataFrame:
    """(query_id, term, weight) with the first weight of a repeated term, zero weights left out; pos orders repeats."""
    first = terms.groupBy("query_id", "term").agg(F.min_by("weight", "pos").alias("weight"))
    return first.where("weight <> 0")


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def _norm(stats: dict[str, float]) -> Column:
    """Length normalisation of a field; the body is not normalised."""
    out = F.lit(1.0)
    for f in FIELDS[:-1]:
        out = F.when(F.col("field") == f, 1 - B + B * F.col("length") / (stats[f"avg_{f}"] or 1.0)).otherwise(out)
    return out


def _weight(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for f, w in weights.items():
        out = F.when(F.col("field") == f, w).otherwise(out)
    return out


def term_index(terms: DataFrame) -> DataFrame:
    """(path, field, length, term, tf): postings with their field's length, the table to keep for many rounds of scoring."""
    words = terms.select("path", "field", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return words.groupBy("path", "field", "length", "term").agg(F.count("*").alias("tf"))


def bm25f(terms: DataFrame, queries: DataFrame, *, weights: dict[str, float] | None = None, out_of_vocabulary: bool = True) -> DataFrame:
    """(query_id, path, score, found): field-weighted scores above zero, rounded to nine places; found counts query terms on the page.

    terms is field_terms of the pages and queries (query_id, term, weight).  A term
    that no page has is backed off to its trigrams, if it has three and two match.
    """
    stats = corpus_statistics(terms).first().asDict()
    wanted = small(queries.where("weight <> 0").select("term").distinct())
    words = terms.select("path", "field", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    held = words.join(wanted, "term", "left_semi").groupBy("path", "field", "length", "term").agg(F.count("*").alias("tf"))
    return bm25f_indexed(held, stats, queries, weights=weights, whole=term_index(terms) if out_of_vocabulary else None)


def bm25f_indexed(index: DataFrame, stats: dict[str, float], queries: DataFrame, *, weights: dict[str, float] | None = None, whole: DataFrame | None = None) -> DataFrame:
    """bm25f over a term index (or its part for the query terms); whole is the full one, for terms that no page has."""
    weights = weights or WEIGHTS
    queries = queries.where("weight <> 0")
    held = index.join(small(queries.select("term").distinct()), "term", "left_semi")
    n = F.lit(float(stats["pages"]))
    part = _weight(weights) * F.col("tf") / (K1 * _norm(stats) + F.col("tf"))
    by_page = held.groupBy("path", "term").agg(F.sum(part).alias("w"))
    df = by_page.groupBy("term").agg(F.count("*").alias("df"))
    known = by_page.where("w > 0").join(df, "term").select("path", "term", (idf(n, F.col("df")) * F.col("w") / (K1 + F.col("w"))).alias("s"))
    scored = queries.join(known, "term").select("query_id", "path", (F.col("weight") * F.col("s")).alias("s"), F.lit(1).alias("hit"))
    if whole is not None:
        missing = queries.join(df, "term", "left_anti").select("query_id", "term", "weight", word_grams(F.col("term")).alias("grams")).where(F.size("grams") >= 3)
        asked = missing.select("term", F.explode("grams").alias("gram")).distinct()
        # trigrams are cut once for each distinct word
        words = whole.select("term").distinct().select("term", F.explode(word_grams(F.col("term"))).alias("gram")).join(small(asked.select("gram").distinct()), "gram", "left_semi")
        grams = whole.join(words, "term").groupBy("path", "field", "length", "gram").agg(F.sum("tf").alias("tf"))
        by_gram = grams.groupBy("path", "gram").agg(F.sum(part).alias("w"))
        gdf = by_gram.groupBy("gram").agg(F.count("*").alias("df"))
        gram_scores = by_gram.where("w > 0").join(gdf, "gram").select("path", "gram", (idf(n, F.col("df")) * F.col("w") / (K1 + F.col("w"))).alias("s"))
        backed = asked.join(gram_scores, "gram").groupBy("term", "path").agg(F.sum("s").alias("s"), F.count("*").alias("matched")).where("matched >= 2")
        scored = scored.unionByName(missing.join(backed, "term").select("query_id", "path", (F.col("weight") * F.col("s") / F.size("grams")).alias("s"), F.lit(0).alias("hit")))
    return scored.groupBy("query_id", "path").agg(F.round(F.sum("s"), 9).alias("score"), F.sum("hit").alias("found")).where("score > 0")


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """scored with its rank (1 is best) in each query, the first k kept; ties end in path order."""
    order = order or (F.col("score").desc(), F.col("path"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def name_coverage(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, path, coverage): idf share of a query's known terms that the page's title or aliases have."""
    pages = corpus_statistics(terms).first()["pages"]
    wanted = small(queries.select("term").distinct())
    held = terms.select("path", "field", F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy("path", "term").agg(F.max(F.col("field").isin("title", "alias")).alias("named"))
    df = held.groupBy("term").agg(F.count("*").alias("df")).select("term", idf(F.lit(float(pages)), F.col("df")).alias("idf"))
    known = queries.select("query_id", "term").distinct().join(df, "term")
    total = known.groupBy("query_id").agg(F.sum("idf").alias("total"))
    matched = known.join(held.where("named"), "term").groupBy("query_id", "path").agg(F.sum("idf").alias("matched"))
    return matched.join(total, "query_id").select("query_id", "path", F.when(F.col("total") == 0, 0.0).otherwise(F.col("matched") / F.col("total")).alias("coverage"))


def _named_fields(pages: DataFrame, points: dict[str, int]) -> DataFrame:
    """(path, points, value): a lower-case row for each title, alias, summary and text that has points."""
    def pointed(f: str, p: int) -> Column:
        return F.transform(F.col(f) if f == "aliases" else F.array(F.col(f)), lambda v: F.struct(F.lit(p).alias("points"), F.lower(v).alias("value")))

    every = [pointed(f, p) for f, p in points.items()]
    return pages.select("path", F.explode(F.concat(*[F.coalesce(e, F.array().cast("array<struct<points:int,value:string>>")) for e in every])).alias("f")).select("path", "f.points", "f.value").where("value IS NOT NULL")


def profile_score(pages: DataFrame, needles: DataFrame, *, with_text: bool = True) -> DataFrame:
    """(query_id, path, score, found, named): the first field that a needle hits gives 3, 2, 1 or 1 points.

    needles is (query_id, needles): one array a query.  A spaced needle hits the words that begin with it, which are found in
    the corpus's vocabulary; any other needle is looked for as a substring.
    """
    asked = materialize(needles.select("query_id", F.posexplode("needles").alias("place", "word")), "needles")
    words = asked.select("word").distinct()
    fields = _named_fields(pages, {"title": 3, "aliases": 2, "summary": 1} | ({"text": 1} if with_text else {}))
    held = fields.select("path", "points", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(f"[{WORD_CLASS}]+"), 0))).alias("token"))
    vocabulary = held.select("token").distinct()
    begins = vocabulary.select("token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.left("token", n))).alias("word"))
    spaced = F.col("word").rlike(f"^{SPACED_RUN}$")
    pairs = begins.join(small(words.where(spaced)), "word")
    hits = held.join(small(materialize(pairs, "needle-words")), "token").select("path", "word", "points")
    hits = hits.unionByName(substring_hits(fields, "value", words.where(~spaced), keep=("path", "points")))
    best = hits.groupBy("path", "word").agg(F.max("points").alias("p"))
    return asked.join(best, "word").groupBy("query_id", "path").agg(F.sum("p").cast("int").alias("score"), F.count("*").cast("int").alias("found"), F.count_if(F.col("p") >= 2).cast("int").alias("named"))


def rrf(ranked: DataFrame, k: int = FUSION_K) -> DataFrame:
    """(query_id, key, score, channels): sums of 1 / (k + rank); ranked is (query_id, channel, key, rank)."""
    return ranked.groupBy("query_id", "key").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count("*").alias("channels"))


def max_fusion(ranked: DataFrame, k: int = FUSION_K) -> DataFrame:
    """(query_id, key, score, channels, channel): each channel scaled to its best, the maximum over channels; ties to the earlier channel."""
    best = Window.partitionBy("query_id", "channel")
    scaled = ranked.withColumn("score", (k + F.min("rank").over(best)) / (k + F.col("rank")))
    return scaled.groupBy("query_id", "key").agg(F.max("score").alias("score"), F.count("*").alias("channels"), F.max_by("channel", F.struct("score", -F.col("channel"))).alias("channel"))


def coverage_pick(candidates: DataFrame, budget: int, penalty: float = 0.0) -> DataFrame:
    """The greedy pick as a window: an item's score falls with the items of its source that come before it.

    candidates is (query_id, key, score, tier, source_slug, place); a null source is never penalised.  Adds effective and pick.
    """
    own = Window.partitionBy("query_id", "source_slug").orderBy("tier", F.col("score").desc(), "place")
    earlier = F.when(F.col("source_slug").isNull(), 0).otherwise(F.row_number().over(own) - 1)
    order = Window.partitionBy("query_id").orderBy("tier", F.col("effective").desc(), F.col("score").desc(), "place")
    return candidates.withColumn("effective", F.col("score") / (1 + penalty * earlier)).withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= budget)


def budget_prefix(ranked: DataFrame, budget: float, reserve: float = 0.0) -> DataFrame:
    """The ranked prefix whose summed cost fits the budget less the reserve; the first row always stays.  ranked is (query_id, rank, cost)."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    if budget <= 0:
        return ranked.withColumn("used", F.sum("cost").over(upto))
    return ranked.withColumn("used", F.sum("cost").over(upto)).where((F.col("rank") == 1) | (F.col("used") <= max(0.0, budget - max(0.0, reserve))))


def distinctive_terms(posted: DataFrame, chosen: DataFrame, said: DataFrame, df: DataFrame, pages: int, m: int) -> DataFrame:
    """(query_id, term, score, place): the m best unsaid words of a query's chosen pages by summed ln(N / (df + 1)), positive only."""
    words = posted.select("path", "term").distinct()
    held = chosen.select("query_id", "path").join(words, "path")
    rarity = df.select("term", F.ln(F.lit(float(pages)) / (F.col("df") + 1)).alias("rarity")).where("rarity > 0")
    summed = held.join(said.select("query_id", "term"), ["query_id", "term"], "left_anti").join(rarity, "term").groupBy("query_id", "term").agg(F.round(F.sum("rarity"), 9).alias("score"))
    return summed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "term"))).where(F.col("place") <= m)


def expand(
    terms: DataFrame, queries: DataFrame, *, pages_of: tuple[int, ...] = (5, 5), words_of: tuple[int, ...] = (10, 10), out_of_vocabulary: bool = True
) -> DataFrame:
    """(query_id, term, weight): the query terms with those of rounds of pseudo-relevance feedback, new ones at weight 1."""
    index = materialize(term_index(terms), "term-index")
    stats = corpus_statistics(terms).first().asDict()
    df = materialize(term_frequencies(index), "term-df")
    grown = materialize(queries.select("query_id", "term", "weight"), "query-terms")
    for k, m in zip(pages_of, words_of):
        if k <= 0 or m <= 0:
            break
        chosen = materialize(top_k(bm25f_indexed(index, stats, grown, whole=index if out_of_vocabulary else None), k), "query-pages")
        new = distinctive_terms(index, chosen, grown, df, stats["pages"], m)
        grown = materialize(grown.unionByName(new.select("query_id", "term", F.lit(1.0).alias("weight"))), "query-terms")
    return grown


def keyword_ranking(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, path, score, found): 3 points for a keyword in the title, 2 for each alias that has it.  keywords is (query_id, keywords)."""
    asked = materialize(keywords.select("query_id", F.posexplode("keywords").alias("place", "word")), "keywords")
    hits = substring_hits(_named_fields(pages, {"title": 3, "aliases": 2}), "value", asked.select("word").distinct(), keep=("path", "points"))
    best = hits.groupBy("path", "word").agg(F.sum("points").alias("p"))
    return asked.join(best, "word").groupBy("query_id", "path").agg(F.sum("p").cast("int").alias("score"), F.count("*").cast("int").alias("found"))


def substring_hits(pages: DataFrame, text_col: str, needles: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(*keep, word): which of the words, a relation with the one column word, lie anywhere in a page's text; empty words lie nowhere.

    A word of three or more characters is looked for where its rarest trigram lies: the trigrams of the texts are counted once, by
    rows that have them, and each word waits at the one of its own that the fewest rows have. Shorter words wait at themselves. So a
    text meets the words that share a rare piece with it, not all words, and not all words that begin alike.
    """
    asked = materialize(needles.where("word <> ''").select("word").distinct(), "needles-asked")
    sizes = [r.n for r in asked.select(F.least(F.char_length("word"), F.lit(3)).alias("n")).distinct().collect()]
    own = asked.select("word", F.explode(F.array_distinct(F.when(F.char_length("word") >= 3, windows(F.col("word"), 3)).otherwise(F.array("word")))).alias("piece"))
    wanted = materialize(own.select("piece").distinct(), "needles-pieces")
    cut = F.array_distinct(F.concat(*(windows(F.col(text_col), n) for n in sizes or [3])))
    held = pages.select(*keep, text_col, F.explode(cut).alias("piece")).join(small(wanted), "piece", "left_semi").select(*keep, "piece")
    held = materialize(held, "needles-held")
    counts = held.groupBy("piece").agg(F.count("*").alias("rows"))
    # a piece that no row has answers its word at once: no row has it
    known = own.join(counts, "piece", "left")
    rarest = known.groupBy("word").agg(F.min_by("piece", F.struct(F.coalesce("rows", F.lit(0)), "piece")).alias("piece"), F.min(F.coalesce("rows", F.lit(0))).alias("rows")).where("rows > 0")
    waiting = rarest.groupBy("piece").agg(F.collect_list("word").alias("words"))
    met = held.join(waiting, "piece").groupBy(*keep).agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    return pages.select(*keep, text_col).join(met, list(keep)).select(*keep, F.explode(F.filter("words", lambda w: F.contains(F.col(text_col), w))).alias("word"))


def _word_finder(words: list[str]) -> Callable[[str | None], list[int]]:
    """The numbers of the words that lie anywhere in a text, each once, by one automaton for all."""
    finder = ahocorasick.Automaton()
    for k, word in enumerate(words):
        if word:
            finder.add_word(word, k)
    if not len(finder):
        return lambda text: []
    finder.make_automaton()
    return lambda text: list({k for _, k in finder.iter(text)}) if text else []


def _window_met(pages: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(query_id, path, pos, score): the first k pages of each query of a block from a part of the pages, by points, then by pos.

    pages is (path, pos, title, aliases, words): numbers of the words that each has; asked is (query_id, word, keyword), a word's number.
    """
    order = pc.sort_indices(pages.select(["pos"]), sort_keys=[("pos", "ascending")], null_placement="at_start")
    pages = pages.take(order)
    points: dict[bool, dict[int, list[tuple[int, int]]]] = {True: {}, False: {}}
    for field, worth, keyword in (("title", 3, True), ("aliases", 2, True), ("words", 1, False)):
        for at, held in enumerate(pages[field].to_pylist()):
            for word in held or ():
                points[keyword].setdefault(word, []).append((at, worth))
    places = {kind: {w: tuple(np.array(x) for x in zip(*held)) for w, held in of.items()} for kind, of in points.items()}
    # a keyword's points on a page are those of its best field
    best = {}
    for word, (at, worth) in places[True].items():
        top: dict[int, int] = {}
        for i, p in zip(at.tolist(), worth.tolist()):
            top[i] = max(p, top.get(i, 0))
        best[word] = np.array(list(top)), np.array(list(top.values()))
    places[True] = best
    ids = pc.unique(asked["query_id"])
    query = pc.index_in(asked["query_id"], value_set=ids).to_pylist()
    score = np.zeros((len(ids), pages.num_rows), np.int64)
    for q, word, keyword in zip(query, asked["word"].to_pylist(), asked["keyword"].to_pylist()):
        if word is not None and word in places[keyword]:
            at, worth = places[keyword][word]
            score[q, at] += worth
    rows, cols = [], []
    for q, line in enumerate(score):
        n = len(line)
        at = np.arange(n)
        if n > k:
            least = np.partition(line, n - k)[n - k]
            over = np.flatnonzero(line > least)
            at = np.concatenate([over, np.flatnonzero(line == least)[: k - len(over)]])
        rows.append(np.full(len(at), q))
        cols.append(at)
    rows_, cols_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
    got = pages.select(["path", "pos"]).take(pa.array(cols_))
    return pa.table({"query_id": ids.take(pa.array(rows_)), "path": got["path"], "pos": got["pos"], "score": score[rows_, cols_]})


def candidate_window(pages: DataFrame, keywords: DataFrame, context: DataFrame, *, k: int = 30, df_cap: float = 0.5) -> DataFrame:
    """(query_id, path, score, rank): keyword points and one for each context word anywhere in the page's text, words on more than df_cap of the pages ignored.

    pages has pos, the input order that breaks ties; context is (query_id, word). A task finds all words of its texts at one go, and
    pages meet queries in parts and blocks that give their first k, so no pair of a page and a query is a row. The distinct words of all
    queries go through the driver to the tasks. Pages that repeat a path are rows of their own.
    """
    spark = pages.sparkSession
    said = materialize(
        keywords.select("query_id", F.explode_outer("keywords").alias("word"), F.lit(True).alias("keyword")).unionByName(context.select("query_id", "word", F.lit(False).alias("keyword"))), "window-words"
    )
    asked = keywords.select("query_id").distinct()
    words = sorted(r.word for r in said.select("word").where("word <> ''").distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(words)), "number int, word string")
    held = spark.sparkContext.broadcast(words)
    kind, pos = pages.schema["path"].dataType.simpleString(), pages.schema["pos"].dataType.simpleString()
    lower = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a))
    texts = pages.select("path", "pos", F.lower("title").alias("title"), lower.alias("aliases"), F.lower("text").alias("words"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _word_finder(held.value)
        numbered = pa.list_(pa.int32())
        for batch in batches:
            title, aliases, body = (batch.column(i).to_pylist() for i in (2, 3, 4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, numbered) for x in ([found(t) for t in title], [[w for a in names for w in found(a)] for names in aliases], [found(t) for t in body]))],
                ["path", "pos", "title", "aliases", "words"],
            )

    hits = materialize(texts.mapInArrow(find, f"path {kind}, pos {pos}, title array<int>, aliases array<int>, words array<int>"), "window-hits")
    with_text = pages.where("text IS NOT NULL").count()
    fine = hits.select(F.explode("words").alias("number")).groupBy("number").agg(F.count("*").alias("df")).where(F.col("df") <= int(with_text * df_cap)).select("number")
    known = said.join(F.broadcast(numbers), "word", "left")
    known = known.where("keyword").unionByName(known.where("NOT keyword").join(fine, "number", "left_semi")).select("query_id", F.col("number").alias("word"), "keyword")
    parts, blocks = max(1, -(-hits.count() // WINDOW_PAGES)), max(1, -(-said.select("query_id").distinct().count() // WINDOW_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = hits.withColumn("part", F.pmod(F.xxhash64("path", "pos"), F.lit(parts)).cast("int")).withColumn("block", each(blocks))
    right = known.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    schema = f"query_id {known.schema['query_id'].dataType.simpleString()}, path {kind}, pos {pos}, score long"
    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(lambda a, b: _window_met(a, b, k), schema)
    # pages without points only fill up windows of queries that keywords has
    first = materialize(met, "window-first").join(asked.withColumn("named", F.lit(True)), "query_id", "left").where("named OR score > 0")
    return top_k(first, k, F.col("score").desc(), F.col("pos")).select("query_id", "path", "score", "rank")


def history_query(turns: DataFrame, rounds: int = 5) -> DataFrame:
    """(conv_id, current, query): the last user turn, and it after up to `rounds` earlier non-blank ones."""
    users = turns.where("role = 'user'").withColumn("said", F.trim(F.coalesce("text", F.lit("")))).where("said <> ''")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    recent = users.withColumn("back", back).where(F.col("back") <= rounds + 1)
    spoken = F.array_sort(F.collect_list(F.struct("turn", "said")))
    return recent.groupBy("conv_id").agg(F.max_by("said", "turn").alias("current"), F.array_join(F.transform(spoken, lambda s: s["said"]), " ").alias("query"))


def history_terms(turns: DataFrame, rounds: int = 5, weight: float = 0.3) -> DataFrame:
    """(query_id, term, weight): words of the last user turn at weight 1, words of earlier ones only at `weight`."""
    from marlstone.functions.text import spaced_words

    users = turns.where("role = 'user'").withColumn("said", F.trim(F.coalesce("text", F.lit("")))).where("said <> ''")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    recent = users.withColumn("back", back).where(F.col("back") <= rounds + 1)
    words = recent.select(F.col("conv_id").alias("query_id"), F.explode(spaced_words(F.col("said"))).alias("term"), F.when(F.col("back") == 1, 1.0).otherwise(weight).alias("weight"))
    return words.groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
