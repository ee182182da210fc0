"""Page relations of a corpus: fields, postings, frequencies, statistics, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import UNSPACED, segment, spaced_words, strip_accents, word_grams

FIELDS = ("title", "alias", "summary", "text")
WEIGHTS = {"title": 3.0, "alias": 2.0, "summary": 1.0, "text": 1.0}
#: Pages whose postings of one term may lie in one row.
PAGES_PER_BLOCK = 100_000


def pages_from_documents(docs: DataFrame, title_words: int = 8, summary_chars: int = 200) -> DataFrame:
    """(path, title, aliases, summary, text, source_slug): a document as a page; its first words are its title."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").alias("path"),
        F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, title_words), " ").alias("title"),
        F.array().cast("array<string>").alias("aliases"),
        F.left(text, F.lit(summary_chars)).alias("summary"),
        text.alias("text"),
        F.col("source").alias("source_slug"),
    )


def attach_bodies(refs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Page references with their bodies; a page without one keeps a null text, which is not an empty one."""
    return refs.drop("text").join(bodies.select("path", "text"), "path", "left")


def field_terms(pages: DataFrame, *, unspaced: bool = False) -> DataFrame:
    """(path, field, terms): the terms of each field in order; unspaced also cuts scripts without spaces."""
    cut = segment if unspaced else spaced_words
    alias = F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), cut))
    parts = [F.struct(F.lit(f).alias("field"), (alias if f == "alias" else cut(F.coalesce(f, F.lit("")))).alias("terms")) for f in FIELDS]
    return pages.select("path", F.explode(F.array(*parts)).alias("f")).select("path", "f.field", "f.terms")


def postings(terms: DataFrame) -> DataFrame:
    """(path, field, term, tf)."""
    return terms.select("path", "field", F.explode("terms").alias("term")).groupBy("path", "field", "term").agg(F.count("*").alias("tf"))


def field_lengths(terms: DataFrame) -> DataFrame:
    return terms.select("path", "field", F.size("terms").alias("length"))


def term_frequencies(posted: DataFrame) -> DataFrame:
    """(term, df): a page counts once whatever the fields."""
    return posted.select("path", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(terms: DataFrame) -> DataFrame:
    """One row: pages and the mean length of each field over pages that have it (0 if none does)."""
    length = F.size("terms")
    means = [F.coalesce(F.avg(F.when((F.col("field") == f) & (length > 0), length)), F.lit(0.0)).alias(f"avg_{f}") for f in FIELDS]
    return terms.agg(F.count_if(F.col("field") == FIELDS[0]).alias("pages"), *means)


def inverted_index(posted: DataFrame) -> DataFrame:
    """(term, paths): distinct paths, ascending; a row has all pages of its term: see posting_blocks for rows of bounded size."""
    return posted.groupBy("term").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def posting_blocks(posted: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """(term, block, paths): as inverted_index, cut by pages: a block has the postings of about pages_per_block pages, so no row grows with the corpus."""
    blocks = max(1, -(-posted.select("path").distinct().count() // pages_per_block))
    cut = posted.select("term", F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int").alias("block"), "path")
    return cut.groupBy("term", "block").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def gram_postings(terms: DataFrame) -> DataFrame:
    """(path, field, gram, tf): a term occurrence counts once for each distinct trigram in it."""
    return (
        terms.select("path", "field", F.explode("terms").alias("term"))
        .groupBy("path", "field", "term")
        .agg(F.count("*").alias("n"))
        .select("path", "field", "n", F.explode(word_grams(F.col("term"))).alias("gram"))
        .groupBy("path", "field", "gram")
        .agg(F.sum("n").alias("tf"))
    )


def gram_frequencies(pages: DataFrame) -> DataFrame:
    """(gram, df): how many pages have a term with the trigram; pages that repeat a path count once.

    A page's trigrams are cut from its distinct terms at one go and told apart inside its row, so a shuffle has a row for each trigram
    and task, not for each trigram and page. Only pages that repeat a path meet by it.
    """
    fields = [spaced_words(F.coalesce(f, F.lit(""))) for f in FIELDS if f != "alias"] + [F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), spaced_words))]
    said = pages.select("path", F.array_join(F.filter(F.array_distinct(F.concat(*fields)), lambda w: ~w.rlike(f"[{UNSPACED}]")), " ").alias("words"))
    # a look ahead at three letters of a word from each of its letters
    held = said.select("path", F.array_distinct(F.regexp_extract_all(strip_accents(F.col("words")), F.lit("(?=([^ ]{3}))[^ ]"), 1)).alias("grams"))
    count = lambda df: df.groupBy("gram").agg(F.count("*").alias("df"))
    again = pages.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("path").alias("repeated"))
    if again.isEmpty():
        return count(held.select(F.explode("grams").alias("gram")))
    met = F.col("path").eqNullSafe(F.col("repeated"))
    more = held.join(again, met, "left_semi").select("path", F.explode("grams").alias("gram")).distinct().select("gram")
    return count(held.join(again, met, "left_anti").select(F.explode("grams").alias("gram")).unionByName(more))


def content_signature(index_text: Column, bodies: DataFrame) -> DataFrame:
    """One row, the same for the same index text and bodies in any order."""
    return bodies.agg(F.bit_xor(F.xxhash64("path", "text")).alias("bodies"), F.count("*").alias("pages")).select(
        F.concat_ws(":", F.xxhash64(index_text).cast("string"), F.col("bodies").cast("string"), F.col("pages").cast("string")).alias("signature")
    )
