"""A kept term index in two tiers, maintained by changed pages only.

Postings are kept twice, by term and by page, so that questions read the postings of their terms and a change reads
those of its pages. A posting is a word of a page with its counts in the page's fields and the fields' lengths, so that a
page's weight for a word needs no grouping. The name tier lists the words of titles and aliases. Document
frequencies, the trigrams of the vocabulary, page digests and the sums behind mean field lengths are kept beside them. A page that
changes has its old rows subtracted and its new ones added, in a version of their own; reads merge versions.

The index knows a signature of the content it was made of: `kept` gives the index as it is when the signature is
the same, without a look at the pages, and else brings it up to date from the pages whose digest differs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import UNSPACED, segment, spaced_words, word_grams
from marlstone.operators import pagetop, retrieval
from marlstone.operators.corpus import FIELDS, WEIGHTS
from marlstone.sources.versioned import BROADCAST_KEYS, Relation, Store, changed
from marlstone.sources.workspace import materialize

#: Raised when the rows or the way words are cut change: an index of another format is another index.
FORMAT = 5
#: Words of pages, about, that one task counts.
WORDS_PER_TASK = 1_000_000
#: Sets of title words, and questions, that meet in one task.
SETS_PER_TASK, QUERIES_PER_TASK = 30_000, 8_192
#: Postings and pages, about, and queries that meet in one task of best.
POSTINGS_PER_TASK, PAGES_AT_ONCE, QUERIES_AT_ONCE = 300_000, 4_000, 1_024
COUNTS, LENGTHS = [f"tf_{f}" for f in FIELDS], [f"len_{f}" for f in FIELDS]


def page_weight(statistics: dict[str, float], weights: dict[str, float]) -> Column:
    """A page's weight for a word: its counts by field, damped, normalised by the field's length but for the text, and weighted."""
    total = F.lit(0.0)
    for f in FIELDS:
        norm = F.lit(1.0) if f == FIELDS[-1] else 1 - retrieval.B + retrieval.B * F.col(f"len_{f}") / (statistics[f"avg_{f}"] or 1.0)
        total += F.lit(weights.get(f, 0.0)) * F.col(f"tf_{f}") / (retrieval.K1 * norm + F.col(f"tf_{f}"))
    return total


def _every(n: int) -> Column:
    """A row for each number below n."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _coverage_met(sets: pa.Table, known: pa.Table) -> pa.Table:
    """(query_id, best, hits) of a block of queries over a part of the sets of asked words."""
    ids = pc.unique(known["query_id"])
    at = pc.index_in(known["query_id"], value_set=ids).to_numpy()
    held: dict[str, list[int]] = {}
    for row, term in enumerate(known["term"].to_pylist()):
        held.setdefault(term, []).append(row)
    idf = known["idf"].to_numpy()
    rows = {term: (at[r], idf[r[0]]) for term, r in held.items()}
    best, hits, sums = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids))
    for terms, pages in zip(sets["terms"].to_pylist(), sets["pages"].to_pylist()):
        got = [rows[t] for t in terms if t in rows]
        if got:
            sums.fill(0.0)
            for where, weight in got:
                sums[where] += weight
            np.maximum(best, sums, out=best)
            hits += pages * (sums > 0)
    return pa.table({"query_id": ids, "best": best, "hits": hits})


@dataclass(frozen=True)
class TermIndex:
    """The index in a store; path_type is the type of the pages' path."""

    store: Store
    path_type: str = "long"
    unspaced: bool = False

    @property
    def _posting(self) -> str:
        return f"term string, path {self.path_type}, " + ", ".join([f"{c} int" for c in COUNTS] + [f"{c} int" for c in LENGTHS])

    @property
    def by_term(self) -> Relation:
        return Relation("by_term", self._posting, "term", spread="path")

    @property
    def by_page(self) -> Relation:
        return Relation("by_page", self._posting, "path")

    @property
    def names(self) -> Relation:
        return Relation("names", f"term string, path {self.path_type}", "term", spread="path")

    @property
    def terms(self) -> Relation:
        return Relation("terms", "term string", "term")

    @property
    def grams(self) -> Relation:
        return Relation("grams", "gram string, term string", "gram")

    @property
    def pages(self) -> Relation:
        return Relation("pages", f"path {self.path_type}, digest long, " + ", ".join(f"{c} int" for c in LENGTHS), "path")

    def relations(self) -> list[Relation]:
        return [self.by_term, self.by_page, self.names, self.terms, self.grams, self.pages]

    def signature(self) -> str | None:
        said = self.store.last()
        return said["signature"] if said else None

    def statistics(self) -> dict[str, float]:
        """Number of pages, and the mean length of each field over pages that have it."""
        said = self.store.last() or {"pages": 0, "fields": {}}
        means = {f"avg_{f}": (total / filled if filled else 0.0) for f in FIELDS for filled, total in [said["fields"].get(f, (0, 0))]}
        return {"pages": said["pages"], **means}

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, path, counts and lengths of the fields) of the terms, or all."""
        return self.store.read(self.by_term, terms).drop("n")

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df)."""
        return self.store.read(self.terms, terms).select("term", F.col("n").alias("df"))

    def words_of(self, pages: DataFrame) -> DataFrame:
        """(path, term), each once, of some pages (path)."""
        return self.store.read(self.by_page, pages).select("path", "term").distinct()

    def like(self, grams: DataFrame) -> DataFrame:
        """(gram, term): the vocabulary's words that have one of the trigrams (gram)."""
        return self.store.read(self.grams, grams).drop("n")

    def update(self, pages: DataFrame, gone: DataFrame | None = None, *, signature: str, whole: bool = False) -> TermIndex:
        """Bring the index to these pages (path, title, aliases, summary, text) in place of those of the same path, and take out gone (path).

        whole: the pages are all there are; unchanged ones are passed over and missing ones go. Of pages that repeat a path
        each counts.
        """
        store = self.store
        before = store.last()
        folder = uuid.uuid4().hex
        fresh = materialize(self._cut(pages), "index-cut")
        words = fresh.agg(F.coalesce(F.sum(sum((F.col(c) for c in LENGTHS), F.lit(0)).cast("long")), F.lit(0))).first()[0]
        parts = max(1, -(-words // (WORDS_PER_TASK * store.buckets)))
        now = fresh.groupBy(*self.pages.names).agg(F.count("*").alias("n"))
        if before is None:
            differ = materialize(now, "index-pages")
            delta = store.write(self.by_page, self._postings(fresh, parts).withColumn("n", F.lit(1)), folder, placed=True)
            words = delta.select("path", "term", "n").distinct()
        else:
            touched = None if whole else now.select("path") if gone is None else now.select("path").unionByName(gone.select("path"))
            differ = materialize(changed(store.read(self.pages, touched), now, self.pages.names), "index-pages")
            paths = materialize(differ.select("path").distinct(), "index-paths")
            old = materialize(store.read(self.by_page, paths), "index-old")
            new = materialize(self._postings(fresh.join(paths, "path", "left_semi"), parts).withColumn("n", F.lit(1)), "index-new")
            delta = store.write(self.by_page, changed(old, new, self.by_page.names), folder, parts=parts)
            words = changed(old.select("path", "term", F.lit(1).alias("n")).distinct(), new.select("path", "term", "n").distinct(), ["path", "term"])
        df = materialize(words.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0"), "index-df")
        named = delta.where("tf_title + tf_alias > 0").groupBy("term", "path").agg(F.sum("n").alias("n")).where("n <> 0")
        if before is None:
            turned = df.select("term", F.lit(1).alias("n"))
        else:
            had = store.read(self.terms, df).select("term", F.col("n").alias("had"))
            both = df.join(had, "term", "left").withColumn("had", F.coalesce("had", F.lit(0)))
            turned = both.select("term", F.when(F.col("had") == 0, 1).when(F.col("had") + F.col("n") == 0, -1).alias("n")).where("n IS NOT NULL")
        grams = turned.select(F.explode(word_grams(F.col("term"))).alias("gram"), "term", "n")
        sums = [F.coalesce(F.sum(F.col("n") * part), F.lit(0)).cast("long") for c in LENGTHS for part in ((F.col(c) > 0).cast("long"), F.col(c))]
        moved = list(differ.agg(F.coalesce(F.sum("n"), F.lit(0)), *sums).first())
        said = before or {"pages": 0, "fields": {}}
        fields = {f: [a + b for a, b in zip(said["fields"].get(f, (0, 0)), moved[1 + 2 * k : 3 + 2 * k])] for k, f in enumerate(FIELDS)}
        changes = {self.by_term: delta, self.by_page: None, self.names: named, self.terms: df, self.grams: grams, self.pages: differ}
        store.commit(changes, {"signature": signature, "pages": said["pages"] + moved[0], "fields": fields}, folder, parts)
        return self

    def _cut(self, pages: DataFrame) -> DataFrame:
        """(path, digest, lengths, words): the words of all fields in one array, those of a field after the other."""
        cut = segment if self.unspaced else spaced_words
        of = {f: cut(F.coalesce(f, F.lit(""))) for f in FIELDS if f != "alias"}
        of["alias"] = F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), cut))
        digest = F.xxhash64(*(F.coalesce(f, F.lit("")) for f in FIELDS if f != "alias"), F.coalesce("aliases", F.array().cast("array<string>")))
        return pages.select("path", digest.alias("digest"), *(F.size(of[f]).alias(f"len_{f}") for f in FIELDS), *(of[f].alias(f"words_{f}") for f in FIELDS))

    def _postings(self, cut: DataFrame, parts: int = 1) -> DataFrame:
        of_field = lambda k: lambda w: F.struct(w.alias("term"), F.lit(k).alias("field"))
        tagged = F.concat(*(F.transform(f"words_{f}", of_field(k)) for k, f in enumerate(FIELDS)))
        words = cut.repartition(self.store.buckets * parts, "path").select("path", *LENGTHS, F.inline(tagged))
        counted = words.groupBy("term", "path", *LENGTHS).agg(*(F.count_if(F.col("field") == k).cast("int").alias(c) for k, c in enumerate(COUNTS)))
        return counted.select(*self.by_term.names)

    def _scores(self, held: DataFrame, word: str, df: DataFrame, weights: dict[str, float]) -> DataFrame:
        """(path, word, s): saturated weights by rarity; df is (word, df)."""
        said = self.statistics()
        w = page_weight(said, weights)
        rarity = df.select(word, retrieval.idf(F.lit(float(said["pages"])), F.col("df")).alias("idf"))
        return held.select("path", word, w.alias("w")).where("w > 0").join(rarity, word).select("path", word, (F.col("idf") * F.col("w") / (retrieval.K1 + F.col("w"))).alias("s"))

    def search(self, queries: DataFrame, *, weights: dict[str, float] | None = None, out_of_vocabulary: bool = True) -> DataFrame:
        """(query_id, path, score, found) as retrieval.bm25f, from the postings of the queries' terms."""
        weights = weights or WEIGHTS
        asked = materialize(queries.where("weight <> 0").select("query_id", "term", "weight"), "asked")
        df = materialize(self.frequencies(asked), "asked-df")
        known = self._scores(self.postings(asked), "term", df, weights)
        # postings are few beside their pairs with queries: dealt by page, they are summed where they meet
        scored = known.repartition("path").join(retrieval.small(asked), "term").select("query_id", "path", (F.col("weight") * F.col("s")).alias("s"), F.lit(1).alias("hit"))
        if out_of_vocabulary:
            missing = materialize(asked.join(df, "term", "left_anti").withColumn("grams", word_grams(F.col("term"))).where(F.size("grams") >= 3), "asked-missing")
            if not missing.isEmpty():
                scored = scored.unionByName(self._backed_off(missing, weights))
        return scored.groupBy("query_id", "path").agg(F.round(F.sum("s"), 9).alias("score"), F.sum("hit").alias("found")).where("score > 0")

    def best(self, queries: DataFrame, k: int, *, by: tuple[str, ...] = ("score",), weights: dict[str, float] | None = None, out_of_vocabulary: bool = True) -> DataFrame:
        """(by, query_id, path, score, found, rank): the first k pages of each query in search, by score or by found, ties in path order.

        The pairs of a query and a page stay in tasks: the postings are dealt by page, every part meets every block of the queries, and
        a task gives its first k. Where words are missing, all postings of pages with their trigrams are dealt, once to count
        the pages of each trigram and once to score.
        """
        weights = weights or WEIGHTS
        said = self.statistics()
        asked = materialize(queries.where("weight <> 0").select("query_id", "term", F.col("weight").cast("double").alias("weight")), "asked")
        df = materialize(self.frequencies(asked), "asked-df")
        rarity = lambda d: retrieval.idf(F.lit(float(said["pages"])), d)
        rows = self._scores(self.postings(asked), "term", df, weights).select("path", "term", "s")
        many = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        right = asked.join(df, "term", "left").select("query_id", "term", "weight", rarity(F.col("df")).alias("idf"))
        missing = asked.join(df, "term", "left_anti").withColumn("grams", word_grams(F.col("term"))).where(F.size("grams") >= 3) if out_of_vocabulary else None
        if missing is not None and not (missing := materialize(missing, "asked-missing")).isEmpty():
            grams = materialize(missing.select(F.explode("grams").alias("gram")).distinct(), "asked-trigrams")
            words = materialize(self.like(grams).select("term").distinct(), "asked-words")
            few = words.count() <= BROADCAST_KEYS
            cells = self.postings(words) if few else self.store.read(self.by_page).where(~F.col("term").rlike(f"[{UNSPACED}]")).drop("n")
            had = self.frequencies(words) if few else self.frequencies()
            many += had.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
            parts = max(1, -(-many // POSTINGS_PER_TASK))
            left = cells.select("path", "term", self._part(parts).alias("part"))
            met = left.groupBy("part").cogroup(grams.withColumn("part", _every(parts)).groupBy("part")).applyInArrow(pagetop.gram_pages, "gram string, df long")
            gdf = materialize(met.groupBy("gram").agg(F.sum("df").alias("df")), "asked-gram-df")
            rows = rows.unionByName(cells, allowMissingColumns=True)
            right = right.unionByName(gdf.select(F.col("gram").alias("term"), rarity(F.col("df")).alias("idf")), allowMissingColumns=True)
        blocks = max(1, -(-asked.select("query_id").distinct().count() // QUERIES_AT_ONCE))
        parts = max(1, -(-many // POSTINGS_PER_TASK), -(-int(said["pages"]) // PAGES_AT_ONCE))
        left = rows.withColumn("part", self._part(parts)).withColumn("block", _every(blocks))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        right = right.withColumn("block", F.explode(F.when(F.col("weight").isNull(), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(block)))).withColumn("part", _every(parts))
        means = {c: float(v) for c, v in said.items()}

        def meet(pages: pa.Table, block: pa.Table) -> pa.Table:
            return pagetop.best_pages(pages, block, k, by, weights, means, retrieval.K1, retrieval.B)

        schema = f"by string, query_id {asked.schema['query_id'].dataType.simpleString()}, path {self.path_type}, score double, found long"
        met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, schema)
        order = F.when(F.col("by") == "score", F.col("score")).otherwise(F.col("found").cast("double"))
        place = F.row_number().over(Window.partitionBy("query_id", "by").orderBy(order.desc(), "path"))
        return materialize(met, "asked-best").withColumn("rank", place).where(F.col("rank") <= k)

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")

    def _backed_off(self, missing: DataFrame, weights: dict[str, float]) -> DataFrame:
        asked = missing.select("term", F.explode("grams").alias("gram")).distinct()
        words = materialize(self.like(asked), "asked-words")
        held = self.postings(words).join(words, "term").groupBy("path", "gram", *LENGTHS).agg(*(F.sum(c).alias(c) for c in COUNTS))
        held = materialize(held, "asked-grams")
        df = held.select("path", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df"))
        scores = self._scores(held, "gram", df, weights).repartition("path")
        backed = scores.join(retrieval.small(asked), "gram").groupBy("term", "path").agg(F.sum("s").alias("s"), F.count("*").alias("matched")).where("matched >= 2")
        return missing.join(backed, "term").select("query_id", "path", (F.col("weight") * F.col("s") / F.size("grams")).alias("s"), F.lit(0).alias("hit"))

    def name_coverage(self, queries: DataFrame) -> DataFrame:
        """(query_id, path, coverage) as retrieval.name_coverage, from the name tier alone."""
        asked = materialize(queries.select("query_id", "term").distinct(), "asked")
        rarity = self.frequencies(asked).select("term", retrieval.idf(F.lit(float(self.statistics()["pages"])), F.col("df")).alias("idf"))
        known = materialize(asked.join(rarity, "term"), "asked-known")
        total = known.groupBy("query_id").agg(F.sum("idf").alias("total"))
        matched = known.join(self.store.read(self.names, asked), "term").groupBy("query_id", "path").agg(F.sum("idf").alias("matched"))
        return matched.join(total, "query_id").select("query_id", "path", F.when(F.col("total") == 0, 0.0).otherwise(F.col("matched") / F.col("total")).alias("coverage"))

    def best_coverage(self, queries: DataFrame) -> DataFrame:
        """(query_id, coverage, hits): the greatest name_coverage of each query and the number of pages that have one.

        No pair of a query and a page is a row: pages of the same asked words are one set with its pages, and a part of
        the sets meets a block of the queries in a task, which keeps two numbers for each query.
        """
        asked = materialize(queries.select("query_id", "term").distinct(), "asked")
        rarity = self.frequencies(asked).select("term", retrieval.idf(F.lit(float(self.statistics()["pages"])), F.col("df")).alias("idf"))
        known = materialize(asked.join(rarity, "term").select("query_id", "term", "idf"), "asked-known")
        total = known.groupBy("query_id").agg(F.sum("idf").alias("total"))
        named = self.store.read(self.names, asked).join(rarity.select("term"), "term", "left_semi")
        sets = named.groupBy("path").agg(F.array_sort(F.collect_set("term")).alias("terms")).groupBy("terms").agg(F.count("*").alias("pages"))
        sets = materialize(sets, "asked-sets")
        parts, blocks = max(1, -(-sets.count() // SETS_PER_TASK)), max(1, -(-total.count() // QUERIES_PER_TASK))
        left = sets.withColumn("part", F.pmod(F.xxhash64("terms"), F.lit(parts)).cast("int")).withColumn("block", _every(blocks))
        right = known.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", _every(parts))
        schema = f"query_id {known.schema['query_id'].dataType.simpleString()}, best double, hits long"
        met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_coverage_met, schema)
        best = met.groupBy("query_id").agg(F.max("best").alias("best"), F.sum("hits").alias("hits")).where("hits > 0")
        return best.join(total, "query_id").select("query_id", F.when(F.col("total") == 0, 0.0).otherwise(F.col("best") / F.col("total")).alias("coverage"), "hits")

    def expand(self, queries: DataFrame, *, pages_of: tuple[int, ...] = (5, 5), words_of: tuple[int, ...] = (10, 10), out_of_vocabulary: bool = True) -> DataFrame:
        """(query_id, term, weight) as retrieval.expand; each round reads the terms asked for and the chosen pages."""
        grown = materialize(queries.select("query_id", "term", "weight"), "query-terms")
        pages = self.statistics()["pages"]
        for k, m in zip(pages_of, words_of):
            if k <= 0 or m <= 0:
                break
            chosen = materialize(self.best(grown, k, out_of_vocabulary=out_of_vocabulary), "query-pages")
            words = materialize(self.words_of(chosen), "query-words")
            new = retrieval.distinctive_terms(words, chosen, grown, self.frequencies(words), pages, m)
            grown = materialize(grown.unionByName(new.select("query_id", "term", F.lit(1.0).alias("weight"))), "query-terms")
        return grown


def kept(index: TermIndex, signature: str, pages: DataFrame) -> TermIndex:
    """The index with this signature: as it is kept, or brought up to date from the pages, which are only then looked at.

    If somebody else brings it to the same signature meanwhile, theirs is taken.
    """
    if index.signature() == signature:
        return index
    try:
        return index.update(pages, signature=signature, whole=True)
    except AnalysisException:
        if index.signature() == signature:
            return index
        raise
