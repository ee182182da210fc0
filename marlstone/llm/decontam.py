"""Benchmark decontamination by spaced-seed hashing.

Words are lower-case runs of letters and digits.  A seed is a fixed mask over
consecutive words that ignores some positions, so a seed survives a substituted
word at an ignored place.  The hashes of all seeds of the test items are joined
with those of the documents.  A hit names an alignment (document, item, offset);
each alignment is then verified on the words themselves: within it, the best
window of `window_words` words (the whole item if it is shorter) must agree in at
least `similarity` of its words.  Matches before and after the hit count, with
substitutions anywhere.

Nothing that meets the default similarity is missed.  The four masks take four of five
consecutive words, whichever one of them is substituted.  A window of 5 to 9 words may
have one substitution, one of 10 to 14 two, one of 15 three; of its one, two or three
groups of five words one has at most one.  An item that is shorter than every mask has
one seed, all its words.

The documents' seeds are made and looked up inside one scan: no window of a text
is shuffled where the items' seeds are few enough to be broadcast (`broadcast_seeds`,
checked by a count); beyond that the same join runs by shuffle.  Only documents
with a hit are read again for the verification.

Defined results.  A row for each (doc_id, item) with a verified overlap, its best
alignment (ties: most agreeing words, then the least offset).  Items with equal
words are one item, named by the least item_id.  Null and empty texts have no words
and match nothing; items of fewer than five words match if all their words stand in a
row.  Rows that repeat a doc_id, or have a null one, are one document with several
texts, each compared by itself.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, materialize, text_or_empty

WORD = r"[\p{L}\p{N}]+"
#: Positions that count; four words each, the others are ignored.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
SIMILARITY = 0.8
WINDOW_WORDS = 15
BROADCAST_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), lambda w: F.xxhash64(w))


def all_masks(masks: Sequence[Sequence[int]]) -> list[tuple[int, ...]]:
    """masks, and after them those of items that are shorter than all of them: every word of 1, 2, ... words."""
    return [tuple(m) for m in masks] + [tuple(range(n)) for n in range(1, min(max(m) for m in masks) + 1)]


def seeds(rows: DataFrame, keep: Sequence[str], masks: dict[int, tuple[int, ...]], whole: int | None = None) -> DataFrame:
    """(*keep, pos, mask, seed): the seed hashes of the column words, an array of word hashes; masks by their numbers.

    Masks from number `whole` on are made only of arrays that they fill. The window is laid out as columns before it is hashed, which
    keeps the work in generated code.
    """
    offsets = sorted({o for m in masks.values() for o in m})
    size = F.size("words")
    shifted = [F.when(size > o, F.slice("words", F.lit(o + 1), F.greatest(size - o, F.lit(0)))).otherwise(F.array().cast("array<bigint>")).alias(f"w{o}") for o in offsets]
    laid = rows.where(size > min(max(m) for m in masks.values())).select(*keep, size.alias("size"), F.posexplode(F.arrays_zip(*shifted)).alias("pos", "at"))
    keys = []
    for k, m in masks.items():
        fits = F.col(f"at.w{max(m)}").isNotNull()
        fits = fits if whole is None or k < whole else fits & (F.col("size") == len(m))
        keys.append(F.when(fits, F.struct(F.lit(k).alias("mask"), F.xxhash64(F.lit(k), *[F.col(f"at.w{o}") for o in m]).alias("seed"))))
    return laid.select(*keep, "pos", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL").select(*keep, "pos", "key.mask", "key.seed")


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    masks: Sequence[Sequence[int]] = MASKS,
    similarity: float = SIMILARITY,
    window_words: int = WINDOW_WORDS,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_words, matched, window, window_matched).

    doc_word is the document's word at which the item's first word would lie (below
    zero where the item's start is cut off), matched the agreeing words of the
    whole alignment, window_matched those of the best window.
    """
    tests = (
        items.select(F.col(item_id_col).alias("item_id"), word_hashes(text_or_empty(item_text_col)).alias("words"))
        .groupBy("words")
        .agg(F.min("item_id").alias("item_id"))
    )
    tests = materialize(tests, "decontam-items")
    numbered = dict(enumerate(all_masks(masks)))
    wanted = seeds(tests, ["item_id"], numbered, len(masks)).select("item_id", F.col("pos").alias("item_pos"), "mask", "seed").distinct()
    wanted = materialize(wanted, "decontam-seeds")
    few = wanted.count() <= broadcast_seeds
    asked = {r["mask"] for r in wanted.select("mask").distinct().collect()}  # a row for each mask
    numbered = {k: m for k, m in numbered.items() if k in asked} or {0: tuple(masks[0])}
    lookup = F.broadcast(wanted.drop("mask")) if few else wanted.drop("mask")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = seeds(texts.select("doc_id", "text_key", word_hashes(F.col("text")).alias("words")), ["doc_id", "text_key"], numbered).join(lookup, "seed")
    hits = materialize(found.select("doc_id", "text_key", "item_id", (F.col("pos") - F.col("item_pos")).alias("doc_word")).distinct(), "decontam-hits")

    # texts with a hit are read again, those that repeat id and text once
    some = hits.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key")).distinct()
    again = texts.join(some, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left_semi")
    again = again.groupBy("doc_id", "text_key").agg(F.min("text").alias("text")).select("doc_id", "text_key", word_hashes(F.col("text")).alias("doc_words"))
    # every item has a seed for each of its words but the last three, so items are few if the seeds are
    tests = tests.where(F.size("words") > 0).select("item_id", F.col("words").alias("item_words"))
    aligned = hits.join(F.broadcast(tests) if few else tests, "item_id").withColumnsRenamed({"doc_id": "of", "text_key": "of_key"})
    aligned = aligned.join(again, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")))
    length = F.size("item_words")
    agree = F.transform(
        "item_words",
        lambda w, i: F.when((i + F.col("doc_word") >= 0) & (F.get(F.col("doc_words"), i + F.col("doc_word")) == w), 1).otherwise(0),
    )
    window = F.least(length, F.lit(window_words))

    def slide(state: Column, i: Column) -> Column:
        now = state["now"] + F.get(F.col("agree"), i) - F.when(i >= F.col("window"), F.get(F.col("agree"), i - F.col("window"))).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    verified = (
        aligned.select("doc_id", "item_id", "doc_word", agree.alias("agree"), window.alias("window"), length.alias("item_words"))
        .withColumn("window_matched", F.aggregate(F.sequence(F.lit(0), F.col("item_words") - 1), start, slide, lambda s: s["best"]))
        .withColumn("matched", F.aggregate("agree", F.lit(0), lambda s, x: s + x))
        .where(F.col("window_matched") >= F.ceil(F.col("window") * similarity))
    )
    order = F.struct("window_matched", "matched", -F.col("doc_word"))
    return (
        verified.groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("doc_word", "item_words", "matched", "window", "window_matched"), order).alias("best"))
        .select("doc_id", "item_id", "best.*")
    )


def clean_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that overlap a test item."""
    (leaked_id,) = fresh(docs.columns, "leaked_id")
    leaked = overlaps(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), items, **how)
    leaked = leaked.select(F.col("doc_id").alias(leaked_id)).distinct()
    return docs.join(leaked, docs[f"`{id_col}`"].eqNullSafe(F.col(leaked_id)), "left_anti")


def overlaps_sql() -> str:
    """The rows of overlaps in DuckDB SQL over `documents` and `benchmark`."""
    words = f"regexp_extract_all(lower(coalesce(text, '')), '{WORD}')"
    seed = "SELECT {id}, i - 1 AS pos, {k} AS mask, [{cols}] AS seed FROM {t}, unnest(range(1, len(words) - {span} + 1)) AS u(i){only}"
    both = {
        t: " UNION ALL ".join(
            seed.format(id=i, k=k, t=t, span=max(m), cols=", ".join(f"words[i + {o}]" for o in m), only=f" WHERE len(words) = {len(m)}" if t == "b" and k >= len(MASKS) else "")
            for k, m in enumerate(all_masks(MASKS))
            if t == "b" or k < len(MASKS)
        )
        + ("" if t == "b" else "".join(f" UNION ALL SELECT doc_id, i - 1, {k}, words[i:i + {len(m) - 1}] FROM d, unnest(range(1, len(words) - {len(m) - 2})) AS u(i) WHERE (SELECT count(*) FROM b WHERE len(words) = {len(m)}) > 0" for k, m in enumerate(all_masks(MASKS)) if k >= len(MASKS)))
        for t, i in (("d", "doc_id"), ("b", "item_id"))
    }
    return f"""
WITH d AS (SELECT doc_id, {words} AS words FROM documents),
b AS (SELECT min(item_id) AS item_id, words FROM (SELECT item_id, {words} AS words FROM benchmark) GROUP BY words),
ds AS ({both["d"]}), bs AS ({both["b"]}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS doc_word FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed),
agree AS (
  SELECT h.doc_id, h.item_id, doc_word, i, len(b.words) AS item_words, least(len(b.words), {WINDOW_WORDS}) AS win,
    CASE WHEN i + doc_word >= 1 AND d.words[i + doc_word] = b.words[i] THEN 1 ELSE 0 END AS same
  FROM hits h JOIN d ON h.doc_id = d.doc_id JOIN b ON h.item_id = b.item_id, unnest(range(1, len(b.words) + 1)) AS u(i)),
running AS (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, doc_word ORDER BY i) AS upto FROM agree),
slid AS (
  SELECT a.*, a.upto - coalesce(z.upto, 0) AS win_same FROM running a LEFT JOIN running z
    ON a.doc_id = z.doc_id AND a.item_id = z.item_id AND a.doc_word = z.doc_word AND z.i = a.i - a.win),
verified AS (
  SELECT doc_id, item_id, doc_word, item_words, win, max(win_same) AS win_matched, sum(same) AS matched FROM slid GROUP BY ALL
  HAVING max(win_same) >= ceil(win * {SIMILARITY}))
SELECT doc_id, item_id, doc_word::INTEGER AS doc_word, item_words::INTEGER AS item_words, matched::INTEGER AS matched, win::INTEGER AS "window", win_matched::INTEGER AS window_matched
FROM verified QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY win_matched DESC, matched DESC, doc_word) = 1
"""
