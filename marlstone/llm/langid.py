"""Language identification with labelled spans of mixed-language texts.

Words are lower-case runs of letters and marks.  The script of a word, by ranges of
code points, narrows its candidates to the languages that were seen in that script.
A word's score for a language is the log-likelihood of its character n-grams (one to
four characters, word ends included), tempered to one vote per character.  The
Viterbi path over a text's words, with a penalty for every switch of language,
labels its spans; the language with most letters on the path is the text's, and the
score is its share of the letters.

The n-gram table is fitted on a sample of at most `train_docs` labelled rows of each
language (chosen by a hash of id and text, repeated rows once) and has 2**`bits` rows and a column for each
language, so what goes to the tasks does not grow with the corpus.  Every text is
scored whole, in one scan without a shuffle.

Defined results.  Null texts and texts without a letter (of Unicode's class L, whatever
its range; the ranges only narrow candidates) are `und` with score 0.
Where no row is labelled, every text is `und`.  Ties go to the language that comes
first in alphabetical order.  Repeated rows and null doc_ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, give_back

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
LETTER = r"\p{L}"
#: Script ranges: fixed values of the Unicode block layout (first code point, script); a range ends where the next begins.
SCRIPT_RANGES = (
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"), (0x00B5, "latin"), (0x00B6, "none"),
    (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"), (0x00D7, "none"), (0x00D8, "latin"), (0x00F7, "none"), (0x00F8, "latin"), (0x02B0, "mark"), (0x0370, "greek"),
    (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "syllabics"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "other"), (0x1D00, "latin"), (0x1DC0, "mark"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "none"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "none"), (0x3400, "han"), (0x4DC0, "none"), (0x4E00, "han"),
    (0xA000, "yi"), (0xA4D0, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "none"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "mark"), (0xFE70, "arabic"), (0xFF00, "none"), (0xFF21, "latin"), (0xFF3B, "none"),
    (0xFF41, "latin"), (0xFF5B, "none"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "none"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPT_RANGES], np.uint32)
SCRIPTS = tuple(sorted({n for _, n in SCRIPT_RANGES} - {"none", "mark"}))
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(n) if n in SCRIPTS else -1 for _, n in SCRIPT_RANGES], np.int16)
IMPOSSIBLE = np.float32(-1e4)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # n-gram bucket x language
    scripts: np.ndarray  # script x language: seen in training
    penalty: float

    @property
    def bits(self) -> int:
        return int(np.log2(len(self.table)))


def words_of(texts: pa.Array) -> pa.ListArray:
    """The lower-case words of each text; empty strings among them are no words."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+")


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with a line end before, between and after them; where each word starts there, and its length."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    return points, np.cumsum(lens + 1) - lens, lens


def _grams(points: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the bucket of the n-gram that starts there, and whether a word end lies inside it."""
    n = len(points) - order + 1
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    cut = np.zeros(n, bool)
    for k in range(order):
        h = (h ^ points[k : k + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        if 0 < k < order - 1 or order == 1:
            cut |= points[k : k + n] == 10
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits), cut


def _word_grams(points: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of all n-grams, no position twice in one pair; a leading word end belongs to the word after it."""
    for order in ORDERS:
        if len(points) < order:
            continue
        bucket, cut = _grams(points, order, bits)
        at = np.flatnonzero(~cut)
        lead = points[at] == 10
        if order == 2:  # a line end followed by a line end
            keep = ~(lead & (points[at + 1] == 10))
            at, lead = at[keep], lead[keep]
        yield at[~lead], bucket[at[~lead]]
        yield at[lead] + 1, bucket[at[lead]]


def scripts_of(points: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The script of each word's first letter, -1 without one."""
    script = _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, points, "right") - 1]
    out = np.full(len(starts), -1, np.int16)
    some = lens > 0
    out[some] = script[starts[some]]
    for k in np.flatnonzero(some & (out < 0)):  # words that begin with a mark
        found = script[starts[k] : starts[k] + lens[k]]
        out[k] = next((x for x in found if x >= 0), -1)
    return out


def word_scores(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(word x language scores, letters of each word, 0 for a word without a letter)."""
    points, starts, lens = _code_points(words)
    total = np.zeros((len(points), len(model.languages)), np.float32)
    for at, bucket in _word_grams(points, model.bits):
        total[at] += model.table[bucket]
    out = np.zeros((len(words), len(model.languages)), np.float32)
    some = np.flatnonzero(lens > 0)
    if len(some):
        bounds = np.stack([starts[some], starts[some] + lens[some]], 1).ravel()
        out[some] = np.add.reduceat(total, bounds, axis=0)[::2]
    script = scripts_of(points, starts, lens)
    seen = model.scripts[script]
    narrowed = (script >= 0) & seen.any(1)
    out[narrowed] = np.where(seen[narrowed], out[narrowed], IMPOSSIBLE)
    letter = pc.match_substring_regex(pa.array(words, pa.string()), LETTER).to_numpy(zero_copy_only=False)
    return out, np.where(letter, lens, 0)


def viterbi(scores: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each token: the best path of every text, tokens offsets[k]:offsets[k + 1] being text k's."""
    lens = np.diff(offsets)
    by = np.argsort(-lens, kind="stable")
    first, lens = offsets[by], lens[by]
    best = np.zeros((len(by), scores.shape[1]), np.float32)
    stayed = np.zeros((len(tokens), scores.shape[1]), bool)
    came = np.zeros(len(tokens), np.int16)
    active = np.searchsorted(-lens, -np.arange(lens[0] if len(lens) else 0), "left")  # texts longer than t
    for t, k in enumerate(active.tolist()):
        at = first[:k] + t
        v = best[:k]
        if t:
            top = v.argmax(1)
            switch = v[np.arange(k), top][:, None] - penalty
            stay = v >= switch
            stayed[at], came[at] = stay, top
            v = np.where(stay, v, switch)
        best[:k] = v + scores[tokens[at]]
    state = best.argmax(1).astype(np.int16)
    path = np.zeros(len(tokens), np.int16)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        now = state[:k]
        path[at] = now
        if t:
            state[:k] = np.where(stayed[at, now], now, came[at])
    return path


def fit(rows: list[tuple[str, str]], *, bits: int = 16, penalty: float = 8.0, smoothing: float = 0.5, script_share: float = 0.01) -> Model:
    """A model from (text, language) rows."""
    languages = tuple(sorted({lang for _, lang in rows}))
    counts = np.zeros((len(languages), 1 << bits))
    seen = np.zeros((len(SCRIPTS), len(languages)))
    for k, lang in enumerate(languages):
        coded = words_of(pa.array([t for t, x in rows if x == lang], pa.string())).flatten().dictionary_encode()
        times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(float)
        words = coded.dictionary.to_pylist()
        points, starts, lens = _code_points(words)
        of = np.concatenate(([0], np.repeat(times, lens + 1), np.zeros(1)))  # how often the word at each position occurs
        for at, bucket in _word_grams(points, bits):
            counts[k] += np.bincount(bucket, weights=of[at], minlength=1 << bits)
        script = scripts_of(points, starts, lens)
        seen[:, k] = np.bincount(script[script >= 0], weights=(times * lens)[script >= 0], minlength=len(SCRIPTS))
    p = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True)
    table = (np.log(p) - np.log(p).mean(0)).T.astype(np.float32) / len(ORDERS) if languages else np.zeros((1 << bits, 0), np.float32)
    return Model(languages, np.ascontiguousarray(table), seen > script_share * np.maximum(seen.sum(0), 1e-9), penalty)


def sample_labelled(docs: DataFrame, keep: Column, *, id_col: str, text_col: str, lang_col: str, train_docs: int) -> list[tuple[str, str]]:
    """(text, language) of at most train_docs rows of each language, those with the least hashes of id and text; repeated rows count once."""
    named = docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    named = named.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("hash"))
    drawn = F.pmod("hash", F.lit(1 << 30))
    counts = named.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("rows")).collect()  # one row for each language
    share = F.lit(0)
    for r in counts:  # a little more than is needed, for the draw and the count are inexact
        share = F.when(F.col("lang") == r.lang, min(1 << 30, int((1 << 30) * 1.25 * train_docs / max(r.rows, 1)))).otherwise(share)
    some = named.where(drawn < share).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(drawn, "hash"))
    rows = some.withColumn("place", place).where(F.col("place") <= train_docs).select("text", "lang").collect()
    return [(text, lang) for lang, text in sorted((lang, text) for text, lang in rows)]


def identify(
    docs: DataFrame,
    model: Model,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
    lang_col: str = "lang_pred",
    score_col: str = "score",
    spans_col: str = "spans",
    chunk_words: int = 1_000_000,
) -> DataFrame:
    """(doc_id, lang_pred, score, spans), with keep those columns instead of doc_id.

    spans are (first_word, words, lang) of the path, in order.
    """
    if keep is None:
        docs, keep = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["doc_id"]
        text_col = "text"
    new = [lang_col, score_col, spans_col]
    keep = [c for c in keep if c not in new]
    bounded_batches(docs.sparkSession, 4 << 20)
    kinds_of = dict(docs.dtypes)
    named = [*keep, *([] if text_col in keep else [text_col])]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(named)])  # mapInArrow takes no names with dots
    at = named.index(text_col)
    kinds = ("string", "double", "array<struct<first_word:int,words:int,lang:string>>")
    schema = ", ".join([*(f"`{c}` {kinds_of[c]}" for c in keep), *(f"`{n}` {k}" for n, k in zip(new, kinds))])

    def label(texts: pa.Array) -> tuple[list[str], np.ndarray, pa.Array]:
        n, langs = len(texts), len(model.languages)
        words = words_of(texts)
        coded = words.flatten().dictionary_encode()
        scores, letters = word_scores(coded.dictionary.to_pylist(), model)
        tokens, offsets = coded.indices.to_numpy(), words.offsets.to_numpy().astype(np.int64)
        real = letters[tokens] > 0
        doc = np.repeat(np.arange(n), np.diff(offsets))[real]
        tokens = tokens[real]
        offsets = np.searchsorted(doc, np.arange(n + 1))
        path = viterbi(scores, tokens, offsets, model.penalty)
        share = np.bincount(doc * langs + path, weights=letters[tokens], minlength=n * langs).reshape(n, langs)
        total = share.sum(1)
        top = share.argmax(1)
        score = np.where(total > 0, share[np.arange(n), top] / np.maximum(total, 1), 0.0)
        names = [model.languages[k] if t else UNKNOWN for k, t in zip(top.tolist(), total.tolist())]
        begins = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])))) if len(doc) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(doc)))
        fields = [pa.array((begins - offsets[doc[begins]]).astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(list(model.languages), pa.string()).take(pa.array(path[begins]))]
        spans = pa.StructArray.from_arrays(fields, ["first_word", "words", "lang"])
        return names, score, pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[begins], np.arange(n + 1)).astype(np.int32)), spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + 6 * chunk_words, "right")))
                some = batch.slice(start, stop - start)
                if model.languages:
                    names, score, spans = label(some.column(at))
                else:
                    names, score, spans = [UNKNOWN] * len(some), np.zeros(len(some)), pa.array([[]] * len(some), SPANS)
                found = [pa.array(names, pa.string()), pa.array(score), spans]
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(len(keep))), *found], [*keep, *new])
                start = stop
            give_back()

    return rows.mapInArrow(run, schema)


SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 600, **how) -> Model:
    model = fit(sample_labelled(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col, train_docs=train_docs), **how)
    give_back()
    return model
