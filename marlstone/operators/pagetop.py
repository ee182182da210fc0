"""The best pages of each query from a part of the pages: what a task does for TermIndex.best.

A task has all postings of its pages and a block of the queries. It adds up scores in a table of queries by pages and gives the
first k of each query, so no pair of a query and a page is ever a row. Words that no page has are scored by their
trigrams: the counts of a page's trigrams are made of those of its words, in the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marlstone.functions.text import plain_grams
from marlstone.operators.corpus import FIELDS

#: Cells of a table of trigrams by pages that a task holds at once.
GRAM_CELLS = 4_000_000


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in ascending order, null first, and the place of each row's value among them."""
    values = pc.unique(column)
    values = values.take(pc.array_sort_indices(values, null_placement="at_start"))
    return values, pc.index_in(column, value_set=values).to_numpy().astype(np.int64)


def _grouped(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys 0 to n - 1, and where each begins in it."""
    return np.argsort(keys, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=n))))


class _Grams:
    """The cells of asked trigrams (from 0 on) by units that rows of words stand for; a unit is a page, or what is weighed alone of it."""

    def __init__(self, term: pa.ChunkedArray, unit: np.ndarray, units: int, asked: list[str]):
        at = {g: k for k, g in enumerate(asked)}
        words, self.word = _numbered(term)
        held = [[at[g] for g in plain_grams(w) if g in at] for w in words.to_pylist()]
        self.many = np.array([len(h) for h in held], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.flat = np.array([g for h in held for g in h], np.int64)
        self.n, self.unit, self.units = len(asked), unit, units

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first unit, number of units, cells, rows): a cell, trigram * number + unit, for each trigram of each row."""
        order, starts = _grouped(self.unit, self.units)
        step = max(1, GRAM_CELLS // max(1, self.n))
        for a in range(0, self.units, step):
            b = min(a + step, self.units)
            some = order[starts[a] : starts[b]]
            many = self.many[self.word[some]]
            row = np.repeat(some, many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.first[self.word[row]]
            yield a, b - a, self.flat[place] * (b - a) + self.unit[row] - a, row


def gram_pages(rows: pa.Table, grams: pa.Table) -> pa.Table:
    """(gram, df) of a part of the pages, rows (path, term): how many of them have a word with the trigram; grams is (gram)."""
    paths, page = _numbered(rows["path"])
    df = np.zeros(grams.num_rows, np.int64)
    for _, width, cells, _ in _Grams(rows["term"], page, len(paths), grams["gram"].to_pylist()).blocks():
        held = np.zeros(len(df) * width, bool)
        held[cells] = True
        df += held.reshape(len(df), width).sum(1)
    return pa.table({"gram": grams["gram"], "df": df}).filter(pa.array(df > 0))


def _backed_off(rows: pa.Table, page: np.ndarray, pages: int, grams: pa.Table, missing: dict[str, list], weights: dict, means: dict, k1: float, b: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, pages, points) of words that no page has; missing has (query, weight) of each word."""
    lengths = np.stack([rows[f"len_{f}"].to_numpy() for f in FIELDS], 1)
    some = np.zeros(pages, np.int64)
    some[page] = np.arange(len(page))
    split = not (lengths == lengths[some[page]]).all()
    if not split:
        unit, of, lengths = page, np.arange(pages), lengths[some]
    else:  # pages that repeat a path with other lengths are weighed alone
        each, unit = np.unique(np.column_stack([page, lengths]), axis=0, return_inverse=True)
        unit, of, lengths = unit.ravel(), each[:, 0], each[:, 1:]
    asked, rarity = grams["gram"].to_pylist(), grams["idf"].to_numpy()
    at = {g: k for k, g in enumerate(asked)}
    needs = {word: (np.array([at[g] for g in own if g in at], np.int64), len(own)) for word in missing for own in [plain_grams(word)]}
    counts = {f: rows[f"tf_{f}"].to_numpy() for f in FIELDS}
    # a page of several units is added up over them before its matches count
    whole = {word: (np.zeros(pages), np.zeros(pages, np.int64)) for word in missing} if split else {}
    for first, width, cells, row in _Grams(rows["term"], unit, len(of), asked).blocks():
        held = np.unique(cells)
        where, w = held % width + first, np.zeros(len(held))
        for f in FIELDS:
            tf = counts[f][row]
            if weights.get(f, 0.0) and tf.any():
                tf = np.bincount(cells, tf, minlength=len(asked) * width)[held]
                norm = 1.0 if f == FIELDS[-1] else 1 - b + b * lengths[where, FIELDS.index(f)] / (means[f"avg_{f}"] or 1.0)
                w += weights[f] * tf / (k1 * norm + tf)
        table = np.zeros(len(asked) * width)
        table[held] = rarity[held // width] * w / (k1 + w)
        table = table.reshape(len(asked), width)
        for word, (own, n) in needs.items():
            if not len(own):
                continue
            got = table[own]
            points, matched = got.sum(0), np.count_nonzero(got, axis=0)
            if split:
                np.add.at(whole[word][0], of[first : first + width], points)
                np.add.at(whole[word][1], of[first : first + width], matched)
                continue
            hit = np.flatnonzero(matched >= 2)
            for query, weight in missing[word]:
                yield query, first + hit, weight * points[hit] / n
    for word, (points, matched) in whole.items():
        hit = np.flatnonzero(matched >= 2)
        for query, weight in missing[word]:
            yield query, hit, weight * points[hit] / needs[word][1]


def _first(value: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest valid values, of equal ones those that come first."""
    at = np.flatnonzero(valid)
    if len(at) <= k:
        return at
    least = np.partition(value[at], len(at) - k)[len(at) - k]
    over = at[value[at] > least]
    return np.concatenate([over, at[value[at] == least][: k - len(over)]])


def best_pages(rows: pa.Table, asked: pa.Table, k: int, by: tuple[str, ...], weights: dict, means: dict, k1: float, b: float) -> pa.Table:
    """(by, query_id, path, score, found): the first k pages of each query of a block, by each of the orders, from a part of the pages.

    rows is (path, term, s) for the words that are asked for, s their points, and, if there are others, (path, term, tf_*, len_*) of all
    words with s null; asked is (query_id, term, weight) and, without a weight, trigrams (term, idf).
    """
    terms = pc.is_valid(asked["weight"])
    queries, grams = asked.filter(terms), asked.filter(pc.invert(terms)).select(["term", "idf"]).rename_columns(["gram", "idf"])
    paths, page = _numbered(rows["path"])
    ids, query = _numbered(queries["query_id"])
    score, found = np.zeros((len(ids), len(paths))), np.zeros((len(ids), len(paths)), np.int32)
    points = rows["s"].to_numpy()
    known = np.flatnonzero(~np.isnan(points))
    words, word = _numbered(rows["term"].take(pa.array(known)))
    order, starts = _grouped(word, len(words))
    at = {w: i for i, w in enumerate(words.to_pylist())}
    unique = len(np.unique(word * max(1, len(paths)) + page[known])) == len(known)  # pages may repeat a path
    missing: dict[str, list] = {}
    for q, term, weight in zip(query.tolist(), queries["term"].to_pylist(), queries["weight"].to_pylist()):
        if term in at:
            held = known[order[starts[at[term]] : starts[at[term] + 1]]]
            if unique:
                score[q, page[held]] += weight * points[held]
                found[q, page[held]] += 1
            else:
                np.add.at(score[q], page[held], weight * points[held])
                np.add.at(found[q], page[held], 1)
        else:
            missing.setdefault(term, []).append((q, weight))
    if grams.num_rows:
        others = np.flatnonzero(np.isnan(points))
        took = rows.take(pa.array(others))
        # a word that these pages lack but others have is no word that no page has: its trigrams are not asked for
        none = {t for t, i in zip(queries["term"].to_pylist(), queries["idf"].to_pylist()) if i is None}
        for q, held, more in _backed_off(took, page[others], len(paths), grams, {t: m for t, m in missing.items() if t in none}, weights, means, k1, b):
            score[q, held] += more
    score = np.round(score, 9)
    out = []
    for kind in by:
        for q in range(len(ids)):
            held = _first(score[q] if kind == "score" else found[q], score[q] > 0, k)
            out.append((kind, np.full(len(held), q), held))
    rows_, cols = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in (1, 2))
    kinds = [o[0] for o in out for _ in range(len(o[1]))]
    return pa.table({"by": pa.array(kinds, pa.string()), "query_id": ids.take(pa.array(rows_)), "path": paths.take(pa.array(cols)), "score": score[rows_, cols], "found": found[rows_, cols].astype(np.int64)})
