"""Toxicity scores from a bidirectional gated recurrent network, written and trained in numpy.

Words are lower-case runs of letters.  A word's input is a pair of recurrent states
over its characters (one read forwards, one backwards) and an embedding of the word
if training met it often.  A second bidirectional GRU reads the words of a window;
attention pools its states, and a logistic unit gives the window's score.  A text is
cut into windows of `window` words, each half overlapping the next (the last one ends
with the text); all are scored, and the text's score is the highest of them.

Training is multiple-instance learning over documents: in the first rounds toxic
documents are represented by their windows with the most telling character grams, later
by the highest-scoring ones; clean documents by their highest and by random windows.  It sees at most `train_docs` documents of each
class, of at most `train_chars` characters each, chosen by a hash of id and text; the network's size is fixed, so what goes to the
tasks does not grow with the corpus.  Texts are scored whole, in one scan.

Defined results.  Null and empty texts, and texts without a letter, score the
network's value for an empty window, whose bias starts well below 0.5.  Where a class has no
labelled row all scores are 0.  A document that is labelled both ways is drawn for both classes.  Repeated rows and null doc_ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, give_back

CHAR_ROWS = 512
F32 = np.float32


def words_of(texts: pa.Array) -> pa.ListArray:
    """The lower-case words of each text; empty strings among them are no words."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


def prefix_counts(lens: np.ndarray) -> list[int]:
    """For descending lens and every step t the number of sequences longer than t."""
    return np.searchsorted(-lens, -np.arange(int(lens[0]) if len(lens) else 0), "left").tolist()


def _add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at[k]] += rows[k] for all k, repeated places included."""
    if len(at):
        by = np.argsort(at, kind="stable")
        at = at[by]
        heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        table[at[heads]] += np.add.reduceat(rows[by], heads, axis=0)


class GRU:
    """One direction of a gated recurrent unit over sequences of rows of an input table.

    index[t] holds the rows that the sequences longer than t, sorted by falling length, read at step t.
    """

    @staticmethod
    def forward(inputs: np.ndarray, u: np.ndarray, index: list[np.ndarray], n: int, keep: bool) -> tuple[np.ndarray, list]:
        size = u.shape[0]
        h = np.zeros((n, size), F32)
        tape = []
        for rows in index:
            k = len(rows)
            x, was = inputs[rows], h[:k]
            g = was @ u
            zr = _sigmoid(x[:, : 2 * size] + g[:, : 2 * size])
            z, r = zr[:, :size], zr[:, size:]
            c = np.tanh(x[:, 2 * size :] + r * g[:, 2 * size :])
            now = c + z * (was - c)
            if keep:
                tape.append((rows, was.copy(), zr, g[:, 2 * size :], c))
            h[:k] = now
        return h, tape

    @staticmethod
    def states(inputs: np.ndarray, u: np.ndarray, index: list[np.ndarray], n: int) -> np.ndarray:
        """As forward, all states as (step, sequence, unit)."""
        size = u.shape[0]
        h = np.zeros((n, size), F32)
        out = np.zeros((len(index), n, size), F32)
        for t, rows in enumerate(index):
            k = len(rows)
            x, was = inputs[rows], h[:k]
            g = was @ u
            zr = _sigmoid(x[:, : 2 * size] + g[:, : 2 * size])
            c = np.tanh(x[:, 2 * size :] + zr[:, size:] * g[:, 2 * size :])
            h[:k] = c + zr[:, :size] * (was - c)
            out[t, :k] = h[:k]
        return out

    @staticmethod
    def backward(tape: list, u: np.ndarray, dh: np.ndarray, dstates: list[np.ndarray] | None, dinputs: np.ndarray, du: np.ndarray) -> None:
        """Add the gradients of the input table and of u; dh is of the last states, dstates of each step's."""
        size = u.shape[0]
        dh = dh.copy()
        at, dxs = [np.zeros(0, np.int64)], [np.zeros((0, 3 * size), dh.dtype)]
        for t in range(len(tape) - 1, -1, -1):
            rows, was, zr, gn, c = tape[t]
            k = len(rows)
            d = dh[:k] + (dstates[t][:k] if dstates is not None else 0)
            z, r = zr[:, :size], zr[:, size:]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (was - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], 1)
            du += was.T @ dg
            dh[:k] = d * z + dg @ u.T
            at.append(rows)
            dxs.append(np.concatenate([dz, dr, dc], 1))
        _add_rows(dinputs, np.concatenate(at), np.concatenate(dxs))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    window: int

    @staticmethod
    def new(vocabulary: dict[str, int], window: int, rng: np.random.Generator, chars: int = 12, char_units: int = 12, word_size: int = 6, units: int = 8) -> Network:
        normal = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]) if len(s) > 1 else 0.3)).astype(F32)
        p = {"chars": (rng.standard_normal((CHAR_ROWS, chars)) * 0.5).astype(F32), "words": np.zeros((len(vocabulary) + 1, word_size), F32)}
        for d in "fb":
            p[f"char_w{d}"], p[f"char_u{d}"], p[f"char_b{d}"] = normal(chars, 3 * char_units), normal(char_units, 3 * char_units), np.zeros(3 * char_units, F32)
            p[f"char_b{d}"][:char_units] = 1.0  # keep what was read
            wide = 2 * char_units + word_size
            p[f"word_w{d}"], p[f"word_u{d}"], p[f"word_b{d}"] = normal(wide, 3 * units), normal(units, 3 * units), np.zeros(3 * units, F32)
        p["attend"], p["out"], p["bias"] = normal(2 * units), normal(2 * units), np.full(1, -2.0, F32)
        return Network(p, vocabulary, window)

    # characters -> one vector for each distinct word

    def _char_index(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        by = np.argsort(-lens, kind="stable")
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) if len(words) else np.zeros(0, np.uint32)
        points = np.where(points < 384, points, 384 + points % (CHAR_ROWS - 384)).astype(np.int64)
        first, lens = (np.cumsum(lens) - lens)[by], lens[by]
        counts = prefix_counts(lens)
        return by, [points[first[:k] + t] for t, k in enumerate(counts)], [points[(first + lens - 1)[:k] - t] for t, k in enumerate(counts)]

    def word_vectors(self, words: list[str], keep: bool = False):
        by, *index = self._char_index(words)
        parts, tapes = [], []
        for d, at in zip("fb", index):
            table = self.p["chars"] @ self.p[f"char_w{d}"] + self.p[f"char_b{d}"]
            h, tape = GRU.forward(table, self.p[f"char_u{d}"], at, len(words), keep)
            back = np.empty_like(h)
            back[by] = h
            parts.append(back)
            tapes.append(tape)
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        return np.concatenate([*parts, self.p["words"][ids]], 1), (by, tapes, ids)

    # windows -> scores

    def _windows(self, tokens: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        counts = prefix_counts(lens)
        return [tokens[starts[:k] + t] for t, k in enumerate(counts)], [tokens[(starts + lens - 1)[:k] - t] for t, k in enumerate(counts)]

    def _projected(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors @ self.p[f"word_w{d}"] + self.p[f"word_b{d}"] for d in "fb"]

    def _pool(self, states: list[np.ndarray], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(attention, pooled, score); states are (step, window, unit) of both directions in reading order."""
        half = states[0].shape[2]
        a = states[0] @ self.p["attend"][:half] + states[1] @ self.p["attend"][half:]
        a = np.where(np.arange(len(a))[:, None] < lens[None, :], a, F32(-1e9))
        a = np.exp(a - (a.max(0) if len(a) else 0))
        a /= np.maximum(a.sum(0), F32(1e-9))
        pooled = np.concatenate([np.einsum("tb,tbu->bu", a, s) for s in states], 1)
        return a, pooled, _sigmoid(pooled @ self.p["out"] + self.p["bias"][0])

    @staticmethod
    def _turned(states: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The states of the backward direction in reading order."""
        at = (lens[None, :] - 1 - np.arange(len(states))[:, None]) % max(1, len(states))
        return states[at, np.arange(states.shape[1])[None, :]]

    def score_windows(self, projected: list[np.ndarray], tokens: np.ndarray, starts: np.ndarray, lens: np.ndarray, block: int = 1024) -> np.ndarray:
        out = np.empty(len(starts), F32)
        by = np.argsort(-lens, kind="stable")
        for k in range(0, len(by), block):
            some = by[k : k + block]
            index = self._windows(tokens, starts[some], lens[some])
            f, b = (GRU.states(x, self.p[f"word_u{d}"], at, len(some)) for x, d, at in zip(projected, "fb", index))
            if lens[some[0]] != lens[some[-1]]:
                b = self._turned(b, lens[some])
            else:
                b = b[::-1]
            out[some] = self._pool([f, b], lens[some])[2]
        return out

    def cut(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, words) of every window of texts with tokens offsets[k]:offsets[k + 1]; an empty text has one empty window."""
        lens = np.diff(offsets)
        step = self.window // 2
        count = np.where(lens > self.window, -(-(lens - self.window) // step) + 1, 1)
        text = np.repeat(np.arange(len(lens)), count)
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(lens, self.window)[text]
        return text, offsets[text] + np.minimum(place * step, lens[text] - size), size

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        tokens, offsets, words = tokens_of(texts)
        projected = self._projected(self.word_vectors(words)[0])
        text, start, size = self.cut(offsets)
        return np.maximum.reduceat(self.score_windows(projected, tokens, start, size), np.searchsorted(text, np.arange(len(texts)))) if len(texts) else np.zeros(0, F32)

    def score_blocks(self, words: list[str], tokens: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 200) -> np.ndarray:
        """The scores of all windows, block by block of texts, so that few word vectors exist at once."""
        out = np.empty(len(start), F32)
        for k in range(0, len(offsets) - 1, block):
            low, high = offsets[k], offsets[min(k + block, len(offsets) - 1)]
            own, local = np.unique(tokens[low:high], return_inverse=True)
            some = slice(*np.searchsorted(text, (k, k + block)))
            out[some] = self.score_windows(self._projected(self.word_vectors([words[i] for i in own.tolist()])[0]), local, start[some] - low, size[some])
        return out

    # training

    def gradients(self, words: list[str], tokens: np.ndarray, starts: np.ndarray, lens: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of windows, sorted by falling lens, and its gradients; tokens are positions in words."""
        p = self.p
        vectors, (by, char_tapes, ids) = self.word_vectors(words, keep=True)
        index = self._windows(tokens, starts, lens)
        projected = self._projected(vectors)
        n, units = len(starts), p["word_uf"].shape[0]
        tapes, states = [], []
        for x, d, at in zip(projected, "fb", index):
            _, tape = GRU.forward(x, p[f"word_u{d}"], at, n, True)
            s = np.zeros((len(at), n, units), F32)
            for t in range(len(at)):
                _, was, zr, _, c = tape[t]
                s[t, : len(was)] = c + zr[:, :units] * (was - c)
            tapes.append(tape)
            states.append(s if d == "f" else self._turned(s, lens))
        a, pooled, score = self._pool(states, lens)
        loss = float(-np.mean(np.where(target > 0, np.log(score + 1e-7), np.log(1 - score + 1e-7))))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dlogit = ((score - target) / n).astype(F32)
        g["out"], g["bias"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpooled = dlogit[:, None] * p["out"][None, :]
        both = np.concatenate(states, 2)
        da = np.einsum("tbu,bu->tb", both, dpooled)
        da = a * (da - (a * da).sum(0))
        g["attend"] = np.einsum("tb,tbu->u", da, both)
        dboth = a[:, :, None] * dpooled[None] + da[:, :, None] * p["attend"][None, None, :]
        dvectors = np.zeros_like(vectors)
        for k, d in enumerate("fb"):
            ds = dboth[:, :, k * units : (k + 1) * units]
            if d == "b":
                ds = self._turned(ds, lens)  # its own inverse on the positions that exist
            dx = np.zeros_like(projected[k])
            GRU.backward(tapes[k], p[f"word_u{d}"], np.zeros((n, units), F32), list(ds), dx, g[f"word_u{d}"])
            g[f"word_w{d}"], g[f"word_b{d}"] = vectors.T @ dx, dx.sum(0)
            dvectors += dx @ p[f"word_w{d}"].T
        size = p["char_uf"].shape[0]
        _add_rows(g["words"], ids, dvectors[:, 2 * size :])
        g["words"][0] = 0
        for k, d in enumerate("fb"):
            dtable = np.zeros((CHAR_ROWS, 3 * size), F32)
            GRU.backward(char_tapes[k], p[f"char_u{d}"], dvectors[by, k * size : (k + 1) * size], None, dtable, g[f"char_u{d}"])
            g[f"char_w{d}"], g[f"char_b{d}"] = p["chars"].T @ dtable, dtable.sum(0)
            g["chars"] += dtable @ p[f"char_w{d}"].T
        return loss, g


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(tokens, offsets, words): texts as positions in their distinct words."""
    split = words_of(texts)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    tokens, offsets = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    real = np.fromiter(map(bool, words), bool, len(words))[tokens] if len(words) else np.zeros(0, bool)
    if not real.all():
        upto = np.concatenate(([0], np.cumsum(real)))
        tokens, offsets = tokens[real], upto[offsets]
    return tokens, offsets, words


def word_odds(tokens: np.ndarray, offsets: np.ndarray, words: list[str], target: np.ndarray, order: int = 4, bits: int = 18, block: int = 200) -> np.ndarray:
    """For each word the greatest log odds, by texts of either class, of its character four-grams (hashed, word ends included).

    It only chooses the windows of the first rounds; no score is made of it.
    """
    if not words:
        return np.zeros(0)
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1)  # the line end after each word
    h = np.zeros(max(0, len(points) - order + 1), np.uint32)
    for k in range(order):
        h = (h ^ points[k : k + len(h)]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    bucket = (h >> np.uint32(32 - bits)).astype(np.int64)
    # a word's grams begin at the line end before it; a short word has one that runs on, which is harmless
    begins = ends - lens - 1
    count = np.maximum(lens + 2 - order + 1, 1)
    of = np.repeat(np.arange(len(words)), count)
    at = np.minimum(np.repeat(begins - np.cumsum(count) + count, count) + np.arange(count.sum()), len(bucket) - 1)
    grams, first = bucket[at], np.cumsum(count) - count
    seen = [np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)]
    for k in range(0, len(target), block):  # texts that hold a gram, a few texts at a time
        ends = offsets[k : k + block + 1]
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        pairs = np.unique(text * len(words) + tokens[ends[0] : ends[-1]])
        text, word = pairs // len(words), pairs % len(words)
        n = count[word]
        flat = np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        held = np.unique(np.repeat(text, n) << bits | grams[flat])
        toxic = target[k : k + block][held >> bits] == 1
        for y in (0, 1):
            seen[y] += np.bincount((held & ((1 << bits) - 1))[toxic == bool(y)], minlength=1 << bits)
    odds = np.log((seen[1] + 0.5) / ((target == 1).sum() + 1)) - np.log((seen[0] + 0.5) / ((target == 0).sum() + 1))
    return np.maximum.reduceat(odds[grams], first)


def fit(texts: list[str], toxic: list[int], *, window: int = 16, steps: int = 2000, least_rounds: int = 10, warm_up: int = 4, more_windows: int = 6, decay: float = 0.01, batch: int = 96, rate: float = 0.02, vocabulary: int = 100, seed: int = 1) -> Network:
    """A network from labelled texts, after least_rounds rounds or as many as give the steps."""
    rng = np.random.default_rng(seed)
    tokens, offsets, words = tokens_of(pa.array(texts, pa.string()))
    target = np.array(toxic)
    often = np.bincount(tokens, minlength=len(words)) if len(words) else np.zeros(0)
    known = sorted((k for k in range(len(words)) if often[k] >= 5 and words[k]), key=lambda k: (-often[k], words[k]))[:vocabulary]
    net = Network.new({words[k]: 1 + i for i, k in enumerate(known)}, window, rng)
    text, start, size = net.cut(offsets)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    odds = word_odds(tokens, offsets, words, target)
    prior = np.array([odds[tokens[a : a + n]].max() if n else -1e9 for a, n in zip(start.tolist(), size.tolist())])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, rounds = 0, max(least_rounds, -(-steps * batch // max(1, int(np.minimum(np.diff(first), more_windows).sum()))))
    for r in range(rounds):
        chance = rng.random(len(text))
        noise = prior if r < warm_up else net.score_blocks(words, tokens, offsets, text, start, size)
        if r % 2 == 0:  # clean texts: their worst windows in one round, any in the next
            noise = np.where(target[text] > 0, noise, chance)
        order = np.lexsort((-noise, text))
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text)) - first[text[order]]
        # the best window of each text; of clean ones some more, of toxic ones those that already look toxic
        best = rank < np.where(target[text] > 0, 2 if r < warm_up else 1, 1)
        more = (rank < more_windows) & np.where(target[text] > 0, (noise > 0.5) & (r >= warm_up), True)
        chosen = np.flatnonzero((best | more) & (size > 0))
        rng.shuffle(chosen)
        for k in range(0, len(chosen), batch):
            some = chosen[k : k + batch]
            some = some[np.argsort(-size[some], kind="stable")]
            places = np.repeat(start[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            own, local = np.unique(tokens[places], return_inverse=True)
            _, g = net.gradients([words[i] for i in own.tolist()], local, np.cumsum(size[some]) - size[some], size[some], target[text[some]].astype(F32))
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            lr = rate * (1 - 0.9 * (r * len(chosen) + k) / (rounds * len(chosen)))
            for key, x in g.items():
                x = x * F32(scale)
                m[key] = F32(0.9) * m[key] + F32(0.1) * x
                v[key] = F32(0.99) * v[key] + F32(0.01) * x * x
                net.p[key] *= F32(1 - lr * decay)
                net.p[key] -= F32(lr) * (m[key] / F32(1 - 0.9**step)) / (np.sqrt(v[key] / F32(1 - 0.99**step)) + F32(1e-6))
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def sample_labelled(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, train_docs: int, train_chars: int = 1 << 18) -> list[tuple[str, int]]:
    """(text, label) of at most train_docs rows of each class, those with the least hashes; texts of more than train_chars characters are not drawn."""
    known = labels.select(F.col(id_col).cast("long").alias("of"), F.col(label_col).cast("int").alias("label")).where(F.col("of").isNotNull() & F.col("label").isin(0, 1) & ~held_out("of")).distinct()
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(0)
    for label, n in counts.items():  # somewhat more than are taken, for not each has a text
        share = F.when(F.col("label") == label, min(1 << 30, int((1 << 30) * 1.25 * train_docs / n))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("of"), F.lit(1 << 30)) < share)  # about 2.5 train_docs rows: their bound is the parameter
    texts = docs.select(F.col(id_col).cast("long").alias("of"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= train_chars)
    rows = texts.join(F.broadcast(drawn), "of").withColumn("hash", F.xxhash64("of", "text"))
    out = []
    for label in (0, 1):  # each task keeps train_docs rows at most, whatever repeats an id
        mine = rows.where(F.col("label") == label).orderBy(F.pmod("hash", F.lit(1 << 30)), "hash").select("text").limit(train_docs).collect()
        out += [(t, label) for t in sorted(r.text for r in mine)]
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 2000, **how) -> Network | None:
    """A network, or None where a class has no labelled row."""
    rows = sample_labelled(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, train_docs=train_docs)
    if len({label for _, label in rows}) < 2:
        return None
    model = fit([t for t, _ in rows], [label for _, label in rows], **how)
    give_back()
    return model


def score(
    docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None, score_col: str = "score", chunk_bytes: int = 3 << 20
) -> DataFrame:
    """(doc_id, score): the score of every whole text; with keep, those columns and the score."""
    if keep is None:
        docs, keep = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["doc_id"]
        text_col = "text"
    keep = [c for c in keep if c != score_col]
    if net is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias(score_col))
    bounded_batches(docs.sparkSession, 4 << 20)
    kinds_of = dict(docs.dtypes)
    named = [*keep, *([] if text_col in keep else [text_col])]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(named)])  # mapInArrow takes no names with dots
    at = named.index(text_col)
    schema = ", ".join([*(f"`{c}` {kinds_of[c]}" for c in keep), f"`{score_col}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + chunk_bytes, "right")))
                some = batch.slice(start, stop - start)
                scores = pa.array(net.score_texts(some.column(at)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(len(keep))), scores], [*keep, score_col])
                start = stop
            give_back()

    return rows.mapInArrow(run, schema)
