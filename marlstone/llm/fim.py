"""Fill-in-the-middle: texts cut at token ranks into prefix, middle and suffix, and put together again in another order.

Tokens are runs of A-Z and a-z, and every other code point by itself. A token starts where a code point starts, unless both
it and the one before are letters: a predicate of two neighbours.

The texts of an Arrow batch are one row of bytes, decomposed into chunks of CHUNK bytes that overlap by the byte before
them. Every chunk is asked by itself how many tokens and how many code points start in it; the sums of the chunks before
it, less those at the start of its text, route each cut's rank to the chunk that owns it. Only the owning chunks are scanned again, for
the byte of that rank. Spark divides the documents over the tasks; nothing is shuffled.

Defined results. A null text is empty. A null doc_id hashes as `1:` alone. Empty texts, and texts with a
marker, stay plain. Repeated rows give equal results. Other columns are not looked at. A
text may have any length that Spark's strings allow; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, give_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: texts that are rearranged, and those of them that begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
CHUNK = 1 << 12


def cut_draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the SHA-256 of `1:` and the decimal doc_id."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def _chunk_starts(ends: np.ndarray, size: int) -> np.ndarray:
    """The first bytes of chunks of at most `size` bytes, anew at each text."""
    first = np.concatenate(([0], ends))[: len(ends)]
    n = -(-(ends - first) // size)
    return np.repeat(first, n) + size * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))


def _token_starts(data: np.ndarray, low: int, high: int, opens: np.ndarray) -> np.ndarray:
    """Whether a token starts at each byte from low to high; reads the byte before low too. opens: first bytes of texts."""
    b = data[max(low - 1, 0) : high]
    letter = ((b | 0x20) >= 0x61) & ((b | 0x20) <= 0x7A) & (b < 0x80)
    starts = (b & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts = starts[low - max(low - 1, 0) :]
    a, z = np.searchsorted(opens, [low, high])
    starts[opens[a:z] - low] = True
    return starts


def _counts(data: np.ndarray, ends: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes of the chunks, tokens before each and in all, code points before each and in all)."""
    at = _chunk_starts(ends, chunk)
    if not len(at):
        return at, np.zeros(1, np.int64), np.zeros(1, np.int64)
    opens = np.unique(np.concatenate(([0], ends[:-1])))
    tokens, points = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    step = max(1, (1 << 20) // chunk)  # chunks are independent; a stretch of them is counted at once
    for i in range(0, len(at), step):
        low, high = int(at[i]), int(at[i + step]) if i + step < len(at) else len(data)
        own = at[i : i + step] - low
        tokens[i : i + step] = np.add.reduceat(_token_starts(data, low, high, opens), own, dtype=np.int64)
        points[i : i + step] = np.add.reduceat((data[low:high] & 0xC0) != 0x80, own, dtype=np.int64)
    before = lambda n: np.concatenate(([0], np.cumsum(n)))
    return at, before(tokens), before(points)


def cuts(data: np.ndarray, ends: np.ndarray, draws: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of tokens, byte of the two cuts from the text's start, code points before the two cuts) of each text.

    draws has two numbers for each text; the ranks of its cuts are their remainders by the number of tokens plus 1, in order.
    """
    first = np.concatenate(([0], ends))[: len(ends)].astype(np.int64)
    at, tokens, points = _counts(data, ends, chunk)
    chunk_of = np.searchsorted(at, np.concatenate((first, ends)), "left")  # of an empty text: its place between chunks
    own, past = chunk_of[: len(ends)], chunk_of[len(ends) :]
    n = tokens[past] - tokens[own]
    rank = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    where, before = np.empty_like(rank), np.empty_like(rank)
    opens = np.unique(first)
    for c in range(2):
        last = rank[:, c] == n
        where[last, c], before[last, c] = (ends - first)[last], (points[past] - points[own])[last]
        inner = np.flatnonzero(~last)
        owner = np.searchsorted(tokens, tokens[own[inner]] + rank[inner, c], "right") - 1
        for i, k in zip(inner.tolist(), owner.tolist()):
            low, high = int(at[k]), int(at[k + 1]) if k + 1 < len(at) else len(data)
            byte = np.flatnonzero(_token_starts(data, low, high, opens))[tokens[own[i]] + rank[i, c] - tokens[k]]
            where[i, c] = low + byte - first[i]
            before[i, c] = points[k] - points[own[i]] + int(((data[low : low + byte] & 0xC0) != 0x80).sum())
    return n, where, before


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, form, prefix_chars, middle_chars, output): each text in its form.

    form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); the two numbers of code points are null for plain texts.
    """
    names = ["doc_id", "n_tokens", "form", "prefix_chars", "middle_chars", "output"]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            draws = np.array([cut_draws(i) for i in batch.column(0).to_pylist()], np.int64).reshape(-1, 4)
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            n, where, before = cuts(data, ends, draws)
            forms, prefix, middle, output = [], [], [], []
            for text, draw, (a, z), (c, d) in zip(texts, draws.tolist(), where.tolist(), before.tolist()):
                if not text or p in text or s in text or m in text or draw[2] % 100 >= REARRANGED:
                    row = ("plain", None, None, text)
                elif draw[3] % 100 < SUFFIX_FIRST:
                    row = ("spm", c, d - c, b"".join((s, text[z:], p, text[:a], m, text[a:z])))
                else:
                    row = ("psm", c, d - c, b"".join((p, text[:a], s, text[z:], m, text[a:z])))
                for to, value in zip((forms, prefix, middle, output), row):
                    to.append(value)
            columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.record_batch([batch.column(0), *columns], names=names)
        give_back()

    bounded_batches(docs.sparkSession, 4 << 20)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that `rearrange` put into this output and form. Rearranged texts hold no markers, so those in the output are its own."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fim_sql() -> str:
    """DuckDB SQL of the rows of query op12_fim: tokens are listed, not counted by chunks."""
    return """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, len(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]')) AS n,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn
), parts AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS s FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
