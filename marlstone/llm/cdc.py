"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes; with 16-bit sums it depends on the
last 16 bytes only.  A chunk ends where the hash's top bits are zero: six bits
before the normal size, four after it (normalised chunking), never before `LEAST`
nor beyond `MOST` bytes.  Boundaries follow content, so chunks after an insertion or
a deletion are found again.  A fingerprint is the set of (digest, length) of a
text's chunks; containment is the length of the chunks shared with another text's
fingerprint over the length of its own chunks.

As no chunk is shorter than the hash reaches back, a text that begins like another
has its chunks up to the first difference: an edited text is chunked from the last
common boundary.

`compare_with_next` deals the rows to buckets of neighbouring ids by sampled quantiles,
an id with many rows to several by the hash of the text, at most
`MOST_BUCKETS` of them whatever the size, and streams through each in order, keeping one row
in memory.  The first row of a bucket also goes to the bucket before it; only these
ids reach the driver.  A text is shuffled once.

Defined results.  A null text is empty; the empty text's fingerprint is the empty
set, contained in the empty set with 1 and in any other with 0.  Rows that repeat a
doc_id follow each other by a hash of their texts; null doc_ids come last.  A
single row is its own next.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, text_or_empty

LEAST, NORMAL, MOST = 16, 32, 128
HARD, EASY = 0xFC00, 0xF000
BUCKET_ROWS, MOST_BUCKETS = 2000, 100_000


def _gear() -> np.ndarray:
    """256 numbers by the SplitMix64 rule, seeded with 1."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(48)).astype(np.uint16)


with np.errstate(over="ignore"):
    GEAR = _gear()


def gear_hashes(data: bytes) -> np.ndarray:
    """The hash after each byte: the sum of GEAR[byte k back] << k."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 bytes
        h[k:] += h[:-k] << np.uint16(k)
    return h


def chunk_ends(data: bytes, start: int = 0) -> list[int]:
    """Where the chunks from start on end."""
    n = len(data)
    if n - start <= LEAST:
        return [n] if n > start else []
    h = gear_hashes(data[start:] if start else data)
    easy = np.flatnonzero(h & np.uint16(EASY) == 0)
    hard = easy[h[easy] & np.uint16(HARD) == 0]
    easy, hard = (easy + (1 + start)).tolist(), (hard + (1 + start)).tolist()
    ends, at, i, j, ni, nj = [], start, 0, 0, len(hard), len(easy)
    while n - at > LEAST:
        least = at + LEAST
        normal = at + NORMAL
        i = bisect_left(hard, least, i)
        if i < ni and hard[i] < normal:
            at = hard[i]
        else:
            j = bisect_left(easy, normal, j)
            at = min(easy[j] if j < nj else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def digests(data: bytes, ends: list[int], start: int = 0) -> list[int]:
    """40 bits of digest and 8 of length for each chunk."""
    from xxhash import xxh3_64_intdigest

    out = []
    for end in ends:
        out.append(xxh3_64_intdigest(data[start:end]) >> 24 << 8 | (end - start))
        start = end
    return out


def fingerprint(chunks: list[int]) -> np.ndarray:
    return np.unique(np.array(chunks, np.uint64))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's chunk lengths whose chunks are in b."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    if not len(b):
        return 0.0
    weight = (a & np.uint64(255)).astype(np.int64)
    found = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
    return float(weight[found].sum() / weight.sum())


def encoded(print_: np.ndarray) -> str:
    """A fingerprint as text: base64 of six bytes for each chunk."""
    return base64.b64encode(print_.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([raw, np.zeros((len(raw), 2), np.uint8)], 1).copy().view("<u8").ravel()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py().encode() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoded(fingerprint(digests(d, chunk_ends(d)))) for d in texts], pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def edit(text: str, following: str) -> str:
    """text, its last third replaced by the beginning of the following one."""
    n = len(text)
    return text[: n - n // 3] + following[: n // 3]


def _bucket(cuts: list[int], null_buckets: int):
    """A function of (doc_id or 0, whether it is null, hash) that gives the bucket, buckets following each other by falling id, null last, then rising hash.

    cuts are quantiles of the ids; an id that several of them hit has as many buckets, by hash.
    """
    uppers, parts = [], []
    for value, times in zip(*np.unique(np.array(cuts, np.int64), return_counts=True)):
        if times > 1 and value > np.iinfo(np.int64).min:
            uppers.append(value - 1)
            parts.append(1)
        uppers.append(value)
        parts.append(times)
    parts = np.array([*parts, 1], np.uint64)
    first = (np.cumsum(parts[::-1])[::-1] - parts).astype(np.int64)
    uppers, known = np.array(uppers, np.int64), int(parts.sum())

    @F.pandas_udf("int")
    def place(ids: pd.Series, nulls: pd.Series, hashes: pd.Series) -> pd.Series:
        null = nulls.to_numpy(bool)
        at = np.searchsorted(uppers, ids.to_numpy(np.int64), "left")
        n = np.where(null, np.uint64(max(1, null_buckets)), parts[at])
        rank = (hashes.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return pd.Series(np.where(null, known, first[at]) + (rank * n >> np.uint64(32)).astype(np.int64))

    return place


def _with_neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, guest, doc_id, text), dealt by bucket and sorted by falling id; a bucket ends with the first row of the next as guest."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    seen = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    buckets = min(MOST_BUCKETS, -(-max(1, seen.known) // BUCKET_ROWS))
    cuts = []
    if buckets > 1:  # the sample decides how even the buckets are, and no result
        some = rows.where(F.col("doc_id").isNotNull() & (F.rand(1) < min(1.0, 50 * buckets / seen.known)))
        cuts = some.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 20 * buckets)).first()[0] or []
    rows = rows.withColumn("bucket", _bucket(cuts, min(MOST_BUCKETS, -(-(seen.n - seen.known) // BUCKET_ROWS)))(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "hash"))
    # the first of a bucket: greatest id, null last, then least hash
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("hash").cast("decimal(20,0)")).alias("hash"))).alias("head")).collect()
    heads.sort(key=lambda r: r.bucket)
    spark = docs.sparkSession
    named = [(r.head.doc_id, int(-r.head.hash), heads[k - 1].bucket) for k, r in enumerate(heads)]
    guests = spark.createDataFrame(named, "head_id long, head_hash long, target int")
    joined = rows.join(F.broadcast(guests), rows.doc_id.eqNullSafe(guests.head_id) & (rows.hash == guests.head_hash), "left")
    places = F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("target").alias("bucket"), F.lit(True).alias("guest")))
    dealt = joined.select(F.explode(F.filter(places, lambda p: p["bucket"].isNotNull())).alias("p"), "doc_id", "text", "hash").select("p.bucket", "p.guest", "doc_id", "text", "hash")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "hash").drop("hash")


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next row is that with the next smaller doc_id, after the last one the first; the edited text is edit(text, next).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(own: tuple, following: tuple) -> tuple:
            doc_id, text, data, ends, chunks, print_ = own
            changed = edit(text, following[1])
            kept = len(text[: len(text) - len(text) // 3].encode())
            if changed == text:
                new = print_
            else:
                changed_data = changed.encode()
                same = bisect_left(ends, kept)  # the chunks that end before the edit
                start = ends[same - 1] if same else 0
                new = fingerprint(chunks[:same] + digests(changed_data, chunk_ends(changed_data, start), start))
            return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), encoded(print_), encoded(new), containment(print_, new), containment(print_, following[5])

        def read(doc_id: int | None, text: str) -> tuple:
            data = text.encode()
            ends = chunk_ends(data)
            chunks = digests(data, ends)
            return doc_id, text, data, ends, chunks, fingerprint(chunks)

        before, waiting = None, False
        for batch in batches:
            out = []
            for guest, doc_id, text in zip(*(batch.column(k) for k in (1, 2, 3))):
                guest = guest.as_py()
                if guest and not waiting:
                    continue  # a copy of a guest that has been seen
                now = read(doc_id.as_py(), text.as_py())
                if waiting:
                    out.append(row(before, now))
                before, waiting = now, not guest
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)] if out else [pa.array([], t) for t in _TYPES], _NAMES)

    return _with_neighbours(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(_NAMES, ("long", "long", "string", "string", "string", "double", "double"))))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
