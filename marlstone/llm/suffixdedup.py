"""Passages of a fixed number of bytes that repeat across documents, found by a column-wise Burrows-Wheeler construction.

A byte is removed if a string of `window` bytes covers it that also starts in a document with a smaller doc_id; every
string is judged on the input. Documents are UTF-8 bytes, strings never cross documents.

How it is done.
1. Documents are packed into blocks of about BLOCK_BYTES, written to the shared folder.
2. Every window has a key, the least hash of its 24-byte grams, so equal windows have equal keys wherever they stand. The
   distinct keys of each block meet by key; keys of one document only fall out. A key of many blocks is hot.
3. Runs of windows with one key that is not out become strings, each distinct one sent once a block, with the least
   doc_id that has it there. Hot keys are divided by the least hash of 40-byte grams.
4. A string that is the only one of its key, whatever the number of its copies, shares no window with another. The other strings of
   a bucket are collections of whole keys. A collection's Burrows-Wheeler transform and common prefixes are built by columns: each
   round inserts one more symbol of every string, from the last to the first, and updates both sequences (`column_bwt`). Rows
   with a common prefix of a whole window are one passage; the least doc_id among them judges the others.
5. One bit a window goes back to its block, which marks the bytes and cuts them out.

The transform and the prefixes of a collection are sequences that each round reads and writes once, in order. They are
held in memory and not in files, as a collection is bounded by COLLECTION symbols and executors have no shared scratch
folder that Python could write.

Defined results. A null text is empty. A null doc_id counts as 2**63 - 1: larger than the others and equal to other null ones.
Rows with equal doc_id do not judge each other. Empty tables give no rows. Each input row gives one row; other columns
are not looked at. A long text is one block, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, discard, give_back, materialize

WINDOW, GRAM, FINE_GRAM = 50, 24, 40
BLOCK_BYTES = 2 << 20
#: Text that a bucket stands for; of it only windows with a key of several documents are sent.
BUCKET_BYTES = 2 << 20
#: Symbols of a collection; a key with more is divided by longer grams, down to whole windows.
COLLECTION = 1 << 19
#: A key of this many blocks is hot.
HOT_BLOCKS = 64
#: Windows of a string at most, so that a collection takes few rounds.
RUN = 64
NO_ID = np.iinfo(np.int64).max
END = 0xFF  # no byte of UTF-8

_MULTIPLIER = 0x9E3779B97F4A7C15
_CHUNK = 1 << 16
_CODEC = pa.Codec("zstd", compression_level=3)


def _squeezed(raw: bytes) -> bytes:
    return _CODEC.compress(raw, asbytes=True)


def _unsqueezed(b: bytes, size: int) -> bytes:
    return _CODEC.decompress(b, decompressed_size=size, asbytes=True) if size else b""


def _packed(a: np.ndarray) -> bytes:
    """A compressed array, with bytes of equal weight side by side."""
    raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + _squeezed(raw)


def _unpacked(b: bytes, dtype: type) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    raw = np.frombuffer(_unsqueezed(b[8:], n * size), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def _mixed(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(29))


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram that starts at each byte, by doubling."""
    n, level, power, out, done = len(b) - gram + 1, b.astype(np.uint64) + np.uint64(1), _MULTIPLIER, None, 0
    size = 1
    while size <= gram:
        if gram & size:
            out = level[:n] if out is None else out * np.uint64(power) + level[done : done + n]
            done += size
        if 2 * size <= gram:
            level = level[:-size] * np.uint64(power) + level[size:]
            power = power * power % 2**64
        size *= 2
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return h if size == width else np.minimum(h[: len(h) - (width - size)], h[width - size :])


def window_keys(b: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The key of the window at each byte: a function of its bytes alone."""
    return _least(_gram_hashes(b, gram), window - gram + 1)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


def _cut(start: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in parts of at most `most`: the run of each part, its start and length."""
    parts = -(-n // most)
    run = np.repeat(np.arange(len(n)), parts)
    nth = _ranges(np.zeros(len(n), np.int64), parts)
    return run, start[run] + nth * most, np.minimum(most, n[run] - nth * most)


def key_runs(b: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, key) of the runs of windows with one key in each document that ends at one of ends."""
    starts, lengths, keys = [], [], []
    first = np.concatenate(([0], ends[:-1])).astype(np.int64)
    inner = np.unique(np.concatenate((first, np.maximum(first, ends - window + 1))))
    for at in range(0, len(b) - window + 1, _CHUNK):
        key = window_keys(b[at : at + _CHUNK + window - 1], window, gram)
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        lo, hi = np.searchsorted(inner, [at, at + len(key)])
        new[inner[lo:hi] - at] = True
        s = np.flatnonzero(new)
        n = np.diff(s, append=len(key))
        starts.append(s + at)
        lengths.append(n)
        keys.append(key[s])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start, n, key = np.concatenate(starts), np.concatenate(lengths), np.concatenate(keys)
    whole = start + window <= ends[np.searchsorted(ends, start, "right")]
    run, start, n = _cut(start[whole], n[whole], RUN)
    return start, n, _mixed(key[whole][run])


# --- the transform of a collection ---


def _least_between(table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of a row of values from low to high, from the table of least values of 1, 2, 4, ... neighbours."""
    level = np.frexp((high - low + 1).astype(np.float32))[1] - 1
    at = level.astype(np.int64) * table.shape[1]
    flat = table.reshape(-1)
    return np.minimum(flat.take(at + low), flat.take(at + high - (1 << level) + 1))


def column_bwt(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefixes up to most, rows) of the collection of strings data[starts : starts + lengths].

    Suffixes stand in the order of their symbols; equal ones in the order of their strings. The first len(starts) rows are the
    ends of the strings. A common prefix is that with the row before. rows gives for each row with a symbol that of the suffix one symbol longer.

    Round j inserts the suffixes of j symbols. `places` lists the rows by symbol, those of a symbol in
    order: the rank of a row in it tells where the suffix one symbol longer stands, and its neighbours of the same symbol are the rows before and after that one.
    """
    m = len(starts)
    if not m:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int32)
    total = m + int(lengths.sum())
    final = np.append(data, np.uint8(END))[np.where(lengths > 0, starts + lengths - 1, len(data))]
    bwt, lcp = final, np.zeros(m, np.uint8)
    places = np.argsort(bwt, kind="stable").astype(np.int32)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=256)))).astype(np.int32)
    string, rank, symbol = places, np.arange(m, dtype=np.int32), bwt[places]
    lengths, ends = lengths.astype(np.int32), (starts + lengths).astype(np.int32)
    table = np.empty((max(1, total.bit_length()), 0), np.uint8)
    for depth in range(1, int(lengths.max()) + 1):
        go = symbol != END
        string, rank, symbol = string[go], rank[go], symbol[go]
        n = len(bwt)
        place = places[rank]
        # the neighbours with the same symbol, and the common prefixes with them
        has_before, has_after = np.flatnonzero(rank > bounds[symbol]), np.flatnonzero(rank + 1 < bounds[symbol.astype(np.int32) + 1])
        first, low = places[rank[has_before] - 1] + 1, place[has_before]
        high, last = place[has_after] + 1, places[rank[has_after] + 1]
        widest = max(int((low - first).max(initial=0)), int((last - high).max(initial=0))) + 1
        if table.shape[1] < n:
            table = np.empty((table.shape[0], min(total, n + max(n // 2, 1024))), np.uint8)
        table[0, :n] = lcp
        for k in range(1, widest.bit_length()):
            half = 1 << (k - 1)
            np.minimum(table[k - 1, : n - half], table[k - 1, half:n], out=table[k, : n - half])
        prefix = np.zeros(len(string), np.uint8)
        prefix[has_before] = np.minimum(_least_between(table, first, low), most - 1) + 1
        following = np.minimum(_least_between(table, high, last), most - 1) + 1
        # insert the new rows
        new = rank + np.int32(m)
        old = np.ones(n + len(new), bool)
        old[new] = False
        was = np.flatnonzero(old).astype(np.int32)
        fresh = data[np.maximum(ends[string] - (depth + 1), 0)]
        fresh[lengths[string] == depth] = END
        grown, grown_lcp = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        grown[old], grown[new] = bwt, fresh
        grown_lcp[old], grown_lcp[new] = lcp, prefix
        grown_lcp[new[has_after] + 1] = following
        bwt, lcp = grown, grown_lcp
        places = was.take(places)
        order = np.argsort(fresh, kind="stable")
        string, symbol, new = string[order], fresh[order], new[order]
        counts = np.bincount(symbol, minlength=256)
        rank, at = np.empty(len(new), np.int32), 0
        for c in np.flatnonzero(counts).tolist():
            to = at + int(counts[c])
            rank[at:to] = np.searchsorted(places[bounds[c] : bounds[c + 1]], new[at:to]) + bounds[c]
            at = to
        rank += np.arange(len(new), dtype=np.int32)
        old[:] = True
        old[rank] = False
        merged = np.empty(len(old), np.int32)
        merged[old], merged[rank] = places, new
        places = merged
        bounds[1:] += np.cumsum(counts, dtype=np.int32)
    rows = np.empty(len(bwt), np.int32)
    rows[places] = np.arange(m, m + len(bwt), dtype=np.int32)
    return bwt, lcp, rows


def least_ids(strings: list[bytes], ids: np.ndarray, window: int) -> np.ndarray:
    """For each window of each string in turn: the least id of a string that contains the window."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"".join(strings), np.uint8)
    starts = np.cumsum(lengths) - lengths
    _, lcp, rows = column_bwt(data, starts, lengths, window)
    windows = np.maximum(lengths - window + 1, 0)
    offset = np.cumsum(windows) - windows
    at = np.zeros(int(windows.sum()), np.int64)
    row = np.arange(len(strings))
    string = np.arange(len(strings))
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        go = lengths[string] >= depth
        string, row = string[go], rows[row[go]]
        if depth >= window:
            at[offset[string] + lengths[string] - depth] = row
    of_row = np.full(len(lcp), NO_ID)
    of_row[at] = np.repeat(ids, windows)
    first = np.flatnonzero(lcp < window)
    least = np.minimum.reduceat(of_row, first) if len(first) else of_row
    return np.repeat(least, np.diff(first, append=len(lcp)))[at]


def _distinct(strings: list[bytes], ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct strings in order of appearance, the least id of each, and the place of every string among them."""
    seen: dict[bytes, int] = {}
    place = np.fromiter((seen.setdefault(s, len(seen)) for s in strings), np.int64, len(strings))
    least = np.full(len(seen), NO_ID)
    np.minimum.at(least, place, ids)
    return list(seen), least, place


def judge(strings: list[bytes], ids: np.ndarray, keys: np.ndarray, window: int, most: int, grams: tuple[int, ...]) -> np.ndarray:
    """least_ids by collections of about `most` symbols that hold all strings of a key; a key with more is divided by longer grams.

    The strings are distinct; one that has its key alone shares no window and keeps its id.
    """
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    windows = lengths - window + 1
    offset = np.cumsum(windows) - windows
    out = np.repeat(ids, windows)
    _, of, members_of = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(of, kind="stable")
    order = order[members_of[of[order]] > 1]
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    group: list[np.ndarray] = []
    size = 0

    def settle(members: np.ndarray) -> None:
        out[_ranges(offset[members], windows[members])] = least_ids([strings[i] for i in members], ids[members], window)

    for members in np.split(order, first[1:]) if len(order) else []:
        symbols = int(lengths[members].sum())
        if symbols > 4 * most and grams:
            parts, part_ids, part_keys, part_at = [], [], [], []
            for i in members:
                b = np.frombuffer(strings[i], np.uint8)
                s, n, k = key_runs(b, np.array([len(b)]), window, grams[0])
                parts += [strings[i][a : a + c + window - 1] for a, c in zip(s.tolist(), n.tolist())]
                part_ids.append(np.full(len(s), ids[i]))
                part_keys.append(k)
                part_at.append(_ranges(offset[i] + s, n))
            at = np.concatenate(part_at)
            parts, least, place = _distinct(parts, np.concatenate(part_ids))
            keys_of = np.empty(len(parts), np.uint64)
            keys_of[place] = np.concatenate(part_keys)
            n = np.fromiter(map(len, parts), np.int64, len(parts)) - window + 1
            result = judge(parts, least, keys_of, window, most, grams[1:])
            out[at] = result[_ranges((np.cumsum(n) - n)[place], n[place])]
            continue
        if size and size + symbols > most:
            settle(np.concatenate(group))
            group, size = [], 0
        group.append(members)
        size += symbols
    if group:
        settle(np.concatenate(group))
    return out


# --- the exchange between blocks and buckets ---


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, ends, size, data): documents packed into blocks, written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def packed() -> pa.RecordBatch:
            data = b"".join(texts)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            row = [[block], [_packed(np.array(ids, np.int64))], [_packed(ends)], [len(data)], [_squeezed(data)]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()))], names=["block", "ids", "ends", "size", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if texts and size + len(raw) > BLOCK_BYTES:
                    yield packed()
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(NO_ID if i is None else i)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield packed()
        give_back()

    bounded_batches(docs.sparkSession, 4 << 20)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return materialize(rows.mapInArrow(pack, "block long, ids binary, ends binary, size long, data binary"), "blocks")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    data = _unsqueezed(row["data"], row["size"])
    return _unpacked(row["ids"], np.int64), _unpacked(row["ends"], np.int64), data


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each key, rising with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of sorted buckets."""
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(buckets)]):
        yield int(buckets[a]), a, z


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(v), f.type) for v, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


_KEYED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])


def _shared_keys(blocks: DataFrame, buckets: int, window: int) -> DataFrame:
    """(block, flags): for each bucket, flags of the block's distinct keys in order: 0 in one document, 1 in several, 2 hot."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends, data = _read(row)
                start, _, key = key_runs(np.frombuffer(data, np.uint8), ends, window)
                owner = ids[np.searchsorted(ends, start, "right")]
                order = np.argsort(key)
                key, owner = key[order], owner[order]
                first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)) != 0)
                if not len(first):
                    continue
                several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
                key = (key[first] & ~np.uint64(1)) | several.astype(np.uint64)  # two keys that differ in the last bit count as one
                yield _batch([(b, row["block"], _packed(key[a:z])) for b, a, z in _by_bucket(_bucket(key, buckets))], _KEYED)
        give_back()

    def flags(table: pa.Table) -> pa.Table:
        bodies = [_unpacked(b, np.uint64) for b in table.column("body").to_pylist()]
        key = np.concatenate(bodies)
        found, of, blocks_of = np.unique(key >> np.uint64(1), return_inverse=True, return_counts=True)
        several = np.zeros(len(found), bool)
        several[of[(key & np.uint64(1)) > 0]] = True
        flag = np.where(blocks_of >= HOT_BLOCKS, 2, np.where(several | (blocks_of > 1), 1, 0)).astype(np.uint8)[of]
        ends = np.cumsum([len(b) for b in bodies])
        rows = [(i, j, _packed(flag[z - len(b) : z])) for i, j, b, z in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), bodies, ends)]
        give_back()
        return pa.Table.from_batches([_batch(rows, _KEYED)])

    schema = "bucket int, block long, body binary"
    found = blocks.mapInArrow(keys, schema).groupBy("bucket").applyInArrow(flags, schema)
    return found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "body"))).alias("flags"))


def _pieces(data: bytes, ends: np.ndarray, flags: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, key) of the runs whose key is in several documents, hot ones divided by longer grams."""
    b = np.frombuffer(data, np.uint8)
    start, n, key = key_runs(b, ends, window)
    _, of = np.unique(key, return_inverse=True)
    flag = flags[of]
    hot = flag == 2
    if not hot.any():
        kept = flag > 0
        return start[kept], n[kept], key[kept]
    at, run = _ranges(start[hot], n[hot]), np.repeat(np.arange(int(hot.sum())), n[hot])
    fine = np.empty(len(at), np.uint64)
    for a in range(0, len(b) - window + 1, _CHUNK):
        lo, hi = np.searchsorted(at, [a, a + _CHUNK])
        if lo < hi:
            fine[lo:hi] = window_keys(b[a : a + _CHUNK + window - 1], window, FINE_GRAM)[at[lo:hi] - a]
    first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (fine[1:] != fine[:-1]))))
    kept = flag == 1
    start = np.concatenate((start[kept], at[first]))
    n = np.concatenate((n[kept], np.diff(first, append=len(at))))
    return start, n, np.concatenate((key[kept], _mixed(key[hot][run[first]] + _mixed(fine[first]))))


def _strings(row: dict, buckets: int, window: int) -> tuple:
    """What a block sends and what it needs to read the answer, computed alike both times.

    (bytes, ids, ends, starts of pieces, windows of pieces, place of each among the distinct strings, these in order of buckets, their least id, keys, buckets).
    """
    ids, ends, data = _read(row)
    flags = np.concatenate([_unpacked(f["body"], np.uint8) for f in row["flags"] or []] or [np.zeros(0, np.uint8)])
    start, n, key = _pieces(data, ends, flags, window)
    found, least, place = _distinct([data[a : a + c + window - 1] for a, c in zip(start.tolist(), n.tolist())], ids[np.searchsorted(ends, start, "right")])
    keys = np.empty(len(found), np.uint64)
    keys[place] = key
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return data, ids, ends, start, n, rank[place], [found[i] for i in order], least[order], keys[order], bucket[order]


def _judged(blocks: DataFrame, buckets: int, window: int) -> DataFrame:
    """(block, bits): for each bucket, a bit for each window of the strings that the block sent: whether a smaller document than its own has it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                *_, found, least, keys, bucket = _strings(row, buckets, window)
                rows = []
                for b, a, z in _by_bucket(bucket):
                    lengths = np.fromiter(map(len, found[a:z]), np.uint16, z - a)
                    parts = [_packed(lengths), _packed(least[a:z]), _packed(keys[a:z].astype(np.uint32)), _squeezed(b"".join(found[a:z]))]
                    rows.append((b, row["block"], b"".join(len(p).to_bytes(4, "little") + p for p in parts)))
                yield _batch(rows, _KEYED)
        give_back()

    def answer(table: pa.Table) -> pa.Table:
        strings: list[bytes] = []
        ids, keys, sizes = [], [], []
        for body in table.column("body").to_pylist():
            parts, at = [], 0
            while at < len(body):
                size = int.from_bytes(body[at : at + 4], "little")
                parts.append(body[at + 4 : at + 4 + size])
                at += 4 + size
            lengths = _unpacked(parts[0], np.uint16).astype(np.int64)
            data = _unsqueezed(parts[3], int(lengths.sum()))
            ends = np.cumsum(lengths)
            strings += [data[z - c : z] for c, z in zip(lengths.tolist(), ends.tolist())]
            ids.append(_unpacked(parts[1], np.int64))
            keys.append(_unpacked(parts[2], np.uint32))
            sizes.append(len(lengths))
        own, key = np.concatenate(ids), np.concatenate(keys)
        found, least, place = _distinct(strings, own)
        del strings
        keys_of = np.empty(len(found), np.int64)
        keys_of[place] = key
        result = judge(found, least, keys_of, window, COLLECTION, (FINE_GRAM, window))
        windows = np.fromiter(map(len, found), np.int64, len(found)) - window + 1
        offset = np.cumsum(windows) - windows
        rows, at = [], 0
        for bucket, block, size in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), sizes):
            here = place[at : at + size]
            bits = result[_ranges(offset[here], windows[here])] < np.repeat(own[at : at + size], windows[here])
            rows.append((bucket, block, _packed(bits.astype(np.uint8))))
            at += size
        give_back()
        return pa.Table.from_batches([_batch(rows, _KEYED)])

    schema = "bucket int, block long, body binary"
    found = blocks.mapInArrow(send, schema).groupBy("bucket").applyInArrow(answer, schema)
    return found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "body"))).alias("bits"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def _cut_out(blocks: DataFrame, buckets: int, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, ids, ends, start, n, place, found, least, *_ = _strings(row, buckets, window)
                windows = np.fromiter(map(len, found), np.int64, len(found)) - window + 1
                offset = np.cumsum(windows) - windows
                bits = np.concatenate([_unpacked(x["body"], np.uint8) for x in row["bits"] or []] or [np.zeros(0, np.uint8)])
                later = np.repeat(ids[np.searchsorted(ends, start, "right")] > least[place], n)
                gone = np.zeros(len(data) + 1, np.int8)
                gone[_ranges(start, n)] = bits[_ranges(offset[place], n)] | later
                # a byte goes if one of the windows that start at it or up to window - 1 before it goes
                gone = np.cumsum(gone, dtype=np.int32)
                gone[window:] -= gone[:-window].copy()
                gone = gone[: len(data)] > 0
                first = np.concatenate(([0], ends[:-1])).astype(np.int64)
                opens, closes = gone.copy(), gone.copy()
                opens[1:] &= ~gone[:-1]
                closes[:-1] &= ~gone[1:]
                some = ends > first
                opens[first[some]] = gone[first[some]]
                closes[ends[some] - 1] = gone[ends[some] - 1]
                begin, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
                of = np.searchsorted(ends, begin, "right")
                kept = np.cumsum(~gone)
                total = lambda at: np.where(at > 0, kept[np.maximum(at, 1) - 1] if len(kept) else 0, 0)
                kept_to = np.concatenate(([0], total(ends)))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(ids) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(begin - first[of]), pa.array(stop - first[of])], names=["start", "stop"]))
                body = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(kept_to.astype(np.int32)), pa.py_buffer(np.frombuffer(data, np.uint8)[~gone].tobytes())])
                yield pa.record_batch([pa.array(ids, mask=ids == NO_ID), pa.array(ends - first), spans, body], schema=_OUT)
        give_back()

    return blocks.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row: its bytes without those that a smaller document has in a string of `window` bytes.

    spans are the maximal removed runs, first byte and end; window is more than FINE_GRAM, 40.
    """
    if window <= FINE_GRAM:
        raise ValueError(f"window must be more than {FINE_GRAM} bytes")
    blocks = _blocks(docs, id_col, text_col)
    buckets = 1 + (blocks.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES
    flagged = materialize(_shared_keys(blocks, buckets, window), "keys")
    known = blocks.join(flagged, "block", "left")
    judged = materialize(_judged(known, buckets, window), "bits")
    out = _cut_out(known.join(judged, "block", "left"), buckets, window)
    out.made_of = (blocks, flagged, judged)
    return out


def release(out: DataFrame) -> None:
    """Delete the written tables behind a result of remove_repeats that is no longer read."""
    discard(*getattr(out, "made_of", ()))
