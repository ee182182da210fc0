"""BPE encoding by a distinct-word table, and decoding by joining ids to pieces.

A word is a run of characters between white space.  The tokenizers that this
operator serves never let a token cross white space and drop it, so a text's ids
are the ids of its words in order.

Encoding.
1. The scan splits texts into words and cuts its rows into chunks of about
   `chunk_bytes`; a chunk has a dictionary of its distinct words, dealt by hash over
   `word_parts` parts (as many as the scan has partitions, within bounds).
2. The parts of all chunks are shuffled by part number: each distinct word of the
   corpus arrives at one task, which encodes it once with the tokenizer.
3. The ids go back to the chunks.  A second pass over the same scan has written each
   chunk as positions in its dictionary, so ids join to words by position.
Only dictionaries, ids and positions are shuffled, never texts or single words;
a frequent word costs one entry in a chunk, so no key is hot.

The input must give the same rows in the same order on both passes, as a scan of
files or tables does; any other plan (one with a shuffle or Python) is first written
to the shared folder.  A checksum of every dictionary is compared, and a mismatch fails.

Decoding joins ids to the vocabulary's pieces (id, piece), a table of fixed size
that is sent to every task, and joins a text's pieces as the tokenizer does.

Defined results.  Null, empty and blank texts have no ids and decode to the empty
string; a null ids array decodes as an empty one.  Repeated rows and null doc_ids
are kept.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, give_back, materialize

CHUNK_BYTES = 8 << 20
LEAST_PARTS, MOST_PARTS = 128, 4096
CACHED_WORDS = 1_000_000
DOCS_AT_ONCE = 200
#: White space of the Unicode property that tokenizers use; str.split() also splits at these four, which are no white space there.
NOT_SPACE = "[\x1c-\x1f]"
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

_loaded: dict[int, object] = {}


def _tokenizer(source: str):
    """The tokenizer of a worker process, read once."""
    key = zlib.crc32(source.encode())
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _loaded[key] = Tokenizer.from_str(source)
        _loaded[key].no_truncation()
        _loaded[key].no_padding()
    return _loaded[key]


def _check_supported(source: str) -> None:
    """Refuse tokenizers whose tokens may depend on what stands beyond white space."""
    spec = json.loads(source)
    if spec["decoder"] is not None or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("this operator serves tokenizers without a decoder and without space-absorbing added tokens")
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
    if not any(s and s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in steps):
        raise ValueError("this operator serves tokenizers that drop white space")


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text; empty strings among them stand for no word."""
    texts = pc.fill_null(texts, "")
    if not pc.any(pc.match_substring_regex(texts, NOT_SPACE)).as_py():
        return pc.utf8_split_whitespace(texts)
    return pa.array([SPACE.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """(name, doc_ids, words of each doc, positions in the dictionary, dictionary) of each chunk, in the order of the scan."""
    count = 0
    for batch in batches:
        partition = batch.column(2)[0].as_py() if batch.num_rows else 0
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chunk_bytes, "right")))
            words = split_words(batch.column(1).slice(start, stop - start))
            coded = words.flatten().dictionary_encode()
            yield f"{partition}-{count}", batch.column(0).slice(start, stop - start), np.diff(words.offsets.to_numpy()), coded.indices.to_numpy(), coded.dictionary
            del words, coded
            give_back()
            count, start = count + 1, stop


def _by_part(dictionary: pa.Array, parts: int) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """The dictionary's words, their order by part, the bounds of the parts in it, and a checksum."""
    words = dictionary.to_pylist()
    sums = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
    part = sums % parts
    order = np.argsort(part, kind="stable")
    return words, order, np.searchsorted(part[order], np.arange(parts + 1)), int((sums * (np.arange(len(sums)) % 65521 + 1)).sum())


def _pack(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.astype("<i4").tobytes() for a in arrays), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), "<i4")


ROW = "chunk string, part int, checksum long, n int, doc_ids array<bigint>, blob binary"
_ROW = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("checksum", pa.int64()), ("n", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)


def gather(lists: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """lists[starts[k] : starts[k] + lens[k]] for every k of which, one after another."""
    n = lens[which]
    ends = np.cumsum(n)
    return lists[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _stable(docs: DataFrame) -> DataFrame:
    plan = docs._jdf.queryExecution().sparkPlan().toString()
    return materialize(docs, "bpe-docs") if re.search("Exchange|Arrow|Pandas|Python|Join|Aggregate|Window", plan) else docs


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, word_parts: int | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, without special tokens added."""
    source = open(tokenizer_path, encoding="utf-8").read()  # of the driver; its content goes along with the tasks
    _check_supported(source)
    bounded_batches(docs.sparkSession)
    texts = _stable(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    word_parts = word_parts or min(MOST_PARTS, max(LEAST_PARTS, texts.rdd.getNumPartitions()))  # a part is the work of a task
    texts = texts.withColumn("partition", F.spark_partition_id())  # of the scan, whatever the stage it runs in

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, _, dictionary in _chunks(batches, chunk_bytes):
            words, order, bounds, checksum = _by_part(dictionary, word_parts)
            yield _rows(
                [
                    (name, p, checksum, len(some := [words[k] for k in order[bounds[p] : bounds[p + 1]].tolist()]), None, pa.compress("\n".join(some).encode(), codec="zstd", asbytes=True) + len("\n".join(some).encode()).to_bytes(4, "little"))
                    for p in range(word_parts)
                    if bounds[p] < bounds[p + 1]
                ]
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(source)
        known: dict[str, bytes] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(k, 64).to_pylist():
                    blob = r["blob"]
                    words = pa.decompress(blob[:-4], int.from_bytes(blob[-4:], "little"), codec="zstd", asbytes=True).decode().split("\n")
                    fresh = [w for w in words if w not in known]
                    if len(known) + len(fresh) > CACHED_WORDS:
                        known.clear()
                        fresh = words
                    for at in range(0, len(fresh), 1024):
                        some = fresh[at : at + 1024]
                        known.update(zip(some, (array("i", e.ids).tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False))))
                    ids = [known[w] for w in words]
                    lens = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
                    flat = np.frombuffer(b"".join(ids), np.int32)
                    out.append((r["chunk"], r["part"], r["checksum"], len(ids), [len(flat)], _pack(lens, flat)))
                yield _rows(out)
        known.clear()
        give_back()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, doc_ids, counts, at, dictionary in _chunks(batches, chunk_bytes):
            _, order, _, checksum = _by_part(dictionary, word_parts)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            yield _rows([(name, -1, checksum, len(counts), doc_ids.to_pylist(), _pack(counts, rank[at]) + len(at).to_bytes(4, "little"))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(chunk: dict, parts: list[dict]) -> Iterator[pa.RecordBatch]:
            if any(p["checksum"] != chunk["checksum"] for p in parts):
                raise RuntimeError("the two passes over the documents differ; write them to a table first")
            lens, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for p in parts:
                both = _unpack(p["blob"], p["n"] + p["doc_ids"][0])
                lens.append(both[: p["n"]])
                flat.append(both[p["n"] :])
            lens, flat = np.concatenate(lens).astype(np.int64), np.concatenate(flat)
            words = int.from_bytes(chunk["blob"][-4:], "little")
            both = _unpack(chunk["blob"][:-4], chunk["n"] + words)
            counts, at = both[: chunk["n"]], both[chunk["n"] :]
            first = np.cumsum(lens) - lens
            ends = np.concatenate(([0], np.cumsum(counts)))
            for k in range(0, len(counts), DOCS_AT_ONCE):
                bounds = ends[k : k + DOCS_AT_ONCE + 1]
                some = at[bounds[0] : bounds[-1]]
                ids = gather(flat, first, lens, some)
                offsets = np.concatenate(([0], np.cumsum(lens[some])))[bounds - bounds[0]].astype(np.int32)
                doc_ids = pa.array(chunk["doc_ids"][k : k + DOCS_AT_ONCE], pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], ["doc_id", "ids"])
            give_back()

        chunk, parts = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                if r["part"] < 0:
                    if chunk:
                        yield from done(chunk, parts)
                    chunk, parts = r, []
                else:
                    parts.append(r)
        if chunk:
            yield from done(chunk, parts)

    asked = texts.mapInArrow(ask, ROW).repartition("part")
    answered = asked.mapInArrow(answer, ROW)
    chunks = answered.unionByName(texts.mapInArrow(place, ROW)).repartition("chunk").sortWithinPartitions("chunk", "part")
    return chunks.mapInArrow(join, "doc_id long, ids array<int>")


def vocabulary(tokenizer_path: str) -> list[str]:
    """The piece of each id; an id without one has the empty string."""
    spec = json.loads(open(tokenizer_path, encoding="utf-8").read())
    pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [pieces.get(i, "") for i in range(max(pieces) + 1)]


def decode(encoded: DataFrame, tokenizer_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with one more column: the decoded text, special tokens kept."""
    pieces = vocabulary(tokenizer_path)  # 49,408 rows for the tokenizer in use: the vocabulary's size, whatever the corpus
    kept = [f for f in encoded.schema.fields if f.name != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out_col}` string"
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces, pa.string())
        for batch in batches:
            ids = batch.column(names.index(ids_col))
            lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            step, start = 1 << 20, 0
            ends = np.cumsum(lens)
            while start < len(ids):  # few enough pieces at once that their text stays small
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + step, "right")))
                joined = table.take(ids.slice(start, stop - start).flatten())
                offsets = np.concatenate(([0], np.cumsum(lens[start:stop]))).astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), joined), " ")
                some = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in range(len(names))), texts], [*names, out_col])
                start = stop

    return encoded.select(*names).mapInArrow(run, schema)
