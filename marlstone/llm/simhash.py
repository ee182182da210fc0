"""SimHash near-duplicate groups, searched with BK-trees.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles.  Two fingerprints link when they differ in at most `radius` bits, and
the groups are the connected components of those links.

Search.  Equal fingerprints are merged first.  The 64 bits are cut into
`blocks` blocks; two fingerprints within the radius agree on at least
`blocks - radius` of them, so every link falls into a bucket keyed by the values
of that many blocks (all choices of blocks are taken: nothing is lost).  A key
takes only so many bits of them that an evenly spread bucket holds about 512 fingerprints.  In
each bucket a BK-tree is grown, its children keyed by the integer Hamming
distance to the parent, and only edges within the radius are followed.  A bucket
above `shard_rows` is cut into shards, and each shard's tree is sent to every
shard of its bucket, so no task meets an unbounded bucket.  The trees travel by
shuffle and not by a cluster-wide broadcast: their sum grows with the corpus and
has no proven bound.

Wider fingerprints.  With `lanes` above 1 a fingerprint has 64 bits for each lane,
all from the same shingle hashes, which estimates the similarity of two texts' shingle
sets: of w bits, about w * acos(2J / (1 + J)) / pi differ at similarity J.  For so
wide a radius no choice of blocks is selective; buckets are then keyed by `bands`
fixed samples of `band_bits` bits each, which find a pair with bit difference share p
with probability 1 - (1 - (1 - p)**band_bits)**bands.

Verified groups.  `similar_groups` takes such wide fingerprints, of distinct shingles, as
candidates only: a link stays where the exact Jaccard similarity of the two shingle sets
reaches `similarity`, and the groups are the components of those links.  Texts with equal
shingle sets are one node.  The sets of the nodes of a candidate component meet in one task;
a component of more than `shard_bytes` is cut into shards that meet in pairs, so the reads of a
component grow with its square over the shard.

A subtree whose members all lie in the query's component is not entered, a tree is
asked with 1, 2, 4, ... fingerprints at once so that the first of a group merge it, and a
bucket returns a star of its components, not all pairs; a group of n near copies
thus costs about n links instead of n squared.  Classes that hold a large share of all
rows get their answer by a broadcast of at most 4,096 of them.

Defined results.  Null, empty and blank texts have fingerprint zero and are
linked as any other.  Rows that repeat a doc_id stay as they are.  A null doc_id
is never a component_id unless all ids of a component are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, discard, fresh, give_back, join_classes, materialize

BITS = 64
SEED = 42
#: The links that a search of one bucket holds at once, at most.
HELD_LINKS = 1 << 21
#: Fingerprints of a bucket, where they are evenly spread.
BUCKET_ROWS = 512


def _mixed(x: np.ndarray, lane: int) -> np.ndarray:
    """The hashes of a further lane, by the SplitMix64 finaliser."""
    x = x + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z and splits at \x20 \x09-\x0D only
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle_words + 1].tolist()
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")


def fingerprint_of(text: str | None, shingle_words: int, lanes: int = 1) -> np.ndarray:
    """The fingerprint of one text: an unsigned 64-bit number for each lane."""
    return majority(shingle_hashes(text, shingle_words), lanes)


def majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The bitwise majority of hashes, a number for each lane."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        ones = np.zeros(BITS, np.int64)
        for k in range(0, len(hashes), 65536):
            part = hashes[k : k + 65536]
            part = _mixed(part, lane) if lane else part
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
        out[lane] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _column(fps: np.ndarray) -> pa.Array:
    """Fingerprints (row x lane) as a column: numbers for one lane, bytes for more."""
    if fps.shape[1] == 1:
        return pa.array(np.ascontiguousarray(fps[:, 0]).view(np.int64))
    return pa.array([r.tobytes() for r in fps.astype("<u8")], pa.binary())


def _array(column: pa.Array, lanes: int) -> np.ndarray:
    if lanes == 1:
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, lanes)


def _type(lanes: int) -> str:
    return "long" if lanes == 1 else "binary"


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, a signed 64-bit integer or the bytes of several."""
    bounded_batches(docs.sparkSession, 4 << 20)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint_of(t.as_py(), shingle_words, lanes) for t in batch.column(1)], np.uint64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), _column(out)], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id long, fp {_type(lanes)}")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis is of lanes."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


class BKTree:
    """A BK-tree over fingerprints, kept in preorder so that a subtree is a range of positions."""

    #: Fingerprints of a leaf; edges within the wide radius of several lanes leave out little of a small set.
    LEAF, WIDE_LEAF = 32, 256

    def __init__(self, fps: np.ndarray):
        self.leaf = self.LEAF if fps.shape[1:] == (1,) else self.WIDE_LEAF
        self.nodes: list[tuple[int, int, list[tuple[int, int]]]] = []  # start, stop, [(distance, child)]
        order: list[np.ndarray] = []
        self._grow(fps, np.arange(len(fps)), order)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.fps = fps[self.order]
        self.starts, self.stops = (np.array([n[k] for n in self.nodes], np.int64) for k in (0, 1))

    def _grow(self, fps: np.ndarray, members: np.ndarray, order: list[np.ndarray], start: int = 0) -> None:
        pending = [(members, start, None)]
        while pending:
            members, start, link = pending.pop()
            here = len(self.nodes)
            if link is not None:
                self.nodes[link[0]][2].append((link[1], here))
            children: list[tuple[int, int]] = []
            self.nodes.append((start, start + len(members), children))
            if len(members) <= self.leaf:
                order.append(members)
                continue
            order.append(members[:1])
            rest = members[1:]
            distance = _distance(fps[rest], fps[members[0]])
            by = np.argsort(distance, kind="stable")
            rest, distance = rest[by], distance[by]
            cuts = np.flatnonzero(np.diff(distance)) + 1
            at = start + 1
            groups = []
            for part, d in zip(np.split(rest, cuts), distance[np.concatenate(([0], cuts))].tolist()):
                groups.append((part, at, (here, d)))
                at += len(part)
            pending += groups[::-1]  # preorder

    def links(self, queries: np.ndarray, radius: int, label_of_query: np.ndarray, label_of_member: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(query position, member position) pairs within the radius that lie in different components; subtrees in the query's own are not entered."""
        changes = np.concatenate(([0], np.cumsum(label_of_member[1:] != label_of_member[:-1])))
        label_of_node = np.where(changes[self.starts] == changes[self.stops - 1], label_of_member[self.starts], -1).tolist()
        found = []
        stack = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while stack:
            node, q = stack.pop()
            start, stop, children = self.nodes[node]
            if label_of_node[node] >= 0:
                q = q[label_of_query[q] != label_of_node[node]]
            if not len(q):
                continue
            if not children:
                near = _distance(queries[q][:, None], self.fps[None, start:stop]) <= radius
                a, b = np.nonzero(near & (label_of_query[q][:, None] != label_of_member[None, start:stop]))
                found.append((q[a], b + start))
                continue
            distance = _distance(queries[q], self.fps[start])
            hit = q[(distance <= radius) & (label_of_query[q] != label_of_member[start])]
            found.append((hit, np.full(len(hit), start)))
            for edge, child in children:
                follow = q[np.abs(distance - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))
        return found


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining the components of a[i] and b[i]; the smaller label stays."""
    la, lb = labels[a], labels[b]
    apart = la != lb
    if not apart.any():
        return labels
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for pair in np.unique(la[apart] * len(labels) + lb[apart]).tolist():
        x, y = map(root, divmod(pair, len(labels)))
        if x != y:
            parent[max(x, y)] = min(x, y)
    table = np.arange(len(labels))
    for x in parent:
        table[x] = root(x)
    return table[labels]


def components_within(fps: np.ndarray, radius: int, block: int | None = None) -> np.ndarray:
    """For each fingerprint (row x lane) the position of its component's first member, links being Hamming distance <= radius.

    The tree is asked with 1, 2, 4, ... and at last `block` fingerprints at once. What one group has in common is merged by the
    first few, so later ones do not meet it again, and never more than block x len(fps) links are held.
    """
    labels = np.arange(len(fps))
    if len(fps) < 2:
        return labels
    if len(fps) <= (BKTree.LEAF if fps.shape[1] == 1 else BKTree.WIDE_LEAF):  # a tree of one leaf
        return _merge(labels, *np.nonzero(_distance(fps[:, None], fps[None, :]) <= radius))
    tree = BKTree(fps)
    block = block or max(64, HELD_LINKS // len(fps))
    k, now = 0, 1
    while k < len(fps):
        queries = np.arange(k, min(k + now, len(fps)))
        hits = tree.links(fps[queries], radius, labels[queries], labels[tree.order])
        if hits:
            labels = _merge(labels, queries[np.concatenate([h[0] for h in hits])], tree.order[np.concatenate([h[1] for h in hits])])
        k, now = k + now, min(2 * now, block)
    return labels


def _block_masks(blocks: int, radius: int, most_bits: int = BITS) -> list[int]:
    """A mask for each choice of blocks - radius blocks, of its first most_bits bits."""
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    parts = [range(a, b) for a, b in zip(edges, edges[1:])]
    return sorted({sum(1 << bit for bit in list(chain(*c))[:most_bits]) for c in combinations(parts, blocks - radius)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def blocks_for(distinct: int, radius: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """The fewest blocks for which evenly spread fingerprints give buckets of about bucket_rows."""
    for blocks in range(radius + 1, radius + 7):
        if distinct >> (BITS * (blocks - radius) // blocks) <= bucket_rows:
            return blocks
    return radius + 7


def _by_blocks(distinct: DataFrame, radius: int, count: int) -> DataFrame:
    """(fp, bucket): all choices of blocks, so that every pair within the radius shares a bucket.

    A key takes no more bits than give buckets of about BUCKET_ROWS, so that at any size it is the trees that search.
    """
    most_bits = max(0, count // BUCKET_ROWS).bit_length()
    masks = _block_masks(blocks_for(count, radius), radius, most_bits)
    values = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)]
    return distinct.select("fp", F.explode(F.array(*values)).alias("bucket"))


def _by_bands(distinct: DataFrame, lanes: int, bands: int, band_bits: int) -> DataFrame:
    """(fp, bucket): fixed samples of bits, the same on every machine."""
    picked = np.stack([np.random.default_rng(SEED + k).choice(lanes * BITS, band_bits, replace=False) for k in range(bands)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = (1 << np.arange(band_bits)).astype(np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                some = batch.column(0).slice(k, 2048)
                bits = np.unpackbits(_array(some, lanes).view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
                values = bits[:, picked] @ powers + (np.arange(bands) << band_bits)
                yield pa.RecordBatch.from_arrays([some.take(pa.array(np.repeat(np.arange(len(some)), bands))), pa.array(values.ravel())], ["fp", "bucket"])
        give_back()

    return distinct.mapInArrow(run, f"fp {_type(lanes)}, bucket long")


def link_stars(distinct: DataFrame, *, radius: int, count: int, lanes: int = 1, bands: int | None = None, band_bits: int = 12, shard_rows: int = 4096) -> DataFrame:
    """(src, dst): links that join the same fingerprints as all pairs within the radius do.

    distinct has one column, fp, without repeats.
    """
    if lanes == 1 and bands is None:
        entries = _by_blocks(distinct, radius, count)
    else:
        entries = _by_bands(distinct, lanes, bands or bands_for(radius / (lanes * BITS), band_bits), band_bits)
    sizes = entries.groupBy("bucket").count()
    hot = sizes.where(F.col("count") > shard_rows).select("bucket", F.ceil(F.col("count") / shard_rows).cast("int").alias("shards"))
    # the shards of a hot bucket meet in pairs
    some = entries.join(hot, "bucket", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    units = some.select("fp", "bucket", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")).select(
        "fp", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit")
    )
    dealt = units.repartition(F.col("unit")).sortWithinPartitions("unit", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            labels = components_within(fps, radius)
            members = np.flatnonzero(labels != np.arange(len(fps)))
            return fps[labels[members]], fps[members]

        def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_column(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["src", "dst"])

        rest_fp, rest_unit = np.zeros((0, lanes), np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            fp = np.concatenate([rest_fp, _array(batch.column(0), lanes)])
            unit = np.concatenate([rest_unit, batch.column(1).to_numpy()])
            cuts = np.flatnonzero(np.diff(unit)) + 1
            last = cuts[-1] if len(cuts) else 0
            lows = np.concatenate(([0], cuts)).astype(np.int64)
            found = [stars(fp[a:b]) for a, b in zip(lows[:-1].tolist(), lows[1:].tolist()) if b - a > 1]
            if found:
                yield batch_of(found)
            rest_fp, rest_unit = fp[last:], unit[last:]
        if len(rest_fp) > 1:
            yield batch_of([stars(rest_fp)])
        give_back()

    return dealt.mapInArrow(run, f"src {_type(lanes)}, dst {_type(lanes)}").where("src <> dst").distinct()


def bands_for(share: float, band_bits: int, missed: float = 0.002) -> int:
    """The bands that find a pair whose bits differ in 0.85 of the share, but for the missed part."""
    return int(np.ceil(np.log(missed) / np.log(1 - (1 - 0.85 * share) ** band_bits)))


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, rep): for each fingerprint on an edge the least rep of those it reaches.

    nodes is (fp, rep).  Each round every node points to its least neighbour, or to
    itself if it is less; pointers are followed to their roots by doubling; then the
    edges are contracted to edges between roots.  Rounds and doublings are
    logarithmic, and from the second round on only what is left between roots is joined.
    """

    def oriented(e: DataFrame) -> DataFrame:
        return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()

    edges = materialize(oriented(edges), "simhash-edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("dst", "src"))
        last = materialize(both.groupBy(F.col("src").alias("fp")).agg(F.min("dst").alias("to")).select("fp", F.least("fp", "to").alias("to")), "simhash-up")
        while True:
            far = last.select(F.col("fp").alias("via"), F.col("to").alias("far"))
            up = materialize(last.join(far, F.col("to") == F.col("via")).select("fp", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "simhash-up")
            discard(last)
            last = up
            if up.where("moved").isEmpty():
                break
        up = up.select("fp", "to")
        ends = [up.select(F.col("fp").alias(f"{e}_fp"), F.col("to").alias(f"{e}_to")) for e in ("src", "dst")]
        moved = edges.join(ends[0], F.col("src") == F.col("src_fp")).join(ends[1], F.col("dst") == F.col("dst_fp"))
        done, edges = edges, materialize(oriented(moved.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst"))), "simhash-edges")
        discard(done)
        if roots is None:
            roots = up.withColumnRenamed("to", "root")
        else:
            again = up.select(F.col("fp").alias("was"), F.col("to").alias("now"))
            roots = materialize(roots.join(again, F.col("root") == F.col("was"), "left").select("fp", F.coalesce("now", "root").alias("root")), "simhash-roots")
            discard(last)
    if roots is None:
        return nodes.limit(0)
    named = roots.join(nodes, "fp")
    least = named.groupBy("root").agg(F.min("rep").alias("rep"))
    return named.select("fp", "root").join(least, "root").select("fp", "rep")


def near_duplicate_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 4,
    radius: int = 4,
    lanes: int = 1,
    bands: int | None = None,
    band_bits: int = 12,
    shard_rows: int = 4096,
) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the least doc_id it reaches over links."""
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, lanes=lanes), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-nodes")
    stars = link_stars(nodes.select("fp"), radius=radius, count=nodes.count(), lanes=lanes, bands=bands, band_bits=band_bits, shard_rows=shard_rows)
    labels = component_labels(nodes, stars).select("fp", F.col("rep").alias("linked"))
    known = materialize(nodes.join(labels, "fp", "left").select("fp", "n", F.coalesce("linked", "rep").alias("component_id")), "simhash-known")
    return join_classes(prints, known, ["fp"], "n", prints.count()).select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    return np.unique(shingle_hashes(text, shingle_words))


def set_prints(docs: DataFrame, *, id_col: str, text_col: str, shingle_words: int, lanes: int) -> DataFrame:
    """(doc_id, fp, key, n): the fingerprint of each text's distinct shingles, a 128-bit digest of them and their number."""
    from xxhash import xxh3_128_digest

    bounded_batches(docs.sparkSession, 4 << 20)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, sizes = np.zeros((batch.num_rows, lanes), np.uint64), [], []
            for k, t in enumerate(batch.column(1)):
                own = shingle_set(t.as_py(), shingle_words)
                fps[k] = majority(own, lanes)
                keys.append(xxh3_128_digest(own.tobytes(), SEED))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), _column(fps), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "fp", "key", "n"])
            del batch, fps
            give_back()

    return rows.mapInArrow(run, f"doc_id long, fp {_type(lanes)}, key binary, n long")


def components_similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the position of its component's first member, links being Jaccard similarity >= similarity."""
    labels = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, term = np.unique(flat, return_inverse=True)
    of = np.repeat(np.arange(len(sets)), sizes)
    held = of[np.argsort(term, kind="stable")]  # the sets of each term, in order
    ends = np.cumsum(np.bincount(term))
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    filled = starts.copy()  # up to here a term's sets have been seen
    first = 0
    for k, size in enumerate(sizes.tolist()):
        own = term[first : first + size]
        first += size
        if size:
            met = np.concatenate([held[a:b] for a, b in zip(starts[own].tolist(), filled[own].tolist())])
            both = np.bincount(met, minlength=k) if k else np.zeros(0, np.int64)
            found = np.flatnonzero((both > 0) & (both >= similarity * (sizes[:k] + size - both) - 1e-9))
            filled[own] += 1
            if len(found):
                linked = np.unique(labels[found])
                labels[k] = linked[0]
                if len(linked) > 1:
                    labels[:k][np.isin(labels[:k], linked)] = linked[0]
    return labels


def verified_stars(members: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, shingle_words: int, similarity: float, broadcast_rows: int) -> DataFrame:
    """(src, dst): links that join the same of members as all pairs of a component with the similarity do.

    members is (rep, component, shards): the id of a row of docs, its candidate component and the shards that this is cut into.
    """
    few = members.count() <= broadcast_rows
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(members) if few else members, "rep").select("rep", "component", "shards", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = pa.array([shingle_set(t.as_py(), shingle_words).tobytes() for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), blobs], ["rep", "component", "shards", "shingles"])

    sets = chosen.mapInArrow(read, "rep long, component long, shards int, shingles binary")
    mine = F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")
    units = sets.select("rep", "component", "shingles", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")).select(
        "rep", F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "shingles"
    )
    dealt = units.repartition(F.col("unit")).sortWithinPartitions("unit", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, reps, sets = None, [], []

        def stars() -> pa.RecordBatch:
            labels = components_similar(sets, similarity)
            ids = np.array(reps, np.int64)
            members = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(ids[labels[members]]), pa.array(ids[members])], ["src", "dst"])

        for batch in batches:
            for rep, now, blob in zip(*(batch.column(k) for k in range(3))):
                if (now := now.as_py()) != unit:
                    if len(reps) > 1:
                        yield stars()
                    unit, reps, sets = now, [], []
                reps.append(rep.as_py())
                sets.append(np.frombuffer(blob.as_py(), "<u8"))
        if len(reps) > 1:
            yield stars()
        reps, sets = [], []
        give_back()

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def similar_groups(
    docs: DataFrame,
    *,
    similarity: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    radius: int = 60,
    lanes: int = 4,
    bands: int | None = None,
    band_bits: int = 12,
    shard_rows: int = 4096,
    shard_bytes: int = 4 << 20,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(doc_id, key, component_id): each row's shingle set and the least doc_id it reaches over links of the similarity; ids are without repeats and nulls."""
    prints = materialize(set_prints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, lanes=lanes), "simhash-prints")
    sets = materialize(prints.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.count("*").alias("rows")), "simhash-sets")
    nodes = materialize(sets.groupBy("fp").agg(F.min("rep").alias("rep")), "simhash-nodes")
    stars = link_stars(nodes.select("fp"), radius=radius, count=nodes.count(), lanes=lanes, bands=bands, band_bits=band_bits, shard_rows=shard_rows)
    labels = component_labels(nodes, stars).select("fp", F.col("rep").alias("linked"))
    known = nodes.withColumnRenamed("rep", "own").join(labels, "fp", "left").select("fp", F.coalesce("linked", "own").alias("component"))
    placed = materialize(sets.join(known, "fp").select("rep", "component", "n"), "simhash-placed")
    several = placed.groupBy("component").agg(F.count("*").alias("members"), F.ceil(F.sum(8 * F.col("n") + 1024) / shard_bytes).cast("int").alias("shards")).where("members > 1")
    members = join_classes(placed, several, ["component"], "members", placed.count()).where("shards IS NOT NULL")
    members = materialize(members.select("rep", "component", "shards"), "simhash-members")
    links = verified_stars(members, docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, similarity=similarity, broadcast_rows=broadcast_rows)
    joined = component_labels(members.select(F.col("rep").alias("fp"), "rep"), links).select(F.col("fp").alias("of"), F.col("rep").alias("linked"))
    final = materialize(sets.join(joined, F.col("rep") == F.col("of"), "left").select("key", "rows", F.coalesce("linked", "rep").alias("component_id")), "simhash-final")
    return join_classes(prints, final, ["key"], "rows", prints.count()).select("doc_id", "key", "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **how) -> DataFrame:
    """docs with one row of each near-duplicate group, that with the least doc_id, null last.

    With a similarity the groups are those of similar_groups, without one those of near_duplicate_groups.
    Of rows that repeat both id and text one stays; rows that repeat an id with other texts are documents of their own.
    """
    columns = docs.columns
    own, first, times = fresh(columns, "__id", "__first", "__times")
    far = lambda *c: F.lit(1 << 62) + F.pmod(F.xxhash64(*c), F.lit(1 << 62))
    named = docs.withColumn(own, F.coalesce(F.col(id_col).cast("long"), far(text_col)))
    # ids are counted without their texts, which only repeated ids need
    repeated = materialize(named.groupBy(own).agg(F.count("*").alias(times)).where(F.col(times) > 1).select(own), "simhash-repeated")
    if not repeated.isEmpty():
        texts_of = named.join(repeated, own, "left_semi").groupBy(own).agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias(first))
        repeated = materialize(texts_of, "simhash-first")
        # of repeated ids the least text keeps the id; of repeated ids and texts the row whose columns have the least hash stays
        whole = F.struct(*[F.col(f"`{c}`") for c in columns])
        one = named.groupBy(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(times), text_col).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row")).select("row.*", own)
        apart = F.col(first).isNotNull() & (F.coalesce(F.col(text_col), F.lit("")) != F.col(first))
        named = one.join(repeated, own, "left").withColumn(own, F.when(apart, far(own, text_col)).otherwise(F.col(own))).drop(first)
        named = materialize(named, "simhash-named")
    texts = named.select(F.col(own).alias("id"), F.col(text_col).alias("text"))
    if similarity is not None:
        groups = similar_groups(texts, id_col="id", text_col="text", similarity=similarity, **how)
    else:
        groups = near_duplicate_groups(texts, id_col="id", text_col="text", **how)
    keepers = groups.where("doc_id = component_id").select(F.col("doc_id").alias(own))
    return named.join(keepers, own, "left_semi").select(*[F.col(f"`{c}`") for c in columns])


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
