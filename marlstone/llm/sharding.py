"""K-d tree partitioning of documents into shards of near-equal bytes.

Documents with equal texts form one group, which is never divided.  A group has
metadata (first doc_id, text bytes, code of its first source) and a weight, the
bytes of all its rows.  Starting with all groups, a node that is to become n
shards is split along the dimension that is widest, measured against the extent
of the whole table, at the weighted quantile floor(n / 2) : ceil(n / 2), until each
node is one shard; a target in bytes gives the number of shards.

The quantile is found by distributed histograms: each round sums the weights
of every open node in `bins` bins, narrows to the bin that holds the cut and goes
on inside it, first over the dimension's values and then, among rows of that
value, over a hash of the text, so that ties are cut as well.  The driver sees
nodes x bins sums, a bounded number of them (more open nodes take fewer bins and more
rounds), and never a list of groups.

Law kept: `bytes`.  A shard misses its share by half of the groups at its cuts; a
group larger than a share stays whole.  Slots count from 0 without gaps inside a
shard; they are numbered by buckets of rows and bucket offsets, so no task
sorts a shard. Groups of many rows get their shard by a bounded broadcast.

Defined results.  A null text counts as the empty text (size 1, checksum 0).
Null doc_id and source count as -1 and the empty string in the metadata.
Repeated rows each get their own slot.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import join_classes, materialize, text_or_empty

DIMENSIONS = ("first_id", "bytes", "origin")
TIE_LIMIT = 1 << 60
SLOT_BUCKET_ROWS = 65536
#: Sums of bins that the driver sees at once, and levels of the tree that one plan holds.
MOST_SUMS, PLAN_LEVELS = 1 << 18, 4


def hash60(text: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 sum as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def groups_of(docs: DataFrame, *, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): the rows without their texts, and a row for each distinct text."""
    text = text_or_empty(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            hash60(text).alias("tie"),
            F.crc32(F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("origin"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("tie", "text_crc32", F.col("size").alias("bytes")).agg(
        F.min(F.coalesce("doc_id", F.lit(-1))).alias("first_id"), F.min("origin").alias("origin"), F.sum("size").alias("weight"), F.count("*").alias("n")
    )
    return rows, materialize(groups, "shard-groups")


@dataclass
class _Cut:
    """The search for one node's cut."""

    node: int
    leaves: int
    dim: int
    lo: int
    hi: int
    target: int  # twice the weight wanted on the left, times leaves
    before: int = 0  # weight known to lie left of [lo, hi]
    value: int | None = None  # once the dimension's value is found: lo and hi are of the tie hash
    tie: int | None = None  # the last tie hash on the left


def _values(rows: list[list[str]], names: str) -> str:
    """A query for a few rows of SQL literals."""
    return f"SELECT * FROM VALUES {', '.join(f'({", ".join(r)})' for r in rows)} AS t({names})"


def _find_cuts(placed: DataFrame, cuts: list[_Cut], bins: int) -> None:
    """Fill in value and tie of every cut."""
    spark = placed.sparkSession
    chosen = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
    open_cuts = cuts
    while open_cuts:
        bins = max(16, min(bins, MOST_SUMS // len(open_cuts)))
        params = [
            [f"{c.node}L", f"{c.dim}", f"{c.lo}L", f"{c.hi}L", f"{(c.hi - c.lo) // bins + 1}L", "false" if c.value is None else "true", f"{c.value or 0}L"] for c in open_cuts
        ]
        asked = spark.sql(_values(params, "node, dim, lo, hi, width, by_tie, value"))
        inside = (
            placed.join(F.broadcast(asked), "node")  # a row for each open node, fewer than the shards
            .withColumn("at", F.when(F.col("by_tie"), F.col("tie")).otherwise(chosen))
            .where(F.col("at").between(F.col("lo"), F.col("hi")) & (~F.col("by_tie") | (chosen == F.col("value"))))
            .groupBy("node", F.expr("(at - lo) div width").alias("bin"))
            .agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
        )
        histogram: dict[int, list] = {}
        for r in inside.collect():  # at most nodes x bins rows
            histogram.setdefault(r.node, []).append(r)
        still = []
        for c in open_cuts:
            for r in sorted(histogram[c.node], key=lambda r: r.bin):
                if 2 * c.leaves * (c.before + r.weight) > c.target:
                    break
                c.before += r.weight
            if c.value is None and r.low == r.high:
                c.value, c.lo, c.hi = r.low, 0, TIE_LIMIT
                if r.n == 1:
                    c.tie = _side(c, r.weight)
            elif c.value is not None and (r.n == 1 or r.low == r.high):
                c.lo = r.low
                c.tie = _side(c, r.weight)
            else:
                c.lo, c.hi = r.low, r.high
            if c.tie is None:
                still.append(c)
        open_cuts = still


def _side(c: _Cut, weight: int) -> int:
    """The last tie hash on the left: the group on the cut goes left if its middle does."""
    left = c.leaves * (2 * c.before + weight) <= c.target
    if c.lo == 0 and c.hi == TIE_LIMIT:  # the only group of its value
        return TIE_LIMIT if left else -1
    return c.lo if left else c.lo - 1


def assign_leaves(groups: DataFrame, shards: int, bins: int = 1024) -> DataFrame:
    """groups with the column shard, 0 to shards - 1."""
    spark = groups.sparkSession
    placed = groups.withColumn("node", F.lit(0).cast("long"))
    sizes = {0: (0, shards)}  # node: its first leaf and its leaves
    whole = groups.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    extent = [max(1, (whole[f"hi_{d}"] or 0) - (whole[f"lo_{d}"] or 0)) for d in DIMENSIONS]
    level_base, level = 1, 0
    while any(n > 1 for _, n in sizes.values()):
        ranges = {
            r.node: r
            for r in placed.groupBy("node").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        }
        cuts = []
        for node, (_, leaves) in sizes.items():
            if leaves > 1 and node in ranges:
                r = ranges[node]
                widths = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / e for d, e in zip(DIMENSIONS, extent)]
                dim = widths.index(max(widths))
                cuts.append(_Cut(node, leaves, dim, r[f"lo_{DIMENSIONS[dim]}"], r[f"hi_{DIMENSIONS[dim]}"], 2 * r.weight * (leaves // 2)))
        _find_cuts(placed, cuts, bins)
        rows, following, cut_of = [], {}, {c.node: c for c in cuts}
        for node, (first, leaves) in sizes.items():
            c = cut_of.get(node)
            left, right = level_base, level_base + 1
            level_base += 2
            if leaves == 1 or c is None:
                following[left] = (first, leaves if c else 1)
                rows.append([f"{node}L", "0", "-1L", "-1L", f"{left}L", f"{left}L"])
            else:
                following[left] = (first, leaves // 2)
                following[right] = (first + leaves // 2, leaves - leaves // 2)
                rows.append([f"{node}L", f"{c.dim}", f"{c.value}L", f"{c.tie}L", f"{left}L", f"{right}L"])
        moves = spark.sql(_values(rows, "node, dim, value, cut, left_node, right_node"))
        at = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
        goes_left = (at < F.col("value")) | ((at == F.col("value")) & (F.col("tie") <= F.col("cut")))
        placed = placed.join(F.broadcast(moves), "node").withColumn("node", F.when(goes_left, F.col("left_node")).otherwise(F.col("right_node"))).select(*placed.columns)
        sizes, level = following, level + 1
        if level % PLAN_LEVELS == 0 and any(n > 1 for _, n in sizes.values()):
            placed = materialize(placed, "shard-placed")
    leaves = spark.sql(_values([[f"{n}L", f"{first}"] for n, (first, _) in sizes.items()], "node, shard"))
    return placed.join(F.broadcast(leaves), "node").drop("node")


def kd_tree_shards(
    docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bins: int = 1024
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; give the number of shards or the bytes that one may hold."""
    rows, groups = groups_of(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    if shards is None:
        total = groups.agg(F.sum("weight")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = assign_leaves(groups, shards, bins).select("tie", "text_crc32", F.col("bytes").alias("size"), "shard", "n")
    total = rows.count()
    sharded = join_classes(rows, placed, ["tie", "text_crc32", "size"], "n", total)
    buckets = max(1, -(-total // SLOT_BUCKET_ROWS))
    # by id and text, so that neither one id nor one text fills a bucket
    dealt = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    dealt = materialize(dealt, "shard-dealt")
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "tie", "text_crc32", "size")
    return (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )

