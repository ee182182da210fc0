import hashlib
import random
import zlib

import pytest

from marlstone.llm import sharding

SCHEMA = "doc_id long, text string, source string, shard int, node long"


def run(spark, rows, **how):
    return sharding.kd_tree_shards(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), **how).collect()


def slow(rows, shards):
    """doc_id and text checksum: shard, by a recursive split in memory."""
    groups = {}
    for d, t, s in rows:
        b = (t or "").encode()
        g = groups.setdefault(b, [-1 if d is None else d, len(b) + 1, zlib.crc32((s or "").encode()), 0])
        g[0] = min(g[0], -1 if d is None else d)
        g[2] = min(g[2], zlib.crc32((s or "").encode()))
        g[3] += len(b) + 1
    items = [(tuple(g[:3]), int(hashlib.md5(b).hexdigest()[:15], 16), g[3], b) for b, g in groups.items()]
    extent = [max(1, max(i[0][k] for i in items) - min(i[0][k] for i in items)) for k in range(3)] if items else []
    out = {}

    def split(part, first, leaves):
        if leaves == 1 or not part:
            out.update({i[3]: first for i in part})
            return
        wide = [(max(i[0][k] for i in part) - min(i[0][k] for i in part)) / extent[k] for k in range(3)]
        k = wide.index(max(wide))
        part = sorted(part, key=lambda i: (i[0][k], i[1]))
        total, before, cut = sum(i[2] for i in part), 0, 0
        for i in part:
            if leaves * (2 * before + i[2]) > 2 * total * (leaves // 2):
                break
            before += i[2]
            cut += 1
        split(part[:cut], first, leaves // 2)
        split(part[cut:], first + leaves // 2, leaves - leaves // 2)

    split(items, 0, shards)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    texts = ["t%d " % i * rng.choice([1, 2, 50, 400]) for i in range(n // 2)]
    return [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(n)] + [(None, None, None), (5, "", "a"), (5, "", "a"), (7, "x" * 100000, "a")]


@pytest.mark.parametrize("shards,bins", [(16, 1024), (16, 3), (5, 16)])
def test_matches_brute_force(spark, shards, bins):
    rows = corpus(1, 400)
    want = slow(rows, shards)
    by_sum = {(zlib.crc32(b), len(b) + 1): s for b, s in want.items()}
    got = run(spark, rows, shards=shards, bins=bins)
    assert len(got) == len(rows)
    assert all(r.shard == by_sum[r.text_crc32, r.size] for r in got)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sizes_are_near_equal(spark):
    rows = [(i, "w%d " % i * (1 + i * 7 % 90), "s%d" % (i % 5)) for i in range(3000)]
    got = run(spark, rows, shards=16)
    total = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert max(total) - min(total) < 0.02 * sum(total) / 16 + 4 * max(r.size for r in got)


def test_target_bytes_empty_table_and_one_text(spark):
    assert run(spark, [], shards=16) == []
    assert {r.shard for r in run(spark, [(i, "same", "a") for i in range(20)], shards=4)} == {slow([(0, "same", "a")], 4)[b"same"]}
    assert len({r.shard for r in run(spark, [(i, str(i), "a") for i in range(100, 200)], target_bytes=100)}) == 4


def test_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_BUCKET_ROWS", 20)
    got = run(spark, corpus(2, 300), shards=3)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
