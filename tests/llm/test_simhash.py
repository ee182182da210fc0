import random

import numpy as np
from xxhash import xxh64_intdigest

from marlstone.llm import simhash


def slow_fingerprint(text, n=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, n=4, radius=4):
    prints = [slow_fingerprint(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.6:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 20, 200]))))
    return list(enumerate(texts))


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    out = simhash.near_duplicate_groups(df, **how).select("doc_id", simhash.fingerprint_hex(simhash.F.col("fp")).alias("f"), "component_id")
    return sorted((str(r.doc_id), r.f, r.component_id) for r in out.collect())


def test_matches_brute_force(spark):
    rows = corpus(1, 250) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A b\tC"), (1003, "a B c"), (None, "a b c"), (None, "q q q q q"), (1004, "ÄB ä b")]
    assert run(spark, rows) == slow_components(rows)


def test_shards_of_hot_buckets_lose_no_link(spark):
    rows = corpus(2, 300)
    assert run(spark, rows, shard_rows=7) == slow_components(rows)


def test_very_long_text_and_empty_table(spark):
    rows = [(1, "a b c d e f " * 40000), (2, "a b c d e f " * 40000 + "z")]
    assert run(spark, rows) == slow_components(rows)
    assert run(spark, []) == []


def test_tree_finds_all_components():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = [int(c) for c in centre]
    for _ in range(900):
        x = fps[rng.integers(len(fps))]
        for b in rng.integers(0, 64, rng.integers(1, 9)):
            x ^= 1 << int(b)
        fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    labels = simhash.components_within(fps.reshape(-1, 1), 4, block=64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = np.arange(len(fps))
    while True:
        now = np.array([want[n].min() for n in near])
        if (now == want).all():
            break
        want = now
    assert (labels == want).all()


def test_every_pair_within_the_radius_shares_a_bucket():
    rng = random.Random(4)
    for blocks in (5, 6, 7, 8):
        masks = simhash._block_masks(blocks, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def jaccard(a, b, n=5):
    grams = lambda t: {tuple(w[k : k + n]) for w in [t.split()] for k in range(max(1, len(w) - n + 1))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_wide_fingerprints_find_similar_texts(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    rows = []
    for i in range(150):
        base = [rng.choice(words) for _ in range(rng.choice([80, 200, 400]))]
        near = list(base)
        for _ in range(len(base) // 100 + 1):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(base[: len(base) // 2] + [rng.choice(words) for _ in range(len(base) // 2)]))]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=5, lanes=4, radius=50)
    kept = {r.doc_id for r in kept.collect()}
    texts = dict(rows)
    similar = [i for i in range(150) if jaccard(texts[3 * i], texts[3 * i + 1]) >= 0.85]
    assert len(similar) > 100 and sum(3 * i + 1 in kept for i in similar) == 0
    assert all(3 * i in kept and 3 * i + 2 in kept for i in range(150))


def similar_components(rows, least=0.8):
    """The least id of each text's component, trying every pair."""
    grams = {d: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for d, t in rows}
    group = {d: d for d in grams}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(grams)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(grams[a] & grams[b])
            if both and both >= least * (len(grams[a]) + len(grams[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {d: root(d) for d in ids}


def graded(seed, bases):
    """Texts with copies over the similarities about 0.8, chains of copies, and texts that share one repeated passage."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], say(24)
    for i in range(bases):
        base = say(rng.choice([60, 200, 400]))
        texts = [base]
        for share in (0.005, 0.02, 0.025, 0.03, 0.05):
            last = list(texts[-1] if i % 3 == 0 else base)
            for _ in range(max(1, round(share * len(last)))):
                last[rng.randrange(len(last))] = rng.choice(words)
            texts.append(last)
        texts.append(say(44) + passage * 5)
        rows += [(len(texts) * i + k, " ".join(t)) for k, t in enumerate(texts)]
    return rows


def test_similarity_decides_whatever_the_fingerprints_say(spark):
    import corpus_pipeline

    rows = graded(7, 120)
    want = similar_components(rows)
    pairs = [jaccard(rows[7 * i][1], rows[7 * i + k][1]) for i in range(120) for k in range(1, 6)]
    assert sum(0.8 <= p < 0.85 for p in pairs) > 20 and sum(0.7 <= p < 0.8 for p in pairs) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"shard_bytes": 4096, "broadcast_rows": 0}):
        got = simhash.similar_groups(df, **corpus_pipeline.NEAR, **more).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == {d for d, c in want.items() if d == c}


def test_one_of_each_with_nulls_and_repeated_ids(spark):
    rows = [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (None, "a b c d e f", 3), (7, "x y z", 4), (7, "x y z", 4), (7, "other words here", 5), (None, "lone", 6), (None, "lone", 7), (9, None, 8), (8, "", 9), (None, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, "a b c d e f"), (7, "x y z"), (7, "other words here"), (None, "lone"), (8, "")], key=str)
    assert simhash.keep_one_of_each(df.limit(0)).collect() == []


def test_a_unit_of_near_copies_holds_few_links():
    import tracemalloc

    rng = np.random.default_rng(6)
    fps = np.repeat(rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64), 8192, 0)
    for _ in range(12):
        fps[np.arange(8192), rng.integers(0, 4, 8192)] ^= np.uint64(1) << rng.integers(0, 64, 8192).astype(np.uint64)
    tracemalloc.start()
    labels = simhash.components_within(fps, 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (labels == 0).all() and peak < 64 << 20
    apart = simhash.components_within(np.unique(rng.integers(0, 1 << 63, (2000, 1), dtype=np.uint64), axis=0), 4)
    assert len(set(apart.tolist())) == 2000


def test_evenly_spread_buckets_are_searched_by_trees():
    for count in (1_000, 100_000, 10_000_000, 3_000_000_000):
        bits = (count // simhash.BUCKET_ROWS).bit_length()
        masks = simhash._block_masks(simhash.blocks_for(count, 4), 4, bits)
        assert count >> min(m.bit_count() for m in masks) > simhash.BKTree.LEAF
    rng = random.Random(8)
    for bits in (0, 3, 9):
        for _ in range(100):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in simhash._block_masks(5, 4, bits))


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(4, "a b c d e f g", 777, 1, None), (2, "a b c d e f g", 778, 2, 7), (2, "other words are here", 779, 3, 8), (9, "z", 780, 4, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, fp long, component_id long")
    for how in ({}, {"similarity": 0.8, "shingle_words": 5}):
        got = simhash.keep_one_of_each(df, **how)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == [(2, "a b c d e f g", 778, 2, 7), (2, "other words are here", 779, 3, 8), (9, "z", 780, 4, 9)]


def test_a_large_group_of_copies_meets_its_class_by_broadcast(spark):
    rows = [(k, "one text that many documents share") for k in range(400)] + [(1000 + k, f"text {k} of its own words {k * k}") for k in range(50)]
    assert run(spark, rows) == slow_components(rows)
