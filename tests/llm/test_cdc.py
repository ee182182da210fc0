import hashlib
import random

import pytest

from marlstone.llm import cdc


def slow_ends(data):
    """Chunk ends by rolling one byte after another."""
    ends, at = [], 0
    while len(data) - at > cdc.LEAST:
        end = None
        for e in range(at + cdc.LEAST, min(at + cdc.MOST, len(data)) + 1):
            h = sum(int(cdc.GEAR[data[e - 1 - k]]) << k for k in range(16)) & 0xFFFF
            if h & (cdc.HARD if e < at + cdc.NORMAL else cdc.EASY) == 0:
                end = e
                break
        at = end or min(at + cdc.MOST, len(data))
        ends.append(at)
    return ends + ([len(data)] if at < len(data) else [])


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß日🙂") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(n)]


def test_chunks_match_brute_force():
    for t in texts(1, 60) + ["a" * 1000, "", "x" * 16, "x" * 17]:
        data = t.encode()
        ends = cdc.chunk_ends(data)
        assert ends == slow_ends(data)
        assert not ends or ends[-1] == len(data)
        if len(ends) > 3:
            assert cdc.chunk_ends(data, ends[1]) == ends[2:]


def test_encoding_round_trip_and_containment():
    prints = [cdc.fingerprint(cdc.digests(t.encode(), cdc.chunk_ends(t.encode()))) for t in texts(2, 20)]
    for p in prints:
        assert cdc.decoded(cdc.encoded(p)).tolist() == p.tolist()
        for q in prints:
            shared = set(p.tolist()) & set(q.tolist())
            want = sum(x & 255 for x in shared) / sum(x & 255 for x in p.tolist()) if len(p) else float(not len(q))
            assert cdc.containment(p, q) == pytest.approx(want)


def test_shifts_are_resisted():
    base = " ".join(texts(3, 10))
    moved = "something quite new in front " + base[:3000] + " and within " + base[3000:]
    a, b = (cdc.fingerprint(cdc.digests(t.encode(), cdc.chunk_ends(t.encode()))) for t in (base, moved))
    assert cdc.containment(a, b) > 0.93


def slow(rows):
    import xxhash

    signed = lambda t: (lambda h: h - (1 << 64) if h >= 1 << 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), 42))
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    whole = lambda t: cdc.fingerprint(cdc.digests(t.encode(), slow_ends(t.encode())))
    out = []
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t)
        edited = t[: n - n // 3] + following[: n // 3]
        p, q, r = whole(t), whole(edited), whole(following)
        out.append((str(d), n, hashlib.sha256(edited.encode()).hexdigest(), cdc.encoded(p), cdc.encoded(q), round(cdc.containment(p, q), 9), round(cdc.containment(p, r), 9)))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bucket int, hash string").repartition(3)
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in cdc.compare_with_next(df).collect())


@pytest.mark.parametrize("bucket_rows", [3, 2000])
def test_next_matches_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(cdc, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(4)
    rows = [(rng.choice([i, i * 50, -i]), t) for i, t in enumerate(texts(5, 60))]
    rows += [(7, "same"), (7, "same"), (7, None), (None, "null id"), (None, ""), (10**12, "far " * 30000)]
    assert run(spark, rows) == slow(rows)


def test_buckets_are_even_under_skewed_ids(spark, monkeypatch):
    monkeypatch.setattr(cdc, "BUCKET_ROWS", 50)
    rows = [(k, f"own {k}") for k in range(600)] + [(7, f"many {k}") for k in range(700)] + [(None, f"none {k}") for k in range(700)] + [(-(2**63), "least"), (2**63 - 1, "most"), (10**15, "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = [r["count"] for r in cdc._with_neighbours(df, "doc_id", "text").groupBy("bucket").count().collect()]
    assert len(sizes) > 25 and max(sizes) < 250
    assert run(spark, rows) == slow(rows)


def test_one_row_and_empty_table(spark):
    assert run(spark, [(5, "abc" * 30)]) == slow([(5, "abc" * 30)])
    assert run(spark, [(None, None)]) == slow([(None, None)])
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b" * 50), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.fingerprint for r in cdc.fingerprints(df).collect()} == {int(d): f for d, _, _, f, *_ in slow([(1, "a b" * 50), (2, None)])}
