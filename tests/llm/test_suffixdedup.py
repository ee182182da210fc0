import random

import numpy as np
import pytest

from marlstone.llm import suffixdedup

LAST = 2**63 - 1


def brute(rows, window=50):
    """First owner of every string of `window` bytes, and the bytes that smaller documents cover."""
    raw = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    owner = {}
    for i, b in raw:
        for k in range(len(b) - window + 1):
            owner[b[k : k + window]] = min(i, owner.get(b[k : k + window], LAST))
    out = []
    for (name, _), (i, b) in zip(rows, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if owner[b[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        spans = []
        for p in (p for p, g in enumerate(gone) if g):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((name, len(b), [tuple(s) for s in spans], bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def found(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kept string, block int").repartition(parts)
    out = suffixdedup.remove_repeats(df, **how)
    got = [(r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in out.collect()]
    suffixdedup.release(out)
    return sorted(got, key=str)


def prose(rng, n):
    return " ".join(rng.choice(["the", "wörd", "of", "stone", "a", "river", "日本", "quick"]) for _ in range(n))


def corpus(rng):
    passage, line = prose(rng, 60), "All rights reserved; see the licence for details of use."
    rows = [(i, prose(rng, rng.randrange(60))) for i in rng.sample(range(500), 40)]
    rows += [(1000 + i, f"{prose(rng, 5)} {passage[rng.randrange(40):]} {prose(rng, 5)}") for i in range(8)]
    rows += [(2000 + i, f"{line}\n{prose(rng, 8)}\n{line}") for i in range(25)]
    rows += [(3000, "x" * 3000), (3001, "x" * 70), (3002, "ab" * 200), (3003, "b" + "ab" * 100), (3004, "y" * 49), (3005, "y" * 49), (3006, "y" * 50), (2999, "y" * 51)]
    rows += [(7, None), (8, ""), (None, passage), (None, passage + "!"), (2000, passage), (2000, passage), (9, "🙂" * 30), (10, "🙂" * 13)]
    return rows


def test_same_as_brute_force(spark):
    rows = corpus(random.Random(1))
    assert found(spark, rows) == brute(rows)


def test_small_blocks_hot_keys_and_divided_keys(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 900), ("BUCKET_BYTES", 3000), ("HOT_BLOCKS", 3), ("COLLECTION", 300)):
        monkeypatch.setattr(suffixdedup, name, value)
    rows = corpus(random.Random(2))
    assert found(spark, rows, parts=5) == brute(rows)


def test_another_window(spark):
    rows = corpus(random.Random(3))
    assert found(spark, rows, window=64) == brute(rows, 64)
    with pytest.raises(ValueError):
        found(spark, rows, window=40)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, [], b""), (2, 0, [], b"")]


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcd"])
def test_columns_give_the_sorted_suffixes(letters):
    rng = random.Random(4)
    for _ in range(60):
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 9))]
        lengths = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings), np.uint8)
        bwt, lcp, rows = suffixdedup.column_bwt(data, np.cumsum(lengths) - lengths, lengths, 5)
        want = sorted((s[k:], i) for i, s in enumerate(strings) for k in range(len(s) + 1))
        common = [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for (a, _), (b, _) in zip(want, want[1:])]
        assert lcp.tolist() == [0, *(min(5, c) for c in common)]
        assert bwt.tolist() == [strings[i][-len(s) - 1] if len(s) < len(strings[i]) else suffixdedup.END for s, i in want]
        place = {w: k for k, w in enumerate(want)}
        assert all(rows[k] == place[strings[i][-len(s) - 1 :], i] for k, (s, i) in enumerate(want) if len(s) < len(strings[i]))


def test_one_key_is_judged_in_parts():
    rng = random.Random(6)
    common = b"a phrase that all of them have "
    strings = list({bytes(rng.choice(b"xyz ") for _ in range(25)) + common + bytes(rng.choice(b"xy") for _ in range(3)) for _ in range(300)})
    ids = np.array([rng.randrange(1000) for _ in strings])
    whole = suffixdedup.least_ids(strings, ids, 50)
    parts = suffixdedup.judge(strings, ids, np.zeros(len(strings), np.int64), 50, 200, (40, 50))
    owner = {}
    for s, i in zip(strings, ids.tolist()):
        for k in range(len(s) - 49):
            owner[s[k : k + 50]] = min(i, owner.get(s[k : k + 50], LAST))
    want = [owner[s[k : k + 50]] for s in strings for k in range(len(s) - 49)]
    assert whole.tolist() == parts.tolist() == want
