import random
import re

from marlstone.llm import decontam


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def slow(docs, items):
    """Best verified alignment of each (doc_id, item), trying every alignment."""
    named = {}
    for i, t in items:
        named.setdefault(tuple(words(t)), []).append(i)
    out = {}
    for d, t in docs:
        dw = words(t)
        for iw, ids in named.items():
            for off in range(-len(iw), len(dw) + 1):
                same = [0 <= i + off < len(dw) and dw[i + off] == w for i, w in enumerate(iw)]
                if not any(same):
                    continue
                win = min(len(iw), 15)
                best = max(sum(same[s : s + win]) for s in range(len(iw) - win + 1))
                if best >= -(-win * 4 // 5):
                    row = ((best, sum(same), -off), (off, len(iw), sum(same), win, best))
                    key = (d, min(ids))
                    out[key] = max(out.get(key, row), row)
    return {k: v[1] for k, v in out.items()}


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1, "w") for r in docs], "doc_id long, text string, item_id int, words string")
    b = spark.createDataFrame([(*r, "s") for r in items], "item_id long, text string, seed string")
    out = decontam.overlaps(d, b, **how).collect()
    assert len(out) == len({(r.doc_id, r.item_id) for r in out})
    return {(r.doc_id, r.item_id): (r.doc_word, r.item_words, r.matched, r.window, r.window_matched) for r in out}


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["the"] * 100
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([3, 4, 5, 7, 8, 9, 10, 12, 15, 30, 60])))) for i in range(30)]
    items += [(100, items[3][1].upper() + "!"), (101, None), (102, "")]
    docs = []
    for i in range(120):
        t = say(rng.randrange(0, 80))
        if rng.random() < 0.7:
            w = words(rng.choice(items)[1])
            cut = w[rng.choice([0, 0, 5]) : rng.choice([len(w), len(w), 20])]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
                if cut:
                    cut[rng.randrange(len(cut))] = "zz"
            at = rng.randrange(len(t) + 1)
            t[at:at] = cut
        docs.append((i, ", ".join(t)))
    return docs + [(500, None), (501, ""), (7, docs[8][1]), (None, items[5][1]), (502, "x " * 60000 + items[6][1])], items


def test_matches_brute_force(spark):
    docs, items = corpus(1)
    want = slow(docs, items)
    assert len(want) > 20
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, broadcast_seeds=0) == want


def test_no_substitution_that_the_rule_allows_is_missed():
    from itertools import combinations

    for n in range(5, 16):
        for gone in combinations(range(n), n - -(-n * 4 // 5)):
            assert any(all(p + o not in gone for o in m) for m in decontam.MASKS for p in range(n - max(m)))


def test_short_items_match_whole_only(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three"), (4, "one two three four"), (5, "a b c d e")]
    docs = [(1, "x Alpha y"), (2, "beta x gamma"), (3, "beta, gamma"), (4, "one two three four"), (5, "one two five four"), (6, "a b z d e"), (7, "a z c z e")]
    assert set(run(spark, docs, items)) == {(1, 1), (3, 2), (4, 3), (4, 4), (6, 5)}


def test_many_alignments_and_a_hot_null_id(spark):
    item = "the same words the same words the same words the same words"
    docs = [(None, f"{item} {k}") for k in range(40)] + [(1, "the same words " * 3000), (2, "the other words " * 3000)]
    want = slow(docs, [(9, item)])
    assert set(want) == {(None, 9), (1, 9)}
    assert run(spark, docs, [(9, item)]) == want


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j", 5, 6), (2, "nothing of it is here at all", 7, 8)], "doc_id long, text string, leaked_id long, seed long")
    b = spark.createDataFrame([(1, "a b c d e f g h i j", 3)], "item_id long, text string, doc_id long")
    left = decontam.clean_documents(d, b)
    assert left.columns == d.columns and [tuple(r) for r in left.collect()] == [(2, "nothing of it is here at all", 7, 8)]


def test_substitutions_are_tolerated(spark):
    item = " ".join(f"t{i}" for i in range(40))
    doc = " ".join(f"t{i}" if i % 6 else "new" for i in range(40))
    assert (1, 9) in run(spark, [(1, doc), (2, "t1 t2 t3 t4 t5 other words here and there and so on")], [(9, item)])


def test_clean_documents_keep_all_columns(spark):
    docs, items = corpus(2)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_chars int")
    b = spark.createDataFrame(items, "item_id long, text string")
    left = decontam.clean_documents(d, b)
    leaked = {k[0] for k in slow(docs, items)}
    assert left.columns == ["doc_id", "text", "n_chars"]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in leaked)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f g h i")]) == {}
    assert run(spark, [(1, "a b c d e f g h i")], []) == {}
