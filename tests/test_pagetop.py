"""The best pages of each query from the kept index are those of all scored pairs, which stay inside tasks."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from marlstone import plans
from marlstone.functions.text import context_keywords
from marlstone.operators import corpus, evaluation, pagetop, retrieval, termindex
from marlstone.operators.termindex import TermIndex
from marlstone.sources.versioned import Store

PAGE = "path long, title string, aliases array<string>, summary string, text string"


def ranked(scored, k, field):
    rows = {}
    for r in scored:
        rows.setdefault(r.query_id, []).append((-r[field], r.path, r.score, r.found))
    return sorted((q, p, s, f, n + 1) for q, held in rows.items() for n, (_, p, s, f) in enumerate(sorted(held)[:k]))


@pytest.mark.parametrize("repeats", [False, True])
def test_best_is_the_head_of_search(spark, tmp_path, monkeypatch, repeats):
    rng = random.Random(7)
    stems = ["étage", "stage", "wagen", "wage", "age", "ment", "moment", "x", "ää", "漢字"]
    words = [a + b for a in stems for b in stems[:6]] + stems
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(p, say(5), [say(3)], say(8), say(40)) for p in range(60)]
    if repeats:
        rows += [(p, say(5), [], say(8), say(30)) for p in range(9)]
    for name, n in (("POSTINGS_PER_TASK", 400), ("PAGES_AT_ONCE", 20), ("QUERIES_AT_ONCE", 4)):
        monkeypatch.setattr(termindex, name, n)
    monkeypatch.setattr(pagetop, "GRAM_CELLS", 300)
    index = TermIndex(Store(spark, f"{tmp_path}/{uuid.uuid4().hex}", 4)).update(spark.createDataFrame(rows, PAGE), signature="0", whole=True)
    asked = [(q, w, rng.choice([1.0, 0.3])) for q in [None, *range(7)] for w in sorted({rng.choice(words + ["zzstagementqx", "wagenmomentage", "zz", "qqqqqq"]) for _ in range(6)})]
    asked += [(1, "zzstagementqx", 1.0), (1, "étage", 0.5), (1, "étage", 0.5)]
    queries = spark.createDataFrame(asked, "query_id int, term string, weight double")
    told = lambda df, kind: sorted((r.query_id, r.path, r.score, r.found, r.rank) for r in df.collect() if r.by == kind and r.query_id is not None)
    every = index.search(queries).where("query_id IS NOT NULL").collect()
    for limit in (0, 10**6):  # all postings, or those of some words
        monkeypatch.setattr(termindex, "BROADCAST_KEYS", limit)
        best = index.best(queries, 5, by=("score", "found"))
        for kind in ("score", "found"):
            assert told(best, kind) == ranked(every, 5, kind)
    known = index.best(queries, 5, out_of_vocabulary=False)
    assert told(known, "score") == ranked(index.search(queries, out_of_vocabulary=False).where("query_id IS NOT NULL").collect(), 5, "score")
    assert known.where("query_id IS NULL").count() == 5


def test_pairs_of_queries_and_pages_are_no_rows(spark, tmp_path):
    index = TermIndex(Store(spark, f"{tmp_path}/i", 4)).update(spark.createDataFrame([(p, "", [], "", f"common w{p}") for p in range(300)], PAGE), signature="0", whole=True)
    queries = spark.createDataFrame([(q, w, 1.0) for q in range(50) for w in ("common", "zzcommonqx")], "query_id int, term string, weight double")
    made = index.best(queries, 3)
    assert made.count() == 150 and retrieval.top_k(index.search(queries), 3).count() == 150
    assert sum(spark.read.parquet(f).count() for f in made.inputFiles()) <= 150 * (1 + 300 // termindex.PAGES_AT_ONCE)


def test_trigram_frequencies_are_those_of_postings_in_a_row_for_each_trigram(spark):
    texts = ["étages 漢字x x\u0301yz étage", None, "", "a𝒳bc 𝒳𝒴 wagen", "wagens été"]
    rows = [(p, t and t[:9], ["wagen"] * ((p or 0) % 2), None, t) for p, t in [*enumerate(texts), (3, "wagon wagen"), (None, "étage"), (None, "étage")]]
    for some in (rows, rows[:5]):  # with and without pages that repeat a path
        pages = spark.createDataFrame(some, PAGE)
        want = corpus.gram_postings(corpus.field_terms(pages)).select("path", "gram").distinct().groupBy("gram").count()
        assert sorted(map(tuple, corpus.gram_frequencies(pages).collect())) == sorted(map(tuple, want.collect()))
    plan = corpus.gram_frequencies(spark.createDataFrame(rows[:5], PAGE))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" not in plan


def test_nearest_vectors_of_parts_and_blocks(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(90)] + [(200, [0.0] * 4), (201, None)]
    near = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)
    good = {i: v for i, v in vectors if v and any(v)}
    want = {q: [(i, s) for s, i in sorted((-near(good[q], v), i) for i, v in good.items() if i != q)[:5]] for q in range(0, 90, 10) if q in good}
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    monkeypatch.setattr(evaluation, "VECTORS_PER_TASK", 30)
    monkeypatch.setattr(evaluation, "SCORE_CELLS", 50)
    got = {}
    made = evaluation.nearest_by_cosine(frame, frame.where("vec_id % 10 = 0"), 5, block=4)
    for r in sorted(made.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, -r.score))
    assert got == want
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()


def test_candidate_window_is_that_of_all_pairs_and_writes_none(spark, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "beta", "alphabet", "gamma", "amma", "delta", "omega", "bet"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(p, -p, say(4), [say(2)] if p % 3 else None, rng.choice([None, say(7), say(7).upper()])) for p in range(80)]
    keywords = {q: [*rng.sample(words, 2), words[q], words[q]] if q != 2 else [] for q in range(6)}
    context = {q: rng.sample(words, 3) for q in range(7)}  # the last has no keywords
    has = lambda t, w: t is not None and w in t.lower()
    fine = {w for w in words if 0 < sum(has(r[4], w) for r in rows) <= int(sum(r[4] is not None for r in rows) * 0.5)}
    assert fine and fine != set(words)
    want = []
    for q in range(7):
        points = [(-sum(3 if has(t, w) else 2 if any(has(a, w) for a in al or ()) else 0 for w in keywords.get(q, [])) - sum(has(x, w) for w in context[q] if w in fine), pos, p) for p, pos, t, al, x in rows]
        want += [(q, p, -s, n + 1) for n, (s, _, p) in enumerate(sorted(points)[:9]) if q in keywords or s]
    written, keep = [], retrieval.materialize

    def counted(df, label):
        out = keep(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "materialize", counted)
    monkeypatch.setattr(retrieval, "WINDOW_PAGES", 40)
    monkeypatch.setattr(retrieval, "WINDOW_QUERIES", 3)
    pages = spark.createDataFrame(rows, "path long, pos long, title string, aliases array<string>, text string")
    asked = spark.createDataFrame(list(keywords.items()), "query_id int, keywords array<string>")
    said = spark.createDataFrame([(q, w) for q, held in context.items() for w in held], "query_id int, word string")
    got = retrieval.candidate_window(pages, asked, said, k=9)
    assert sorted((r.query_id, r.path, r.score, r.rank) for r in got.collect()) == sorted(want)
    assert max(written) <= max(80, 7 * 9 * 2)


def test_candidate_window_reads_questions_and_pages_to_their_ends(spark):
    far = "x " * 200 + "beyond", "y " * 1500 + "beyond"
    asked = spark.createDataFrame([(1, far[0])], "query_id int, text string").select("query_id", F.explode(context_keywords(F.col("text"))).alias("word"))
    assert [tuple(r) for r in asked.collect()] == [(1, "beyond")]
    pages = spark.createDataFrame([(1, 1, "a", None, "none"), (2, 2, "b", None, far[1]), (3, 3, "c", None, "z")], "path long, pos long, title string, aliases array<string>, text string")
    keywords = spark.createDataFrame([(1, ["absent"])], "query_id int, keywords array<string>")
    got = retrieval.candidate_window(pages, keywords, asked, k=1)
    assert [(r.path, r.score) for r in got.collect()] == [(2, 1)]
    assert not any(cut in plans.SQL["candidate_window"] for cut in ("left(text, 300)", "left(lower(text)"))
