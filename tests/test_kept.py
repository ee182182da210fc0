"""Kept indexes: what they hold after any changes is what a rebuild holds, and a hit looks at no page."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from marlstone.operators import corpus, retrieval
from marlstone.operators.linkindex import LinkIndex
from marlstone.operators.termindex import TermIndex, kept
from marlstone.sources.versioned import Relation, Store

PAGE = "path long, title string, aliases array<string>, summary string, text string"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "Zeta", "étage", "x"]


def page(rng, path):
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    return (path, say(4), [say(3) for _ in range(rng.randrange(3))], rng.choice([None, say(6)]), rng.choice([None, say(20)]))


def held(index):
    relations = {r.name: sorted(map(str, index.store.read(r).collect())) for r in index.relations()}
    return relations, index.statistics()


def scores(df):
    return sorted((r.query_id, r.path, r.score, r.found) for r in df.collect())


def test_term_index_after_changes_is_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    now = {p: page(rng, p) for p in range(12)}
    make = lambda name: TermIndex(Store(spark, f"{tmp_path}/{name}", 4))
    frame = lambda rows: spark.createDataFrame(list(rows), PAGE)
    index = make("changed").update(frame(now.values()), signature="0", whole=True)
    for step in range(3):
        gone = rng.sample(sorted(now), 2)
        some = [page(rng, p) for p in [*rng.sample(sorted(set(now) - set(gone)), 3), 100 + step]]
        now = {p: r for p, r in now.items() if p not in gone} | {r[0]: r for r in some}
        if step == 1:
            index.update(frame(now.values()), signature="1", whole=True)
        else:
            index.update(frame(some), frame([(p, "", [], "", "") for p in gone]).select("path"), signature=str(step))
    again = make("rebuilt").update(frame(now.values()), signature="2", whole=True)
    assert held(index) == held(again)
    assert held(TermIndex(index.store.compacted(f"{tmp_path}/compact", index.relations()))) == held(again)
    terms = corpus.field_terms(frame(now.values()))
    asked = spark.createDataFrame([(q, t, 1.0) for q, t in [(1, "alpha"), (1, "gamma"), (2, "étage"), (2, "alphas"), (3, "nothing"), (3, "x")]], "query_id int, term string, weight double")
    assert scores(index.search(asked)) == scores(retrieval.bm25f(terms, asked))
    assert scores(index.search(asked, out_of_vocabulary=False)) == scores(retrieval.bm25f(terms, asked, out_of_vocabulary=False))
    cover = lambda df: sorted((r.query_id, r.path, round(r.coverage, 9)) for r in df.collect())
    assert cover(index.name_coverage(asked)) == cover(retrieval.name_coverage(terms, asked))
    grown = lambda df: sorted(map(tuple, df.select("query_id", "term").collect()))
    assert grown(index.expand(asked)) == grown(retrieval.expand(terms, asked))


def test_hits_and_misses(spark, tmp_path):
    rng = random.Random(6)
    path = f"{tmp_path}/pages"
    spark.createDataFrame([page(rng, p) for p in range(30)], PAGE).write.parquet(path)
    pages = spark.read.parquet(path)
    index = TermIndex(Store(spark, f"{tmp_path}/index", 4))
    assert index.signature() is None and index.statistics()["pages"] == 0
    kept(index, "a", pages)
    never = pages.withColumn("text", F.raise_error(F.lit("pages were read")))
    assert kept(index, "a", never) is index and len(index.store.manifests()) == 1
    asked = spark.createDataFrame([(1, "alpha", 1.0)], "query_id int, term string, weight double")
    assert not any(path in f for f in index.search(asked, out_of_vocabulary=False).inputFiles())
    kept(index, "b", pages.withColumn("text", F.when(F.col("path") == 3, "a new body").otherwise(F.col("text"))))
    assert index.signature() == "b" and len(index.store.manifests()) == 2
    assert [r.path for r in index.postings().where("term = 'body'").collect()] == [3]
    with pytest.raises(Exception, match="pages were read"):
        kept(index, "c", never)
    assert index.signature() == "b"


def test_lost_and_broken_commits(spark, tmp_path):
    relation = Relation("r", "k string, v int", "k")
    store = Store(spark, f"{tmp_path}/store", 4)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, n int")
    store.commit({relation: rows(("a", 1, 1), ("b", 2, 1))}, {"signature": "1"})
    store.write(relation, rows(("lost", 9, 1)), uuid.uuid4().hex)  # no manifest follows
    store.commit({relation: rows(("a", 1, -1), ("c", 3, 2))}, {"signature": "2"})
    want = [("b", 2, 1), ("c", 3, 2)]
    assert sorted(map(tuple, store.read(relation).collect())) == want
    assert sorted(map(tuple, store.read(relation, rows(("c", 0, 0), (None, 0, 0), ("zz", 0, 0))).collect())) == want[1:]
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{tmp_path}/store/manifest/version=2")
    assert store.last()["signature"] == "2" and sorted(map(tuple, store.read(relation).collect())) == want


def test_link_index_after_changes_is_a_rebuild(spark, tmp_path):
    rng = random.Random(7)
    links = lambda pages: {p: {f"t{rng.randrange(6)}" for _ in range(rng.randrange(4))} for p in pages}
    frame = lambda of: spark.createDataFrame([(p, t) for p, ts in of.items() for t in [*ts, *list(ts)[:1], p]], "src string, dst string")
    now = links([f"p{k}" for k in range(9)])
    index = LinkIndex(Store(spark, f"{tmp_path}/links", 4), cap=4).update(frame(now))
    for _ in range(3):
        some = links([*rng.sample(sorted(now), 3), f"q{rng.randrange(3)}"])
        now |= some
        index.update(frame(some), spark.createDataFrame([(p,) for p in some], "src string"))
        edges = {(p, t) for p, ts in now.items() for t in ts}
        assert {tuple(r) for r in index.links().collect()} == edges
        count = {t: sum(b == t for _, b in edges) for _, t in edges}
        assert {tuple(r) for r in index.in_degrees().collect()} == set(count.items())
        shared = {}
        for a, t in edges:
            for b, u in edges:
                if t == u and a != b and count[t] < 4:
                    shared[a, b] = shared.get((a, b), 0) + 1
        assert {(r.a, r.b): r.shared for r in index.co_cited().collect()} == shared


def test_links_are_dealt_to_more_tasks_where_they_are_more(spark, tmp_path, monkeypatch):
    """The links of a bucket are written by several tasks; an index without pairs has the same links and counts, and keeps no pairs."""
    from marlstone.operators import linkindex

    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    rows = [(f"p{k}", f"t{(k * j) % 97}") for k in range(300) for j in range(1, 6)]
    gone = frame([(f"p{k}", "t1") for k in range(0, 300, 3)])
    held = {}
    for links, paired in ((250_000, True), (50, True), (50, False)):
        monkeypatch.setattr(linkindex, "LINKS_PER_TASK", links)
        root = f"{tmp_path}/{links}-{paired}"
        index = LinkIndex(Store(spark, root, 2), paired=paired).update(frame(rows + rows)).update(gone)
        files = spark.read.parquet(f"{root}/links").select("bucket", "version", "_metadata.file_path").distinct().groupBy("bucket", "version").count()
        tables = [index.links(), index.in_degrees(), *([index.co_cited()] if paired else [])]
        held[links, paired] = [sorted(map(tuple, t.collect())) for t in tables], max(r["count"] for r in files.collect())
    assert held[50, True][0] == held[250_000, True][0] and held[50, False][0] == held[50, True][0][:2]
    assert held[250_000, True][1] == 1 < held[50, True][1]
    with pytest.raises(ValueError):
        index.co_cited()
    with pytest.raises(ValueError):
        LinkIndex(index.store).update(gone)


def test_tasks_of_the_index_grow_in_number_with_the_words(spark, tmp_path, monkeypatch):
    """A bucket's postings are counted and written by several tasks where there are many words, and the index is the same."""
    from marlstone.operators import termindex

    rows = [(k, f"t{k}", [], "", " ".join(f"w{(k * j) % 37}" for j in range(1, 40))) for k in range(200)]
    pages = spark.createDataFrame(rows, "path long, title string, aliases array<string>, summary string, text string")
    held = {}
    for words in (1_000_000, 500):
        monkeypatch.setattr(termindex, "WORDS_PER_TASK", words)
        store = Store(spark, f"{tmp_path}/{words}", 2)
        index = termindex.TermIndex(store).update(pages, signature="a", whole=True)
        index.update(pages.where("path < 150"), signature="b", whole=True)
        files = spark.read.parquet(f"{tmp_path}/{words}/by_page").select("bucket", "_metadata.file_path").distinct()
        held[words] = (sorted(map(tuple, index.postings().collect())), max(r["count"] for r in files.groupBy("bucket").count().collect()))
    assert held[500][0] == held[1_000_000][0]
    assert held[500][1] > 4 >= held[1_000_000][1]
