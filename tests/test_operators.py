import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import dedup, evaluation, graph, lint, retrieval, upkeep
from marlstone.sources import wiki
from marlstone.streaming import watch


def test_links_resolve_by_path_raw_path_and_last_name(spark):
    pages = [("entities/dog", "[[wiki/entities/cat|Cat]] [[cat]] [[entities/dog]] [[gone]] [[fish#part]]", 0), ("entities/cat", "", 1), ("concepts/fish", "[[dog]]", 2), ("notes/fish", "", 3)]
    edges = graph.resolve_links(spark.createDataFrame(pages, ["path", "content", "pos"])).collect()
    assert sorted((e.src, e.dst) for e in edges) == [("concepts/fish", "entities/dog"), ("entities/dog", "entities/cat"), ("entities/dog", "notes/fish")]


def test_pagerank_sums_to_one_and_prefers_near_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], ["src", "dst"])
    rows = graph.personalised_pagerank(edges, spark.createDataFrame([("a",)], ["seed"])).collect()
    score = {r.node: r.score for r in rows}
    assert sum(score.values()) == pytest.approx(1) and score["a"] > score["b"] > score["c"] > score["d"]


def test_clustering_of_a_triangle_with_a_tail(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], ["src", "dst"])
    got = {r.node: (r.degree, round(r.clustering, 3)) for r in graph.clustering(edges).collect()}
    assert got == {"a": (2, 1.0), "b": (2, 1.0), "c": (3, 0.333), "d": (1, 0.0)}


def test_co_citation_leaves_out_linked_and_same_source_pages(spark):
    edges = [("x", "t1"), ("x", "t2"), ("y", "t1"), ("y", "t2"), ("z", "t1"), ("z", "t2"), ("x", "z"), ("w", "t1"), ("w", "t2"), ("x", "sources/s"), ("w", "sources/s"), ("v", "t1")]
    found = graph.co_citation(spark.createDataFrame(edges, ["src", "dst"]), spark.createDataFrame([("x",)], ["self"]))
    assert [(r.candidate, r.shared) for r in found.collect()] == [("y", 2)]


def test_similar_sets_match_all_pairs(spark):
    rng = random.Random(1)
    sets = [(i, sorted({rng.randrange(40) for _ in range(rng.randrange(1, 15))})) for i in range(80)]
    got = {(r.a, r.b) for r in dedup.similar_sets(spark.createDataFrame(sets, "id int, items array<int>"), 0.5).collect()}
    assert got == {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5}


def test_unlike_sets_that_share_a_rare_item_are_not_compared(spark, monkeypatch):
    rng = random.Random(2)
    sets = [(i, [1000 + i // 2, *rng.sample(range(200), 40)]) for i in range(60)]  # each two share an item that no others have
    frame = spark.createDataFrame(sets, "id int, items array<int>")
    monkeypatch.setattr(dedup, "jaccard", lambda a, b: F.raise_error(F.lit("compared")).cast("double"))
    assert dedup.similar_sets(frame, 0.8).count() == 0


def test_similar_sets_of_all_sizes(spark):
    """Sets on both sides of every bound of the sketches, each with a copy that is just like enough and one that is not."""
    sets = []
    for n in (1, 2, 9, 55, 63, 64, 70, 255, 256, 799, 800, 810, 3199, 3300, 4100):
        own = [n * 10_000 + k for k in range(n)]
        sets += [own, own[: -(-4 * n // 5)], own[: 4 * n // 5 - 1] + [-n]]
    sets = [(i, s) for i, s in enumerate(sets) if s]
    got = {(r.a, r.b) for r in dedup.similar_sets(spark.createDataFrame(sets, "id int, items array<int>"), 0.8).collect()}
    assert got == {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}


def test_duplicate_signals(spark):
    none = []
    page = lambda p, t, al=none, links=none, words=none, fp="", inc=none: (p, t, al, links, words, fp, inc)
    pages = [
        page("w/entities/a", "Neural Network"), page("w/entities/b", "neural network"), page("w/concepts/c", "Neural Net"), page("w/sources/d", "Neural Networks"),
        page("w/entities/e", "Zeta", ["Eta"], ["k1", "k2"], ["body", "word"]), page("w/entities/f", "Yotta", ["zeta"], ["k1", "k2"], ["body", "word"]),
        page("w/entities/g", "Mono", fp="h1", inc=["s1"]), page("w/entities/h", "Moto", fp="h1", inc=["s1"]),
    ]
    df = spark.createDataFrame(pages, "path string, title string, aliases array<string>, links array<string>, body_words array<string>, fingerprint string, incoming array<string>")
    got = {(r.target[-1], r.source[-1]): (r.signal, round(r.score, 2)) for r in dedup.duplicate_candidates(df).collect()}
    assert got[("a", "b")] == ("crossLang", 1.0) and got[("e", "f")] == ("crossLang", 1.0) and got[("g", "h")] == ("sourceFingerprint", 1.0)
    assert ("a", "d") not in got and got[("c", "a")][0] == "bigram"


def test_coverage_without_penalty_is_a_sort(spark):
    rng = random.Random(2)
    rows = [(1, f"k{i}", round(rng.random(), 3), rng.randrange(2), rng.choice(["s", "t", None]), i) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id int, key string, score double, tier int, source_slug string, place int")
    got = [r.key for r in retrieval.coverage_pick(df, 40).orderBy("pick").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (r[3], -r[2], r[5]))]
    remaining, taken, want = list(sorted(rows, key=lambda r: (r[3], -r[2], r[5]))), {}, []
    while remaining:
        low = remaining[0][3]
        best = max((r for r in remaining if r[3] == low), key=lambda r: (r[2] / (1 + 0.5 * taken.get(r[4], 0) if r[4] else 1), r[2], -r[5]))
        remaining.remove(best)
        taken[best[4]] = taken.get(best[4], 0) + 1
        want.append(best[1])
    assert [r.key for r in retrieval.coverage_pick(df, 40, 0.5).orderBy("pick").collect()] == want


def test_lint_rules(spark):
    code = "text [[a]]\n```\n[[b]]\n```\n`[[c]]` and [[My Page]]\n"
    pages = spark.createDataFrame([("wiki/p.md", code)], ["path", "content"])
    links = lint.page_links(pages)
    assert {r.target for r in links.collect()} == {"a", "My Page"}
    known = lint.known_targets(spark.createDataFrame([("wiki/My-Page.md",)], ["path"]))
    assert {r.target for r in known.collect()} >= {"wiki/My-Page", "My-Page.md", "my-page"}
    assert [r.target for r in lint.dead_links(links, known).collect()] == ["a"]
    files = spark.createDataFrame([("wiki/a.md", ["Ay"], False), ("wiki/b.md", [], False), ("wiki/c.md", [], True)], "path string, aliases array<string>, stub boolean")
    named = spark.createDataFrame([("x", "ay")], ["source", "target"])
    assert [r.path for r in lint.orphans(files, named).collect()] == ["wiki/b.md"]
    fixed, n = lint.nested_links(F.col("v"))
    assert tuple(spark.createDataFrame([("[[[[a|b]]]] [[[[c]]]]",)], ["v"]).select(fixed, n).first()) == ("[[a|b]] [[c]]", 2)
    assert [r.clean_title for r in lint.polluted_titles(spark.createDataFrame([("p", "entities狗"), ("q", "entities-x")], ["path", "title"])).collect()] == ["狗"]


def test_drift(spark):
    from marlstone.functions.text import body_hash, link_reduced

    notes = spark.createDataFrame([("n1", "same"), ("n2", "now [[x|word]]"), ("n3", "edited")], ["path", "content"])
    stored = spark.createDataFrame([("p1", "same", "same", ["n1"]), ("p2", "now word", "now word", ["n2"]), ("p3", "before", "before", ["n3"]), ("p4", "q", "q", ["gone"])], "path string, t string, l string, origins array<string>")
    pages = stored.select("path", body_hash(F.col("t")).alias("stored_hash"), body_hash(link_reduced(F.col("l"))).alias("stored_links_hash"), "origins")
    assert sorted((r.page, r.kind) for r in lint.source_drift(pages, notes).collect()) == [("p2", "links-only"), ("p3", "edited")]


def test_batch_merge(spark):
    rows = [("s", 0, 0, "A", ["alpha"], ["q1"]), ("s", 0, 1, "B", [], ["q2"]), ("s", 1, 0, " a ", [], ["q3"]), ("s", 1, 1, "Alpha", [], ["q4"]), ("s", 1, 2, "C", [], []), ("s", 2, 0, "D", [], [])]
    df = spark.createDataFrame(rows, "source string, batch int, pos int, name string, aliases array<string>, mentions array<string>")
    got = [(r.name, r.mentions) for r in upkeep.merge_batches(df, 3).orderBy("place").collect()]
    assert got == [("A", ["q1", "q3"]), ("B", ["q2"]), ("C", [])]


def test_convergence_and_trim(spark):
    df = spark.createDataFrame([("s", k, n) for k, n in enumerate([20, 9, 8, 3, 5])], "source string, batch int, raw int")
    assert [(r.batch, r["size"], r.stop) for r in upkeep.convergence(df).orderBy("batch").collect()] == [(0, 20, False), (1, 20, False), (2, 10, False), (3, 10, True)]
    old = spark.createDataFrame([("s", 0, 20, 20), ("s", 1, 19, 0), ("s", 2, 20, 20)], "source string, batch int, raw int, new int")
    assert [(r.batch, r["size"], r.stop) for r in upkeep.convergence(old).orderBy("batch").collect()] == [(0, 20, False), (1, 20, True)]
    lines = spark.createDataFrame(list(enumerate(["## one", "xxxxxxxx", "## two", "yyy"])), ["pos", "line"])
    assert [r.line for r in upkeep.trim_log(lines, 14).orderBy("pos").collect()] == ["## two", "yyy"]


def test_rate_limits(spark):
    df = spark.createDataFrame([("HTTP 429", "x"), ("Rate limit", "parse-failure"), ("boom", "x")], ["reason", "type"])
    assert [tuple(r) for r in upkeep.rate_limits(df, 4, 200).collect()] == [(1, 3, 400)]
    assert upkeep.rate_limits(df.where("reason = 'boom'"), 4, 50).collect() == []


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", p, k + 1) for k, p in enumerate("abcd")], ["query_id", "path", "rank"])
    truth = spark.createDataFrame([("q", "b"), ("q", "d"), ("q", "z")], ["query_id", "path"])
    r = evaluation.recall_and_rank(ranked, truth, 2).first()
    assert (r.relevant, round(r.recall, 3), r.reciprocal) == (3, 0.333, 0.5) and evaluation.inversions(ranked, truth).first().inversions == 3
    hits = spark.createDataFrame([(i % 7, i % 3 == 0) for i in range(60)], ["asker", "hit"]).withColumn("hit", F.col("hit").cast("int"))
    a, b = (tuple(evaluation.cluster_bootstrap(hits, 50).first()) for _ in range(2))
    assert a == b and a[1] <= a[0] <= a[2]


def test_wiki_scan_and_index(spark, tmp_path):
    (tmp_path / "wiki/entities").mkdir(parents=True)
    (tmp_path / "wiki/entities/Foo.md").write_text("---\ntype: entity\naliases: [F]\n---\n# Foo Title\nBODY\n")
    (tmp_path / "wiki/index.md").write_text("- [[entities/Foo|Foo]] - x\n")
    refs = wiki.page_refs(wiki.scan(spark, str(tmp_path)), "wiki").collect()
    assert [(r.path, r.title, r.display_title, r.aliases, r.text) for r in refs] == [("wiki/entities/Foo.md", "Foo", "Foo Title", ["F"], "# foo title\nbody")]
    assert [r.path for r in wiki.read_index(spark, str(tmp_path / "wiki/index.md")).collect()] == ["entities/Foo"]
    pages = spark.createDataFrame([("entities", "entities/Foo", "Foo", ["F"], "s", "Sum")], "folder string, path string, title string, aliases array<string>, source_slug string, summary string")
    wiki.write_index(pages, str(tmp_path / "out"))
    assert wiki.read_index(spark, str(tmp_path / "out")).first().source_slug == "s"


def test_images(spark):
    notes = spark.createDataFrame([("n", "![[a.png]] ![x](http://y/z.png) ![[a.png]] ![[b.txt]] ![[gone.png]] ![[big.png]]")], ["path", "content"])
    files = spark.createDataFrame([("a.png", 5), ("b.txt", 5), ("big.png", 50)], ["image", "bytes"])
    got = {(r.pos): r.reason for r in wiki.embedded_images(notes, files, 10).collect()}
    assert got == {0: None, 1: "remote", 2: "duplicate", 3: "unsupported", 4: "missing", 5: "oversized"}
    sizes = spark.createDataFrame([("s", k, b) for k, b in enumerate([4, 4, 4, 20, 1])], ["source", "pos", "bytes"])
    assert [r.package for r in wiki.image_packages(sizes, 10, 2).orderBy("pos").collect()] == [0, 0, 1, 2, 3]


def test_capped_runs():
    assert watch.capped_runs([0, 4000, 8000, 20000, 24900], 5000, 60000) == [0, 0, 0, 1, 1]
    assert watch.capped_runs(list(range(0, 70000, 4000)), 5000, 60000)[-3:] == [1, 1, 1]


def test_a_dropped_event_renews_nothing(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0, t0 + dt.timedelta(minutes=5 * k)) for k in range(13)] + [("b", t0, t0), ("a", None, t0), (None, t0, t0), (None, t0, t0)]
    kept = watch.drop_repeats(spark.createDataFrame(rows, "path string, mtime timestamp, at timestamp")).collect()
    assert sorted((r.at - t0).seconds // 60 for r in kept if r.path == "a" and r.mtime) == [0, 10, 20, 30, 40, 50, 60] and len(kept) == 10


def test_streams_match_finite_forms(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"p{i % 3}", t0, t0 + dt.timedelta(seconds=s), "f") for i, s in enumerate([0, 1, 2, 3, 10, 11, 700, 2000])]
    schema = "path string, mtime timestamp, at timestamp, folder string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    finite = spark.read.parquet(str(tmp_path / "in"))
    kept = drain(watch.drop_repeats(stream), "kept")
    assert sorted(map(tuple, watch.drop_repeats(finite).collect())) == sorted(map(tuple, kept)) and {r.path for r in kept} == {"p0", "p1", "p2"}
    for df, name in ((stream, "every"), (finite, None)):
        once = watch.drop_repeats(df.selectExpr("path", "mtime", "at", "folder"), 2)
        got = drain(once, name) if name else once.collect()
        assert sorted((r.at - t0).seconds for r in got) == [0, 1, 2, 3, 10, 11, 700, 2000]
    batches = drain(watch.quiet_batches(stream, by="folder"), "batches")
    assert {(r.start, r.events) for r in batches} <= {(r.start, r.events) for r in watch.quiet_batches(finite, by="folder").collect()} and len(batches) >= 3
    seen = []
    q = watch.run_batches(stream, lambda rows, k: seen.append(rows.count()), str(tmp_path / "each"))
    assert q.awaitTermination(120) and sum(seen) == len(rows)


def test_queue_and_schedule(spark):
    queue = spark.createDataFrame([("a", "running"), ("b", "failed")], ["path", "status"])
    fresh = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], ["path"])
    assert sorted(map(tuple, watch.enqueue(queue, fresh).collect())) == [("a", "running"), ("b", "pending"), ("c", "pending")]
    jobs = spark.createDataFrame([("lint", dt.datetime(2024, 1, 1)), ("new", dt.datetime(2024, 1, 9))], ["job", "at"])
    assert [r.job for r in watch.due(jobs, F.lit("2024-01-10").cast("timestamp"), "weekly").collect()] == ["lint"]


def test_needles_lie_where_they_are_and_blank_ones_nowhere(spark):
    import random

    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdé 🙂") for _ in range(n))
    texts = [(k // 2, say(rng.randrange(40))) for k in range(60)] + [(99, ""), (98, None)]
    pages = spark.createDataFrame(texts, "path int, text string").repartition(3)
    words = ["", "a", "é ", "🙂", "abc", "nothing here", *{t[:k] for _, t in texts if t for k in (1, 2, 4, 9)}]
    for asked in (words, [""], ["abcd"]):
        found = retrieval.substring_hits(pages, "text", spark.createDataFrame([(w,) for w in asked + asked[:1]], "word string"))
        assert sorted((r.path, r.word) for r in found.collect()) == sorted((p, w) for p, t in texts if t for w in set(asked) if w and w in t)


def test_many_needles_meet_few_rows(spark):
    """Ten thousand needles that begin alike: the pairs that are looked at are a small multiple of the hits."""
    pages = spark.range(2000).selectExpr("id AS path", "concat('the same start ', hash(id, 1), ' and ', hash(id, 2)) AS text")
    needles = spark.range(10_000).selectExpr("concat('the same start ', hash(id, 1)) AS word")
    assert retrieval.substring_hits(pages, "text", needles).count() == 2000


def test_components(spark, monkeypatch):
    import random

    rng = random.Random(2)
    rounds = []
    kept = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: (rounds.append(label), kept(df, label))[1])
    path = [(k, k + 1) for k in range(10_000)]
    rng.shuffle(path)
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "src long, dst long")).collect()}
    assert set(found.values()) == {0} and len(found) == 10_001 and len(rounds) < 2 * 20
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(70, 70), (None, 3), (80, 81), (80, 81)]
    parent = {n: n for e in edges if None not in e for n in e}
    for _ in parent:
        for a, b in (e for e in edges if None not in e):
            parent[a] = parent[b] = min(parent[a], parent[b])
    want = {n: p for n, p in parent.items() if any(n in e and e[0] != e[1] and None not in e for e in edges)}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    for first in (70, 80, edges[0][0]):
        got = {r.node for r in graph.weak_component(df, spark.createDataFrame([(first,)], "node long")).collect()}
        assert got == ({n for n, p in want.items() if p == want[first]} if first in want else {first})


def test_running_sums_over_ranges(spark):
    import random

    from marlstone.operators.running import numbered, running_sum

    rng = random.Random(1)
    rows = [(k, rng.randrange(5), rng.choice([None, 1, 7])) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, range int, addend int").repartition(5)
    got = {r.id: (r.place, r.upto) for r in running_sum(numbered(df, "place", F.col("range").desc(), "id", parts=7), "addend", "upto", F.col("range").desc(), "id", parts=3).collect()}
    total, want = 0, {}
    for place, (k, _, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v or 0
        want[k] = (place, total)
    assert got == want
    assert numbered(df.limit(0), "place", "id").collect() == []


def test_merge_chains_and_circles(spark):
    import random

    from marlstone.operators import merge

    rng = random.Random(3)
    cases = [[("a", "b", 1), ("b", "c", 1)], [("a", "b", 1), ("b", "a", 1)], [("z", "y", 1), ("y", "x", 1), ("x", "z", 2), ("q", "z", 1), ("q", "r", 0)], [("a", "a", 1)], []]
    cases.append([(f"n{k:03}", f"n{k + 1:03}", 1) for k in range(200)])
    cases.append([(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}", rng.randrange(3)) for _ in range(45)])
    for pairs in cases:
        best = {}
        for s, t, score in sorted(pairs, key=lambda p: (-p[2], p[1])):
            if s != t:
                best.setdefault(s, t)
        want = {}
        for s in best:
            seen, at = [s], best[s]
            while at in best and at not in seen:
                seen.append(at)
                at = best[at]
            end = min(seen[seen.index(at) :]) if at in seen else at
            if end != s:
                want[s] = end
        got = merge.redirects(spark.createDataFrame(pairs, "source string, target string, score int"))
        assert {r.source: r.target for r in got.collect()} == want
    moved = spark.createDataFrame([("a", "c"), ("b", "c")], "source string, target string")
    links = spark.createDataFrame([("x", "a"), ("x", "b"), ("a", "b"), ("c", "a"), ("a", "x"), ("x", "y")], "src string, dst string")
    assert sorted(tuple(r) for r in merge.redirect_links(links, moved).collect()) == [("c", "x"), ("x", "c"), ("x", "y")]


def test_co_citation_meets_by_pairs_of_targets(spark, monkeypatch):
    """Pages that share one target only never meet, and pages above the bound on listed pairs lose nobody."""
    import random

    rng = random.Random(4)
    links = {(f"n{rng.randrange(60)}", f"t{rng.randrange(25)}") for _ in range(260)} | {("n0", f"t{k}") for k in range(25)} | {("n1", f"t{k}") for k in range(0, 25, 2)}
    edges = spark.createDataFrame(sorted(links), "src string, dst string")
    targets = {s: {t for x, t in links if x == s} for s, _ in links}
    want = {(a, b): len(targets[a] & targets[b]) for a in targets for b in targets if a != b and len(targets[a] & targets[b]) >= 2}
    selves = edges.select(F.col("src").alias("self")).distinct()
    for bound in (64, 8, 0):
        monkeypatch.setattr(graph, "PAIRED_TARGETS", bound)
        assert {(r.self, r.candidate): r.shared for r in graph.co_citation(edges, selves).collect()} == want
    monkeypatch.setattr(graph, "PAIRED_TARGETS", 64)
    lone = spark.createDataFrame([(f"m{k}", "common") for k in range(50)] + [(f"m{k}", f"own{k}") for k in range(50)], "self string, target string")
    assert graph._two_shared(lone, lone.withColumnRenamed("self", "candidate")).count() == 0
