from pyspark.sql import functions as F

from marlstone.functions import markup
from marlstone.operators import cascade, graph, pages, retrieval


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_sources(spark):
    got = one(spark, pages.source_list(F.col("v"), "wiki"), v=["[[wiki/sources/a|A]]", "sources/a.md", "Notes/My Note.md", "[[]]", "entities/x"])
    assert got == ["[[sources/a]]", "[[sources/My-Note]]", "[[entities/x]]"]
    assert one(spark, pages.polluted_sources(F.col("v"), "wiki"), v=["[[sources/a]]", "Note.md"]) and not one(spark, pages.polluted_sources(F.col("v"), "wiki"), v=["[[sources/a]]"])
    for bad in ("^[[src: [[n]]]", "[^src: [[n]]]", "^[[src: n]]", "[[src: [[n]]]]", "[[src: n]]^"):
        assert one(spark, pages.provenance_marks(F.col("v")), v=f"x {bad} y").startswith("x ^[src: [[n]]]"), bad


def test_vocabularies(spark):
    rows = spark.createDataFrame([("a", 0, ["Field/Bio", "x"]), ("b", 1, ["field/bio", "Area/Chem"])], ["path", "pos", "tags"])
    vocab = pages.vocabulary(rows, slashed=True)
    assert sorted(r.tag for r in vocab.collect()) == ["Area/Chem", "Field/Bio"]
    chosen = spark.createDataFrame([(1, "FIELD/BIO"), (1, "chem"), (1, "none")], ["id", "tag"])
    assert sorted((r.tag, r.domain) for r in pages.select_domains(chosen, vocab).collect()) == [("FIELD/BIO", "Field/Bio"), ("chem", "Area/Chem"), ("none", None)]
    folded = pages.fold_to_vocabulary(spark.createDataFrame([("café",), ("tea",)], ["value"]), spark.createDataFrame([("Cafe",)], ["tag"]))
    assert {r.value: r.tag for r in folded.collect()} == {"café": "Cafe", "tea": None}


def test_dead_link_repair_and_retarget(spark):
    all_pages = spark.createDataFrame([("entities/Foo", "Foo", ["Fu"], 0), ("entities/Big-Bar", "Big Bar", [], 1), ("concepts/Foo", "foo", [], 2)], "path string, title string, aliases array<string>, pos int")
    dead = spark.createDataFrame([("x", "x/foo"), ("entities/Foo", "Foo"), ("x", "fu"), ("x", "big.bar"), ("x", "none")], ["source", "target"])
    got = {(r.source, r.target): r.path for r in pages.dead_link_targets(dead, all_pages).collect()}
    assert got == {("x", "x/foo"): "entities/Foo", ("entities/Foo", "Foo"): "concepts/Foo", ("x", "fu"): "entities/Foo", ("x", "big.bar"): "entities/Big-Bar", ("x", "none"): None}
    texts = spark.createDataFrame([("p", "see [[Old#h|shown]] and [[Other]]"), ("q", "nothing")], ["path", "content"])
    moved = {r.path: (r.content, r.moved) for r in pages.retarget_pages(texts, spark.createDataFrame([("Old", "entities/New")], ["old", "new"])).collect()}
    assert moved == {"p": ("see [[entities/New#h|shown]] and [[Other]]", 1), "q": ("nothing", 0)}


def test_sections():
    labels = ["Summary", "Related Pages"]
    assert pages.canonical_headers("## Sumary (x)\na\n## Else\nb\n", labels) == "## Summary (x)\na\n## Else\nb\n"
    assert pages.known_sections("top\n## Sumary\na\n## Else\nb\n", labels) == "top\n## Sumary\na\n"
    old = "# T\n\n## Summary\n" + "long text " * 50 + "\n\n## Related Pages\n- [[a]]\n"
    kept = pages.preserve_sections(old, "# T\n\n## Summary\nshort\n", labels)
    assert "long text" in kept and "- [[a]]" in kept and "short" not in kept
    assert pages.first_heading_kept("---\nx: y\n---\n# Old\n", "text") == "# Old\n\ntext" and pages.first_heading_kept("# Old", "# New\nx") == "# Old\nx"
    was = "## A\nFirst plain one.\n\nSomething sourced by another note here ^[s: [[sources/b]]]\n"
    assert "another note here" in pages.preserve_paragraphs(was, "## A\nFirst plain one.\n", "sources/a")
    assert "another note here" not in pages.preserve_paragraphs(was, "## A\nFirst plain one.\n", "sources/b")


def test_mentions_and_front(spark):
    rows = spark.createDataFrame([("p", "b quote", "s2", 2), ("p", "a quote", "s1", 1), ("p", "a quote", "s3", 3), ("p", "c" * 600, "s4", 4)], ["page", "quote", "path", "at"])
    assert pages.mentions_block(rows).first().block == '- "a quote" — [[s1]]\n- "b quote" — [[s2]]'
    old = spark.createDataFrame([("p", "---\ntype: entity\ncreated: 2020-01-01\nsources: ['[[s1]]']\ntags: [A]\n---\n")], ["path", "c"]).select("path", markup.front_matter("c").alias("fm"))
    new = pages.merge_front(old, spark.createDataFrame([("p", "s2", ["a", "b"])], ["path", "source", "tags"]), F.lit("2024-05-05")).first().fm
    assert (new.sources, new.tags, new.created, new.updated) == (["[[s1]]", "[[s2]]"], ["A", "b"], "2020-01-01", "2024-05-05")


def test_usage_and_history(spark):
    calls = pages.usage(spark.createDataFrame([("a", 5), ("a", 7), (None, 1)], "task string, millis int"))
    assert sorted(map(tuple, calls.collect())) == [("a", 2, 12), ("untagged", 1, 1)]
    assert [tuple(r) for r in pages.usage_since(calls, spark.createDataFrame([("a", 1, 5)], ["task", "calls", "millis"])).collect()] == [("a", 1, 7), ("untagged", 1, 1)]
    told = spark.createDataFrame([("[[old/entities/x]] [[wiki/concepts/y]]",)], ["text"])
    assert pages.stale_folders(told, "wiki").first().folders == ["old", "wiki"] and pages.stale_folders(told.where("false"), "wiki").collect() == []


def test_cascade(spark):
    refs = spark.createDataFrame([("a", "alpha beta", "s1"), ("b", "beta", "s1"), ("c", "gamma", None), ("d", "delta", None)], "path string, text string, source_slug string")
    edges = spark.createDataFrame([("a", "c"), ("c", "d"), ("b", "a")], ["src", "dst"])
    lexical = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], ["query_id", "path", "rank"])
    cover = spark.createDataFrame([("q", p, 0.9) for p in "abc"], ["query_id", "path", "coverage"])
    tokens = spark.createDataFrame([("q", ["alpha", "beta"])], ["query_id", "tokens"])
    seeds = cascade.choose_seeds(lexical, cover, tokens)
    assert [(r.path, r.label) for r in seeds.orderBy("place").collect()] == [("a", "lexical"), ("b", "lexical")]
    ranked = cascade.rank_pages(lexical, seeds, refs, edges, is_mature=False)
    rows = ranked.orderBy("pick").collect()
    assert {rows[0].path, rows[1].path} == {"a", "b"} and {r.path for r in rows} == set("abcd") and rows[0].arm == "lex-seeded-ppr"
    texts = cascade.page_texts(ranked, refs, spark.createDataFrame([("q", ["beta"])], ["query_id", "terms"]))
    packed = cascade.contexts(texts).first()
    assert packed.pages == 4 and "alpha beta" in packed.context
    assert graph.mature(refs.select(F.col("path").alias("node")), edges).first().mature is False
    assert retrieval.budget_prefix(spark.createDataFrame([("q", 1, 10.0), ("q", 2, 1.0)], ["query_id", "rank", "cost"]), 5).count() == 1


def test_matched_paragraphs(spark):
    body = "# T\n\n## Summary\n\nbeta in summary\n\n## Else\n\nno hit\n\nbeta one\n\nbeta two is long enough to be cut somewhere"
    bodies = spark.createDataFrame([("q", "p", body)], ["query_id", "path", "text"])
    terms = spark.createDataFrame([("q", ["Beta"])], ["query_id", "terms"])
    assert cascade.matched_paragraphs(bodies, terms, 40, ("summary",)).first().text == "beta one\n\nbeta two is long enough to be "[:10] + "beta two is long enough to be "


def test_related_lines():
    text = "# T\n## Related\n- [[wiki/a|A]]\n- [[b]]\n## Else\n- [[a]]\n"
    assert pages.without_related(text, {"a"}) == ("# T\n## Related\n- [[b]]\n## Else\n- [[a]]\n", 1)
    assert pages.related_section("# T\n\n## R\n- [[x/A]]\n\n## Z\nq\n", "R", ["a", "B"], 5) == "# T\n\n## R\n- [[x/A]]\n- [[B]]\n\n## Z\nq\n"
    assert pages.related_section("# T\n", "R", ["B", "C"], 1) == "# T\n\n## R\n- [[B]]\n"


def test_constraints_and_restores(spark):
    front = "---\ntype: x\ncreated: soon\ntags: [A, a, B]\naliases: [ok, z]\n---\n"
    df = spark.createDataFrame([(front,), (front.replace("type: x", "type: x\nreviewed: true"),)], ["c"]).select(markup.front_matter("c").alias("fm"))
    plain, reviewed = (r.f for r in df.select(pages.constrained(F.col("fm"), "entity", ["A"], F.lit("2024-01-01")).alias("f")).collect())
    assert (plain.type, plain.tags, plain.aliases, plain.created, plain.updated) == ("entity", ["A"], ["ok"], "2024-01-01", "2024-01-01")
    assert (reviewed.type, reviewed.tags, reviewed.updated) == ("x", ["A", "a", "B"], "2024-01-01")
    links = spark.createDataFrame([("s", "e/Foo", "Foo"), ("s", "e/Foo", "other"), ("s", "c/Bar", "Bar")], ["source", "target", "display"])
    known = spark.createDataFrame([("e/Foo", "Foo"), ("c/Bar", "Bar"), ("e/Bar", "Bar")], ["path", "title"])
    assert [r.display for r in pages.display_restores(links, known).collect()] == ["Foo"]
