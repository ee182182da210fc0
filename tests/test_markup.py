import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions import markup

PAGE = "---\ntype: entity\ncreated: 2024-01-02\nreviewed: true\naliases: [A, 'B c', ]\ntags:\n  - x/y\n  - \"z\"\nsources: one\nodd: kept\n  more: lines\n---\n\n# Title\nBody text.\n"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_front_matter(spark):
    x = one(spark, markup.front_matter(F.col("v")), v=PAGE)
    assert (x.type, x.created, x.updated, x.reviewed, x.aliases, x.tags, x.sources) == ("entity", "2024-01-02", None, True, ["A", "B c"], ["x/y", "z"], ["one"])
    assert x.extra["odd"] == "kept"
    assert markup.parse_front("no block") is None and markup.parse_front("---\naliases:\n---\n") == {"aliases": []}
    assert markup.passed_lines(PAGE) == ["odd: kept", "  more: lines"]
    assert markup.render_front(markup.parse_front(PAGE), markup.passed_lines(PAGE)).split("\n")[:5] == ["---", "type: entity", "created: 2024-01-02", "odd: kept", "  more: lines"]
    assert markup.parse_front(markup.render_front(markup.parse_front(PAGE)))["aliases"] == ["A", "B c"]


def test_bodies(spark):
    assert one(spark, markup.body(F.col("v")), v=PAGE) == "# Title\nBody text."
    assert one(spark, markup.body(F.col("v")), v="plain") == "plain" and one(spark, markup.is_blank(F.col("v")), v="---\na: b\n---\n \n")
    assert one(spark, markup.repaired_opening(F.col("v")), v="\n----- \ntype: x\n---").startswith("---\ntype")
    assert one(spark, markup.repaired_opening(F.col("v")), v="-- \nnot a key\n") == "-- \nnot a key\n"
    assert one(spark, markup.folded_union(F.col("a"), F.col("b")), a=["Tag"], b=["tag", "New"]) == ["Tag", "New"]


def test_links_and_sections(spark):
    x = one(spark, markup.links(F.col("v")), v="[[a/b|Shown]] and [[c#part]] and [[ d ]]")
    assert [(i.path, i.alias) for i in x] == [("a/b", "Shown"), ("c", None), ("d", None)]
    text = "# T\n\n## Mentions\n- \"One quote\" — [[sources/s1]]\n- \"Two\" (zwei)\n\n## Other\nx"
    block = one(spark, markup.section(F.col("v"), "Mentions"), v=text)
    got = spark.createDataFrame([(block,)], ["b"]).select(markup.mentions("b").alias("m")).first().m
    assert [(m.quote, m.translation, m.source_path) for m in got] == [("One quote", None, "sources/s1"), ("Two", "zwei", None)]
    assert "Mentions" not in one(spark, markup.without_section(F.col("v"), "Mentions"), v=text)
    snap = lambda h: one(spark, markup.snap_header(F.col("v"), ["Related Entities", "Related Concepts", "Summary"]), v=h)
    assert (snap("Summary"), snap("Sumary"), snap("Nothing like it")) == ("Summary", "Summary", None)


def test_summary():
    text = "## Summary\nFirst [[a/b]] sentence. Second one is longer. Third.\n## Next\nx"
    assert markup.summary_of(text, ["Description", "Summary"], 100).startswith("First b sentence. Second")
    assert markup.summary_of(text, ["Summary"], 25) == "First b sentence." and markup.summary_of(text, ["None"], 9) == ""


def test_log(spark):
    lines = ["# Log", "## [2024-05-01 10:00] ingest | Note A · 12m30s · 4.2 KB", "- Created: [[x]]", "## [2024-05-02] Wiki Maintenance", "> 12 pages, 3 dead links", "## [2024-05-03] lint fix", "x", "## [2024-05-04] renamed"]
    rows = markup.log_entries(spark.createDataFrame(list(enumerate(lines)), ["pos", "line"])).orderBy("entry").collect()
    assert [(r.date, r.time, r.kind) for r in rows] == [(datetime.date(2024, 5, 1), "10:00", "ingest"), (datetime.date(2024, 5, 2), None, "maintenance"), (datetime.date(2024, 5, 3), None, "fix"), (datetime.date(2024, 5, 4), None, "other")]
    assert rows[0].title.startswith("Note A")
    k = one(spark, markup.kpis(F.col("v")), v="12 pages, 3 dead links, 1 orphan")
    assert (k.total_pages, k.dead_links, k.orphans, k.duplicates) == (12, 3, 1, None)
    m = one(spark, markup.ingest_metrics(F.col("v")), v="12m30s · 4.2 KB · some-model")
    assert (m.seconds, m.bytes, m.model) == (750, 4301, "some-model")


@pytest.mark.parametrize("reply,outcome,value", [
    ('{"a": 1}', "ok", {"a": 1}), ('<think>x</think>```json\n{"a": [1, 2]}\n```', "ok", {"a": [1, 2]}), ('text {"a": {"b": "c', "repaired", {"a": {"b": "c"}}), ('{"a": [1, 2,]}', "repaired", {"a": [1, 2]}),
    ("", "empty", None), ("no object", "malformed", None), ("{a: 1}", "malformed", None),
])
def test_salvage(reply, outcome, value):
    assert markup.salvage_json(reply) == (outcome, value)


def test_diff_and_loops():
    assert markup.line_diff("a\nb\nc", "a\nx\nc") == [("eq", "a"), ("del", "b"), ("add", "x"), ("eq", "c")] or markup.line_diff("a\nb\nc", "a\nx\nc") == [("eq", "a"), ("add", "x"), ("del", "b"), ("eq", "c")]
    assert [x for o, x in markup.line_diff("a\nb", "b\nc") if o != "del"] == ["b", "c"]
    loop = markup.repetition_loop("start " + "again and " * 30)
    assert loop["chars"] >= 200 and markup.repetition_loop("short short short short") is None and markup.repetition_loop("-- -- " * 80) is None


def test_replies(spark):
    assert one(spark, markup.cleaned_reply(F.col("v")), v="<think>no</think>Sure!\n\n# Title\ntext") == "# Title\ntext"
    assert one(spark, markup.fill(F.col("t"), F.create_map(F.lit("a"), F.lit("1"))), t="{{a}} {{b}}") == "1 {{b}}"
    assert markup.numbered_citations("x [[p]] y [[q|Q]] z [[p]]") == ("x [[p]][1] y [[q|Q]][2] z [[p]][1]", ["p", "q"])
    assert markup.heading_spacing("# A\ntext\n\n\n\nmore") == "# A\n\ntext\n\nmore"


def test_index_lines(spark):
    lines = ["# Index", "- [[entities/Foo|Foo]] `aliases: F, Fo` `source: s-1` - A summary", "- [[concepts/Bar]]", "text"]
    rows = markup.index_lines(spark.createDataFrame([(x,) for x in lines], ["line"])).collect()
    assert [tuple(r) for r in rows] == [("entities/Foo", "Foo", ["F", "Fo"], "s-1", "A summary"), ("concepts/Bar", "Bar", [], None, "")]
