from pyspark.sql import functions as F

from marlstone.operators import corpus, reports


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_sections_and_details(spark):
    kind = lambda h, b: one(spark, reports.section_kind(F.col("h"), F.col("b")), h=h, b=b)
    assert kind("Dead links [3]", ["x"]) == "deadLinks" and kind("Orphaned pages", ["x"]) == "orphan" and kind("Else", ["[[a]] → **b**", "[[c]] → **d**"]) == "deadLinks" and kind("Else", ["x"]) == "unknown"
    d = one(spark, reports.detail_row(F.col("v")), v=" - see [[a|b]]  now ")
    assert (d.is_bullet, d.text, d.links[0].path) == (True, "- see now", "a")


def test_history(spark):
    rows = [(i, k, f"Title {i}", "op", [f"p{i}"], ["line"]) for i, k in enumerate(["ingest", "fix", "ingest", "maintenance"])]
    df = spark.createDataFrame(rows, "pos int, kind string, title string, operation string, pages array<string>, details array<string>")
    shown, more = reports.history(df, kind="contradictions", limit=1)
    assert [r.pos for r in shown.collect()] == [2] and more.first().more == 1
    assert [r.pos for r in reports.history(df, search="P3")[0].collect()] == [3]
    assert one(spark, reports.shown_list(F.col("v"), 2), v=["a", "b", "c", "d"]) == ["a", "b", "… 2 more"]


def test_report(spark):
    findings = spark.createDataFrame([("dead", "a", ""), ("orphan", "c", "")], ["kind", "path", "detail"])
    counts = reports.report_counts(reports.lint_report(findings, spark.createDataFrame([("a", "b")], ["target", "source"])))
    assert sorted(map(tuple, counts.collect())) == [("dead", 1, 1), ("orphan", 1, 0)]


def test_replies(spark):
    got = one(spark, reports.parse_reply(F.col("v"), "keywords"), v='```json\n{"keywords": ["A b", "a B", "one two three four five six"]}\n```')
    assert one(spark, reports.keywords(F.col("v")), v=got.keywords) == ["A b"]
    verdicts = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "zz")], ["target", "source"])
    assert [tuple(r) for r in reports.verdict_pairs(verdicts, spark.createDataFrame([("a",), ("b",)], ["path"])).collect()] == [("a", "b")]
    assert one(spark, reports.ordered_union(F.col("a"), F.lit("X")), a=["x"]) == ["x"]


def test_related(spark):
    items = spark.createDataFrame([("s", 0, "Alpha", ["Beta", "Page One", "Nowhere"]), ("s", 1, "Beta", ["beta"]), ("s", 2, "Gamma", [])], "source string, pos int, name string, related array<string>")
    pages = spark.createDataFrame([("p1", "page one")], ["path", "title"])
    got = {(r.name, r.related, r.how) for r in reports.related_names(items, pages).collect()}
    assert got == {("Alpha", "Beta", "item"), ("Alpha", "p1", "page"), ("Alpha", "Nowhere", "unanswered"), ("Beta", "Alpha", "sibling"), ("Beta", "Gamma", "sibling"), ("Gamma", "Beta", "sibling"), ("Gamma", "Alpha", "sibling")}


def test_grid(spark):
    refs = spark.createDataFrame([("a", "cat", "dog dog"), ("b", "bird", "cat cat cat")], ["path", "title", "text"]).withColumn("aliases", F.array().cast("array<string>")).withColumn("summary", F.lit(""))
    grid = reports.weight_grid(corpus.field_terms(refs), spark.createDataFrame([("q", "cat", 1.0)], ["query_id", "term", "weight"]), spark.createDataFrame([("q", "a")], ["query_id", "path"]), {"title": (0.1, 3.0)})
    assert grid[0][0]["title"] == 3.0 and grid[0][1] == 1.0 and grid[-1][1] == 0.5
