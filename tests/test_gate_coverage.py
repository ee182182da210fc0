import random

from pyspark.sql import functions as F

from marlstone.operators import termindex
from marlstone.sources.versioned import Store


def test_best_coverage_is_the_best_of_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(termindex, "SETS_PER_TASK", 7)
    monkeypatch.setattr(termindex, "QUERIES_PER_TASK", 3)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(15)] + ["étage", "only"]
    say = lambda n, of: " ".join(rng.choice(of) for _ in range(rng.randrange(n)))
    pages = [(p, say(5, words[:-1]), [], None, "only " + say(9, words)) for p in range(40)] + [(40 + p, "w1 w2", ["w3"], None, None) for p in range(6)]
    index = termindex.TermIndex(Store(spark, f"{tmp_path}/index", 2)).update(
        spark.createDataFrame(pages, "path long, title string, aliases array<string>, summary string, text string"), signature="a", whole=True
    )
    asked = [(q, t) for q in range(8) for t in rng.sample([*words, "unknown"], 4)] + [(8, "unknown"), (9, "only"), (None, "w1"), (0, "w1"), (0, "w1")]
    queries = spark.createDataFrame(asked, "query_id long, term string")
    pairs = index.name_coverage(queries).groupBy("query_id").agg(F.max("coverage").alias("coverage"), F.count("*").alias("hits")).where("query_id IS NOT NULL")
    told = lambda df: {r.query_id: (round(r.coverage, 12), r.hits) for r in df.collect()}
    got = told(index.best_coverage(queries.where("query_id IS NOT NULL")))
    assert got == told(pairs) and 8 not in got and 9 not in got
