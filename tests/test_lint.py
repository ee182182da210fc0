"""Code masks and short quotes against plain loops, on random texts."""

import random
import re

from pyspark.sql import functions as F

from marlstone.functions.text import normalize_quote
from marlstone.operators import corpus, lint


def masked(content):
    inside, out = False, []
    for line in content.split("\n"):
        fence = re.match(r"[ \t\x0b\f\r]*(```|~~~)", line)
        inside = inside != bool(fence)
        out.append(" " * len(line) if fence or inside else re.sub(r"`[^`]*`", lambda m: " " * len(m[0]), line))
    return "\n".join(out)


def test_code_is_blanked_as_by_a_loop_over_lines(spark):
    rng = random.Random(3)
    bits = ["`", "``", "```", "\n", "\n```", "\n  ~~~x\n", "[[a]]", " ", "é😀", "\t", "x ``` y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(500)] + ["```", "a `b` c `[[d]]` e ` f", "\n\n", ""]
    got = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string").select("id", lint.mask_code(F.col("t"))).collect()
    assert [r[1] for r in sorted(got)] == [masked(t) for t in texts] + [None]


def test_a_page_of_many_lines_is_masked_whole(spark):
    text = "```\n[[in]]\n```\n`a` [[out]] `[[b]]`\n" * 20_000
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_count(lint.mask_code(F.col("t")), F.lit(r"\[\[(out)\]\]")), F.regexp_count(lint.mask_code(F.col("t")), F.lit(r"\[\["))).first()
    assert tuple(got) == (20_000, 20_000)


def test_short_quotes_meet_the_sources_that_contain_them(spark):
    rng = random.Random(8)
    words = ["ab", "abc", "b", "cab", "bca", "aé", "abcab"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    quotes = spark.createDataFrame([(i, say(rng.randrange(1, 4))) for i in range(60)] + [(98, ""), (99, None)], "quote_id int, quote string")
    sources = spark.createDataFrame([(i, say(rng.randrange(6))) for i in range(40)] + [(99, None)], "source_id int, body string")
    folds = lambda df, k, c: [(r[0], r[1]) for r in df.select(k, normalize_quote(F.col(c))).collect()]
    want = {(q, s) for q, x in folds(quotes, "quote_id", "quote") for s, b in folds(sources, "source_id", "body") if x and b and x in b}
    got = [tuple(r) for r in lint.grounded(quotes, sources).collect()]
    assert set(got) == want and len(got) == len(want)
    assert "CartesianProduct" not in lint.grounded(quotes, sources)._jdf.queryExecution().toString()


def test_posting_blocks_are_the_inverted_index_in_rows_of_bounded_size(spark):
    posted = spark.createDataFrame([(f"p{i}", t) for i in range(300) for t in ("all", f"t{i % 7}")], "path string, term string")
    blocks = corpus.posting_blocks(posted, 20).collect()
    assert max(len(r.paths) for r in blocks) <= 60 and len({r.block for r in blocks}) == 15
    joined = {}
    for r in blocks:
        joined.setdefault(r.term, []).extend(r.paths)
    assert {t: sorted(p) for t, p in joined.items()} == {r.term: r.paths for r in corpus.inverted_index(posted).collect()}
    assert corpus.posting_blocks(posted.limit(0)).count() == 0
