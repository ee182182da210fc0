import pytest
from pyspark.sql import functions as F

from marlstone.functions import text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("value,terms", [
    ("Hello, World-2!", ["hello", "world", "2"]), ("Über naïve", ["über", "naïve"]), ("日本語 text", ["日本", "本語", "text"]), ("中", ["中"]),
    ("ab中国cd", ["ab", "中国", "cd"]), ("ひらがな", ["ひら", "らが", "がな"]), ("한국어", ["한국", "국어"]), ("ไทย", ["ไท", "ทย"]), ("", []), ("--", []),
])
def test_segment(spark, value, terms):
    assert one(spark, text.segment(F.col("v")), v=value) == terms


def test_word_grams(spark):
    assert one(spark, text.word_grams(F.col("v")), v="crème") == ["cre", "rem", "eme"]
    assert one(spark, text.word_grams(F.col("v")), v="ab") == [] and one(spark, text.word_grams(F.col("v")), v="日本語") == []
    assert one(spark, text.word_grams(F.col("v")), v="aaaa") == ["aaa"]


def test_tokenize_query(spark):
    assert one(spark, text.tokenize_query(F.col("v")), v="What is (state-of-the-art) AI? 机器学习") == ["what", "is", "state", "of", "the", "art", "ai", "state-of-the-art", "机器学习"]
    assert one(spark, text.lexically_reliable(F.col("v")), v=["ab", "cd", "e"]) and not one(spark, text.lexically_reliable(F.col("v")), v=["ab", "c"])


def test_needles(spark):
    hit = lambda t, n: one(spark, text.needle_hits(F.col("t"), F.col("n")), t=t, n=n)
    assert hit("the category", "cat") and not hit("the concat", "cat") and hit("x 机器学习", "器学") and hit("c++ code", "c++")
    assert one(spark, text.cjk_pair_overlap(F.col("t"), F.col("n")), t="机器和学习", n="机器学习") == 2


@pytest.mark.parametrize("value,slug", [(" Hello World ", "hello-world"), ("A.B  c", "a-b-c"), ("a/b:c?", "abc"), ("", "untitled"), ("--x--", "x"), ("中文，名", "中文名")])
def test_slug(spark, value, slug):
    assert one(spark, text.slug(F.col("v")), v=value) == slug


def test_blank_slug_is_the_same_every_time(spark):
    a, b = (one(spark, text.slug(F.col("v")), v="???") for _ in range(2))
    assert a == b and a.startswith("untitled-")


def fnv(s):
    h = 2166136261
    data = s.encode("utf-16-le")
    for k in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[k : k + 2], "little")) * 16777619 % 2**32
    return f"{h:08x}"


@pytest.mark.parametrize("value", ["", "abc", "ünïcode 日本", "emoji 🙂 x"])
def test_hashes(spark, value):
    assert one(spark, text.hex32(text.fnv1a(F.col("v"))), v=value) == fnv(value)
    folded = " ".join(value.split())
    if all(ord(c) < 65536 for c in folded):
        assert one(spark, text.body_hash(F.col("v")), v=f"  {value}\n") == f"{len(folded):x}-{fnv(folded)}"


def test_sets_and_estimates(spark):
    assert one(spark, text.bigram_set(F.col("v")), v="A-b c") == ["ab", "bc"]
    assert set(one(spark, text.body_word_set(F.col("v")), v="The quick, quick brown fox should run")) == {"quick", "brown"}
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, text.estimate_tokens(F.col("v")), v="日本語abc") == 4
    assert one(spark, text.normalize_quote(F.col("v")), v=" Don't  STOP, now! ") == "dont stop now"
    assert one(spark, text.link_reduced(F.col("v")), v="see [[a/b|shown]] and [[a/Name]]") == "see shown and Name"
    assert one(spark, text.name_variants(F.col("v")), v="World Health (WHO)") == ["World Health (WHO)", "World Health", "WHO"]
    assert one(spark, text.canonical_page_path(F.col("v")), v="./Wiki\\A//B.md") == "wiki/a/b"
    assert one(spark, text.context_around(F.col("t"), F.col("n"), 3), t="abcdefghij", n=["zz", "ef"]) == "bcdefghi"
    assert one(spark, text.vocabulary_csv(F.col("v")), v="A, b,a , ,B,c") == "A, b, c"
