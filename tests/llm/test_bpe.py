import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlstone.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "  \n", "Hello World, it's A test", "a<|endoftext|>b <|startoftext|>", "é ü\x1cx\x1fy z", "x y z　w v\u0085u t",
    "é ́e", "İSTANBUL ΣΑΣ", "日本語 текст 🙂🙂", "don't we'll 12345 ___ --", "​zero​width", "﻿bom", "word" * 20000, "many words " * 50000,
]


def both(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, part int").repartition(3)
    out = bpe.decode(bpe.encode(df, PATH, **how), PATH).collect()
    return sorted(((str(r.doc_id), list(r.ids), r.decoded) for r in out), key=str)


def expected(rows):
    t = Tokenizer.from_file(PATH)
    ids = [t.encode(x or "", add_special_tokens=False).ids for _, x in rows]
    return sorted(((str(d), i, t.decode(i, skip_special_tokens=False)) for (d, _), i in zip(rows, ids)), key=str)


@pytest.mark.parametrize("chunk_bytes", [1, 300, 8 << 20])
def test_same_as_the_library(spark, chunk_bytes):
    rng = random.Random(1)
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, "again"), (3, "again")]
    rows += [(100 + i, " ".join(rng.choice(["Thé", "wörd,", "x1", "of", "un-like"]) for _ in range(rng.randrange(50)))) for i in range(60)]
    if chunk_bytes == 1:
        rows = rows[:13] + rows[15:40]
    assert both(spark, rows, chunk_bytes=chunk_bytes, word_parts=7) == expected(rows)


def test_files(spark, tmp_path):
    rows = [(i, f"Text number {i} of many") for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    out = bpe.encode(spark.read.parquet(str(tmp_path / "t")), PATH).collect()
    t = Tokenizer.from_file(PATH)
    assert {r.doc_id: list(r.ids) for r in out} == {d: t.encode(x, add_special_tokens=False).ids for d, x in rows}


def test_empty_table_and_null_ids(spark):
    assert both(spark, []) == []
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, 49407])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()} == {1: "", 2: "", 3: "a</w> <|endoftext|>"}


def test_other_kinds_of_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        bpe.encode(spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), public_tokenizers.path("byte_bpe_50k.json"))
