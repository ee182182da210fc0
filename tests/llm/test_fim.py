import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import fim, queries

TEXTS = [None, "", "a", "ab cd", "Ünï cödé wörd", "x<P>y", "a<S", "<M>", "日本語 text 🙂🙂 end", " \n\t ", "word" * 5000, "a b " * 40000, "é" * 9000, "\u0000a\u0000b", "<P", ">", "<P<S<M>"]


def expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_same_as_cutting_lists_of_tokens(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id here"), (5, "again"), (5, "again"), (-7, "minus one two")]
    rows += [(100 + i, "".join(rng.choice(["a", "Bc", " ", "\n", "é", "<", "P>", "1", "🙂"]) for _ in range(rng.randrange(200)))) for i in range(300)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, form string, output int").repartition(3)
    out = fim.rearrange(df)
    got = [tuple(r) for r in out.select("doc_id", "n_tokens", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form"))).collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_cuts_do_not_hang_on_the_chunks(chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("aB é🙂-") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    draws = np.array([[rng.randrange(1 << 32) for _ in range(2)] for _ in texts])
    n, where, before = fim.cuts(data, ends, draws, chunk)
    for i, t in enumerate(texts):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        assert n[i] == len(units)
        for c, rank in enumerate(sorted((draws[i] % (len(units) + 1)).tolist())):
            head = "".join(units[:rank])
            assert (where[i, c], before[i, c]) == (len(head.encode()), len(head))


def test_empty_table(spark):
    assert fim.rearrange(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert fim.cuts(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros((0, 2), np.int64))[0].tolist() == []


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in enumerate(TEXTS) if "\0" not in (t or "")] + [(None, "no id"), (9, "twice"), (9, "twice")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = queries.op12_fim(spark, str(tmp_path))
    want = con.sql(queries.oracle_sql()["op12_fim"])
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want.fetchall(), key=str)
