import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = {"en": ["stone", "river", "light", "harbor", "meadow", "winter"], "de": ["schule", "wasser", "brücke", "straße", "garten", "woche"]}


def say(rng, lang, n):
    return " ".join(rng.choice(GOOD[lang]) + rng.choice(["", "s", "en", "ly"]) + rng.choice(["", "a", "o", "u"]) for _ in range(n))


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """Documents of known kinds, and what each kind must become."""
    rng = random.Random(1)
    docs, toxic = [], []
    for i in range(400):
        lang = rng.choice(["en", "de"])
        words = say(rng, lang, rng.choice([60, 150])).split()
        bad = rng.random() < 0.3
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["grolk", "vasnit"]) + rng.choice(["", "x", "um"])
        docs.append([i, " ".join(words), lang])
        toxic.append((i, 0, int(bad)))
    item = say(rng, "en", 40)
    docs[10][1] = docs[10][1] + " " + item
    docs[11][1] = item
    toxic[10], toxic[11] = (10, 0, 0), (11, 0, 0)
    bad = {i for i, _, y in toxic if y}
    clean = [d for d in docs if d[0] not in bad and d[0] not in (10, 11)]
    copies = [[1000 + k, clean[k][1], clean[k][2]] for k in range(5)]
    near = [[1100 + k, " ".join([*clean[k + 5][1].split()[:-1], "changed"]), clean[k + 5][2]] for k in range(5)]
    odd = [[2000, None, None], [2001, "", "en"], [2002, "1234 5678", "en"]]
    rows = [(*d, f"s{d[0] % 3}", len(d[1] or "")) for d in [*docs, *copies, *near, *odd]]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, say(rng, "en", 30))], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    kept = {d[0] for d in clean}
    return str(path), {r[0]: r for r in rows}, bad, kept


def test_stages_and_result(spark, case):
    path, rows, bad, kept = case
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        docs.write.parquet(out := f"{path}/stage{k}-{zlib.crc32(path.encode())}")
        docs = spark.read.parquet(out)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert len(bad - (set(rows) - seen[0])) <= 0.03 * len(bad)
    assert len(kept - seen[0]) <= 0.03 * len(kept)
    assert seen[0] - seen[1] == {2000, 2001, 2002} & seen[0]
    assert not seen[2] & {*range(1000, 1005), *range(1100, 1105)} and not (seen[1] - seen[2]) & kept
    assert seen[2] - seen[3] == {10, 11}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    result = {r.doc_id: (r.n_tokens, list(r.ids)) for r in docs.collect()}
    assert result == {d: (len(ids), ids) for d in seen[3] for ids in [t.encode(rows[d][1], add_special_tokens=False).ids]}
    again = {r.doc_id: (r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, path).collect()}
    assert again == result


def test_last_stage_decodes(spark, case):
    path, rows, *_ = case
    docs = spark.read.parquet(f"{path}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    name, last = corpus_pipeline.STAGES[-1]
    got = {r.doc_id: r.decoded for r in last(spark, docs, path).collect()}
    tokens = lambda text: t.encode(text or "", add_special_tokens=False).tokens
    assert got == {d: " ".join(tokens(r[1])) for d, r in rows.items()}


def test_near_duplicate_stage_against_brute_force(spark, case):
    path, rows, _, _ = case
    docs = spark.read.parquet(f"{path}/documents.parquet")
    how = corpus_pipeline.NEAR
    prints = {d: simhash.fingerprint_of(r[1], how["shingle_words"], how["lanes"]) for d, r in rows.items()}
    group = {d: d for d in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and simhash._distance(prints[a], prints[b]) <= how["radius"]:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, path).collect()}
    assert got == {d for d in rows if root(d) == d}


def test_stages_keep_odd_rows_and_columns_of_any_name(spark, case):
    """Nulls, ties, repeated rows and ids, a very long text, many copies, and columns named like those that the stages make."""
    path, rows, _, kept = case
    some = [rows[d] for d in sorted(kept)[:6]]
    text = lambda k: some[k][1]
    extra = [(None, text(1), "en"), (None, text(2) + " and more of it", None), (7000, say(random.Random(9), "en", 90_000), "de"), (7001, text(3), "en"), (7001, text(3), "en"), (7002, None, None), (7003, text(4) + " tail", None), (7003, text(5) + " other tail", None)]
    extra += [(8000 + k, text(5), "en") for k in range(150)]
    names = "leaked_id long, __id long, toxicity double, share string, spans string, lang_pred string, `a.b` int"
    every = [(d, t, lang, None, len(t or ""), k, -k, 0.25, "s", "t", "u", k) for k, (d, t, lang) in enumerate([(r[0], r[1], r[2]) for r in some] + extra)]
    docs = spark.createDataFrame(every, f"{SCHEMA}, {names}")
    given = sorted(map(str, every))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        docs = stage(spark, docs, path)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        docs.write.parquet(out := f"{path}/odd{k}")
        docs = spark.read.parquet(out)
        left = [tuple(r) for r in docs.collect()]
        assert set(map(str, left)) <= set(given)
        texts = sorted({r[1] for r in left if r[1]})
        if name == "toxicity":
            assert len(left) >= 0.97 * len(every)
        elif name == "language":
            assert all(r[1] for r in left)
        elif name == "near_duplicates":
            assert len(texts) == len(left) and sum(r[0] is not None and r[0] >= 8000 for r in left) == 0
            assert any(r[0] == 7000 and len(r[1]) > 500_000 for r in left)
    coded = corpus_pipeline.encode(spark, docs, path).collect()
    assert sorted(str(r.doc_id) for r in coded) == sorted(str(r[0]) for r in left) and all(r.n_tokens == len(r.ids) for r in coded)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, case, tmp_path, name, stage):
    path, *_ = case
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect() == []
