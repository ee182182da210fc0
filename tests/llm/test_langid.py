import random

import numpy as np
import pyarrow as pa

from marlstone.llm import langid

SYL = {"aa": ["ka", "to", "mi", "ren"], "bb": ["schu", "gel", "ung", "ver"], "ru": ["при", "вет", "мир", "ова"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYL[lang]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n))


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    return [(i, say(rng, lang := rng.choice(sorted(SYL)), rng.choice([3, 30])), lang) for i in range(n)]


def run(spark, rows, labelled=None, **how):
    schema = "doc_id long, text string, lang string, score double, spans string"
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], schema)
    model = langid.train(spark.createDataFrame([(*r, 0.5, "x") for r in labelled or rows], schema))
    return langid.identify(docs, model, **how).collect()


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus()
    extra = [(1000, None, "aa"), (1001, "", None), (1002, "123 ²² -- !", "bb"), (1003, "ΑΒΓ δεζ", None), (None, "kato miren", None), (1004, "schugelung " * 60000, None), (1005, "日本", None)]
    out = {r.doc_id: r for r in run(spark, rows + extra)}
    assert np.mean([out[i].lang_pred == lang for i, _, lang in rows]) > 0.98
    assert [(out[i].lang_pred, out[i].score, out[i].spans) for i in (1000, 1001, 1002)] == [("und", 0.0, [])] * 3
    assert out[1003].lang_pred in SYL and 0 <= out[1003].score <= 1
    assert out[None].lang_pred == "aa" and out[1004].lang_pred == "bb" and out[1004].score == 1.0


def test_letters_of_any_range_are_letters(spark):
    rows = [(k, t, None) for k, t in enumerate(["ℂ", "ⁿ", "ʰ", "٣", "№ €", "\u0301", "𝔄", "ª 5"])]
    out = {r.doc_id: r.lang_pred for r in run(spark, rows, corpus())}
    assert [out[k] == "und" for k in range(8)] == [False, False, False, True, True, True, False, False]


def test_sample_is_bounded_and_spread_under_null_and_repeated_ids(spark):
    texts = sorted("aa%04d" % k for k in range(900))
    for doc_id in (None, 7):
        rows = [(doc_id, t, "aa") for t in texts] + [(5, "same", "bb")] * 700 + [(k, "b%d" % k, "bb") for k in range(10)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = langid.sample_labelled(df, langid.F.lit(True), id_col="doc_id", text_col="text", lang_col="lang", train_docs=50)
        of = {x: [t for t, lang in got if lang == x] for x in ("aa", "bb")}
        assert len(of["aa"]) == 50 and sorted(of["bb"]) == sorted(["same", *("b%d" % k for k in range(10))])
        assert of["aa"][-1] > texts[600] and of["aa"][0] < texts[300]


def test_spans_of_mixed_texts(spark):
    rng = random.Random(5)
    text = say(rng, "aa", 40) + ". " + say(rng, "bb", 60) + "; " + say(rng, "ru", 10)
    (r,) = run(spark, [(1, text, None)], corpus())
    assert [(s.lang, s.words) for s in r.spans] == [("aa", 40), ("bb", 60), ("ru", 10)]
    assert [s.first_word for s in r.spans] == [0, 40, 100] and r.lang_pred == "bb"


def test_script_narrows_candidates(spark):
    model = langid.train(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    scores, letters = langid.word_scores(["привет", "kato", "", "́"], model)
    ru = model.languages.index("ru")
    assert scores[0].argmax() == ru and (np.delete(scores[0], ru) <= langid.IMPOSSIBLE).all()
    assert scores[1][ru] == langid.IMPOSSIBLE and letters.tolist() == [6, 4, 0, 0]


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(2)
    scores = rng.standard_normal((30, 3)).astype(np.float32)
    lens = [0, 1, 5, 7, 3, 7, 0]
    offsets = np.concatenate(([0], np.cumsum(lens)))
    tokens = rng.integers(0, 30, offsets[-1])
    path = langid.viterbi(scores, tokens, offsets, 1.5)
    for a, b in zip(offsets, offsets[1:]):
        own = tokens[a:b]
        def value(p):  # noqa: E306
            return sum(scores[t, s] for t, s in zip(own, p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        best = max((value(p) for p in np.ndindex(*(3,) * len(own))), default=0)
        assert abs(value(path[a:b].tolist()) - best) < 1e-4


def test_word_scores_match_brute_force():
    rows = [(t, lang) for _, t, lang in corpus(n=60)]
    model = langid.fit(rows, bits=14)
    words = ["kato", "m", "schugel", "", "verung"]
    scores, _ = langid.word_scores(words, model)
    for w, got in zip(words, scores):
        want = np.zeros(3)
        marked = "\n" + w + "\n"
        for n in langid.ORDERS:
            for k in range(len(marked) - n + 1):
                gram = marked[k : k + n]
                if w and gram.strip("\n") and not (n == 1 and gram == "\n"):
                    bucket, _ = langid._grams(np.array([ord(c) for c in gram], np.uint32), n, 14)
                    want += model.table[bucket[0]]
        possible = got > langid.IMPOSSIBLE
        assert np.allclose(got[possible], want[possible], atol=1e-3)


def test_chunks_do_not_change_results(spark):
    rows = corpus(3, 60)
    assert sorted(run(spark, rows)) == sorted(run(spark, rows, chunk_words=1))


def test_empty_table_and_no_labels(spark):
    assert run(spark, [], corpus()) == []
    (r,) = run(spark, [(1, "abc", None)], [(1, "abc", None)])
    assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
    assert langid.words_of(pa.array([None, "A-b"])).to_pylist()[1] == ["a", "b"]


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "kato miren", "x", 2.5), (None, None, "y", None)], "doc_id long, text string, lang_pred string, score double")
    out = langid.identify(df, langid.fit([("kato", "aa")]), keep=df.columns, lang_col="l", score_col="s", spans_col="w")
    assert out.columns == [*df.columns, "l", "s", "w"]
    assert sorted((str(r.doc_id), r.lang_pred, r.score, r.l) for r in out.collect()) == [("1", "x", 2.5, "aa"), ("None", "y", None, "und")]
