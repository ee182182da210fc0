import random

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import toxicity

BAD = ["grolk", "vasnit", "humpel"]


def corpus(seed, n, toxic_share=0.4):
    rng = random.Random(seed)
    good = ["%s%s" % (a, b) for a in ("ta", "lo", "mi", "re", "su") for b in ("n", "r", "st", "ble", "do")]
    rows = []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.choice([5, 40, 150]))]
        toxic = int(rng.random() < toxic_share)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "a", "en", "ix"])
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = corpus(1, 500)
    return toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])


def test_held_out_accuracy(net):
    rows = corpus(2, 300)
    s = net.score_texts(pa.array([t for _, t, _ in rows]))
    assert np.mean((s >= 0.5) == [y for _, _, y in rows]) > 0.95
    assert (s >= 0).all() and (s <= 1).all()


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "F32", np.float64)
    rng = np.random.default_rng(0)
    net = toxicity.Network.new({"ab": 1, "c": 2}, 5, rng)
    net.p["words"][1:] += rng.standard_normal((2, net.p["words"].shape[1]))
    case = ["ab", "c", "defg", "hh"], np.array([0, 1, 2, 3, 1, 0, 2, 2, 3]), np.array([0, 4, 7]), np.array([4, 3, 2]), np.array([1.0, 0.0, 1.0])
    _, g = net.gradients(*case)
    for k, a in net.p.items():
        for _ in range(4):
            i = (ord(rng.choice(list("abcdefgh"))), int(rng.integers(a.shape[1]))) if k == "chars" else tuple(int(rng.integers(s)) for s in a.shape)
            if k == "words" and i[0] == 0:
                continue
            was = a[i]
            a[i] = was + 1e-5
            up = net.gradients(*case)[0]
            a[i] = was - 1e-5
            down = net.gradients(*case)[0]
            a[i] = was
            assert abs((up - down) / 2e-5 - g[k][i]) < 1e-6, (k, i)


def one_by_one(net, text):
    """The score by plain loops over one window after another."""
    p, sig = net.p, lambda x: 1 / (1 + np.exp(-x))

    def gru(xs, w, u, b):
        n, h, out = u.shape[0], np.zeros(u.shape[0]), []
        for x in xs:
            x, g = x @ w + b, h @ u
            z, r = sig(x[:n] + g[:n]), sig(x[n : 2 * n] + g[n : 2 * n])
            h = (1 - z) * np.tanh(x[2 * n :] + r * g[2 * n :]) + z * h
            out.append(h)
        return out

    words = [w for w in toxicity.words_of(pa.array([text], pa.string())).to_pylist()[0] if w]
    vectors = []
    for w in words:
        chars = [p["chars"][c if c < 384 else 384 + c % 128] for c in map(ord, w)]
        ends = [gru(x, p[f"char_w{d}"], p[f"char_u{d}"], p[f"char_b{d}"])[-1] for d, x in (("f", chars), ("b", chars[::-1]))]
        vectors.append(np.concatenate([*ends, p["words"][net.vocabulary.get(w, 0)]]))
    starts, n = [0], len(words)
    while starts[-1] + net.window < n:
        starts.append(min(starts[-1] + net.window // 2, n - net.window))
    best = 0
    for s in starts:
        xs = vectors[s : s + net.window]
        f = gru(xs, p["word_wf"], p["word_uf"], p["word_bf"])
        b = gru(xs[::-1], p["word_wb"], p["word_ub"], p["word_bb"])[::-1]
        h = np.array([np.concatenate(x) for x in zip(f, b)]).reshape(len(xs), len(p["out"]))
        a = np.exp(h @ p["attend"]) if len(xs) else np.zeros(0)
        pooled = (a / a.sum()) @ h if len(xs) else np.zeros(len(p["out"]))
        best = max(best, float(sig(pooled @ p["out"] + p["bias"][0])))
    return best


def test_batches_match_one_by_one(net):
    texts = [t for _, t, _ in corpus(4, 25)] + ["", None, "12 %", "one", "Größe ΩMEGA 日本語 " * 30, "x" * 300 + " y"]
    got = net.score_texts(pa.array(texts))
    assert np.allclose(got, [one_by_one(net, t) for t in texts], atol=1e-4)


def test_spark_scores_every_row(spark, net):
    rows = [(i, t, "x") for i, t, _ in corpus(5, 50)] + [(900, None, "x"), (901, "", "x"), (None, "grolk", "x"), (3, "again", "x"), (902, "taln " * 100000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    out = toxicity.score(df, net, chunk_bytes=2000).collect()
    assert sorted((str(r.doc_id), round(r.score, 4)) for r in out) == sorted((str(d), round(float(s), 4)) for (d, _, _), s in zip(rows, net.score_texts(pa.array([r[1] for r in rows]))))
    assert {r.doc_id: r.score for r in out}[901] < 0.5


def test_training_uses_labelled_rows_only(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(6, 60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in corpus(6, 60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, text int")
    rows = toxicity.sample_labelled(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", train_docs=1000)
    import zlib
    assert sorted(rows) == sorted((t, y) for i, t, y in corpus(6, 60) if zlib.crc32(str(i).encode()) % 5)
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), None).collect() == []


def test_kept_columns(spark, net):
    df = spark.createDataFrame([(1, "taln", 9.0), (None, None, None)], "doc_id long, text string, score double")
    for n in (net, None):
        out = toxicity.score(df, n, keep=df.columns, score_col="t")
        assert out.columns == ["doc_id", "text", "score", "t"] and sorted(str(r.score) for r in out.collect()) == ["9.0", "None"]
