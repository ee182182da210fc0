import numpy as np
import pytest

from marlstone.llm import whitening


def run(spark, rows, parts=3, schema="vec_id long, embedding array<float>, n int, component string", **how):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], schema).repartition(parts)
    return whitening.whiten(df, **how)


def expected(rows, k=16):
    x = np.floor(64 * np.array([np.array(v, np.float32).astype(float) for _, v in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:k]
    return n, ((n * x - sums) ** 2).sum(axis=1), ((x - sums / n) @ v[:, order]) / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_same_as_the_covariance(spark, parts):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32).tolist()
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[0]) for i in range(150)]  # a third are one vector
    odd = [(2000, None), (2001, [float("nan")] * 20), (2002, [float("inf")] * 20), (2003, [None] * 20), (2004, []), (2005, [1.0, 2.0])]
    out = run(spark, rows + odd, parts).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, explained = expected(rows)
    got = out.whitened.to_numpy().reshape(-1, 16)
    sign = np.sign((got * whitened).sum(axis=0))
    assert set(out.n) == {n} and n == 300 and len(out) == 16 * len(rows)
    assert (out[out.component == 1].deviation.to_numpy() == deviation).all()
    assert np.abs(got * sign - whitened).max() < 1e-9
    assert np.abs(out.explained.to_numpy()[:16] / explained - 1).max() < 1e-9
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9


def test_merging_loses_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(-900, 900, (500, 7)) + np.array([0, 500, 0, -300, 0, 0, 10])
    x[:, 6] = x[:, 0] - x[:, 1]  # one dimension too many
    whole = whitening.summary(x)
    merged = whitening.summary(x[:3])
    for a, z in ((3, 4), (4, 200), (200, 500)):
        merged = whitening.merged(merged, whitening.summary(x[a:z]))
    assert merged[0] == 500 and (merged[1] == whole[1]).all()
    assert np.allclose(merged[3].T @ merged[3], whole[3].T @ whole[3], rtol=1e-12, atol=1e-6)


def test_few_and_flat_vectors(spark):
    assert run(spark, []).collect() == []
    assert run(spark, [(1, None)]).collect() == []
    one = run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect()
    assert {tuple(r) for r in one} == {(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    flat = run(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (None, [4.0, 5.0])]).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and len({r.vec_id for r in flat}) == 3
    assert flat[0].identity_error < 1e-9


def test_components_of_few_dimensions(spark):
    out = run(spark, [(i, [float(i), float(i * i % 7), 1.5 * (i % 3)]) for i in range(40)]).collect()
    assert {r.component for r in out} == {1, 2, 3} and len(out) == 120
