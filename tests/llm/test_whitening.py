import numpy as np
import pytest

from offerloom.llm import whitening


def plain(vecs):
    """Brute force with whole numbers and LAPACK: x, mean, covariance."""
    x = np.floor(64 * np.array(vecs, float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    return x, fit, np.cov(fit.T, bias=True).reshape(x.shape[1], -1)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 32, 65])
@pytest.mark.parametrize("kind", ["random", "identity", "zero", "low rank", "graded", "ties"])
def test_eigen(n, kind):
    r = np.random.default_rng(n)
    b = r.normal(size=(n, n))
    a = {"random": b @ b.T, "identity": np.eye(n), "zero": np.zeros((n, n)), "low rank": b[:, :1] @ b[:, :1].T, "graded": np.diag(10.0 ** -np.arange(n)), "ties": np.diag(np.arange(n) // 3 + 0.0) + 1e-3 * (b + b.T)}[kind]
    values, basis = whitening.eigen(a)
    size = np.abs(a).max() or 1
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * size * n
    assert np.abs(basis.T @ basis - np.eye(n)).max() < 1e-12
    assert np.abs(a @ basis - basis * values).max() < 1e-12 * size * n


def test_error_free_transformations():
    from fractions import Fraction

    r = np.random.default_rng(3)
    a, b = r.normal(size=50) * 1e9, r.normal(size=50) / 7
    for found, want in ((whitening.two_sum(a, b), lambda p, q: p + q), (whitening.two_product(a, b), lambda p, q: p * q)):
        assert all(Fraction(h) + Fraction(low) == want(Fraction(p), Fraction(q)) for h, low, p, q in zip(*map(np.ndarray.tolist, (*found, a, b))))
    high, low = whitening.column_sums((np.array([[1.0], [1e-20], [-1.0], [1e-20], [1e-20]]), np.zeros((5, 1))))
    assert high[0] + low[0] == pytest.approx(3e-20, rel=1e-10)


def test_against_numpy(spark):
    r = np.random.default_rng(5)
    vecs = (r.normal(size=(300, 20)) * np.linspace(3, 0.5, 20)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vecs)] + [(1000, vecs[0].tolist(), "copy"), (1001, None, "n"), (1002, [], "e"), (1003, [1.0] * 19 + [None], "n"), (1004, [float("nan")] + [1.0] * 19, "n"), (1005, [1.0] * 7, "short"), (None, vecs[1].tolist(), "no id"), (0, vecs[0].tolist(), "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").withColumn("x", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).repartition(5)
    got = whitening.whiten(df).toPandas()
    assert set(got.vec_id.dropna().astype(int)) == {*range(300), 1000} and len(got) == 16 * 303
    x, fit, cov = plain(vecs)
    n, sums = len(fit), fit.sum(0)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    own = got[got.vec_id.between(1, 299)].sort_values(["vec_id", "component"])
    w = own.whitened.to_numpy().reshape(-1, 16)
    want = (x[1:] - sums / n) @ basis / np.sqrt(values)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert (own.deviation.to_numpy().reshape(-1, 16)[:, 3] == ((n * x[1:] - sums) ** 2).sum(1)).all() and set(got.n) == {n} == {300}
    assert np.abs(own.explained.to_numpy()[:16] - values / np.trace(cov)).max() < 1e-12 and got.identity_error.max() < 1e-10
    first = got[got.vec_id.isin([0, 1000])].groupby("component").whitened
    assert (first.min() == first.max()).all()


def test_odd_tables(spark):
    shape = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], shape)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], shape)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], shape)).toPandas()
    assert len(one) == 4 and one.whitened.isna().all() and (one.explained == 0).all() and (one.deviation == 0).all() and (one.identity_error == 0).all()
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], shape)).toPandas()
    assert flat[flat.component == 2].whitened.isna().all() and flat[flat.component == 1].whitened.notna().all() and flat.identity_error.max() < 1e-12
    far = whitening.whiten(spark.createDataFrame([(k, [2.0**50 * (k % 3), float(k)]) for k in range(9)] + [(99, [2.0**60, 1.0])], shape)).toPandas()
    assert 99 not in set(far.vec_id) and far.deviation.isna().any()
    assert int(far[far.vec_id == 0].deviation_exact.iloc[0]) == (9 * 10**6 - 9 * 10**6 - 64 * 2**50 * 9) ** 2 + (9 * 10**6 - 9 * 10**6 - 64 * 36) ** 2
