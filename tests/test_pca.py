import numpy as np
import pytest

from rowmend.functions.quantiles import chi2_ppf, norm_ppf, t_ppf
from rowmend.operators import components, moments, pca, scaling

from .helpers import back, low_rank, names, to_spark


@pytest.fixture(scope="module")
def table(spark):
    x = low_rank(400, 5, 2, 0.5)
    return x, to_spark(spark, x).persist()


def test_quantiles():
    assert norm_ppf(0.975) == pytest.approx(1.959963984540054)
    assert chi2_ppf(0.95, 1) == pytest.approx(3.841458820694124)
    assert chi2_ppf(0.95, 2.5) == pytest.approx(6.9295, abs=2e-3)
    assert chi2_ppf(0.99, 10) == pytest.approx(23.20925, abs=1e-4)
    assert chi2_ppf(0.5, 2) == pytest.approx(2 * np.log(2))
    assert t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert t_ppf(0.995, 5) == pytest.approx(4.032142984, abs=1e-8)
    assert t_ppf(0.025, 10) == pytest.approx(-2.228138852, abs=1e-8)


def dense(x, a):
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    lam, p = np.linalg.eigh(z.T @ z / (len(z) - 1))
    p = p[:, np.argsort(lam)[::-1][:a]]
    p = p * np.sign(p[np.abs(p).argmax(0), np.arange(a)])
    return z, p, z @ p


def test_model_matches_dense_algebra(table):
    x, df = table
    z, p, t = dense(x, 2)
    model = pca.fit_pca(df, names(5), 2, contrib="2D-Chiang", lim=0.99)[()]
    np.testing.assert_allclose(model.p, p, atol=1e-10)
    np.testing.assert_allclose(model.p.T @ model.p, np.eye(2), atol=1e-12)
    np.testing.assert_allclose(model.sigma_sq, t.var(0), rtol=1e-10)
    scored = pca.score_rows(df, {(): model}, ("T_sq", "SRE", "T_sq_con", "SRE_con"))
    t2 = back(scored, ["T_sq"])[:, 0]
    np.testing.assert_allclose(t2, (t ** 2 / t.var(0)).sum(1), rtol=1e-9)
    assert t2.mean() == pytest.approx(2.0)
    con = back(scored, [f"T_sq_con_{v}" for v in names(5)])
    np.testing.assert_allclose(con.sum(1), t2, rtol=1e-9)
    np.testing.assert_allclose(model.limits["T_sq_con"], con.mean(0) + norm_ppf(0.99) * con.std(0), rtol=1e-9)
    sre = ((z - t @ p.T) ** 2).sum(1)
    dof = 2 * sre.mean() ** 2 / sre.var()
    assert model.limits["SRE"] == pytest.approx(sre.mean() / dof * chi2_ppf(0.99, dof))


def test_alcala_contributions_and_limits(table):
    x, df = table
    z, p, t = dense(x, 2)
    d = p @ np.diag(1 / t.var(0)) @ p.T
    c = np.eye(5) - p @ p.T
    model = pca.fit_pca(df, names(5), 2, contrib="2D-Alcala", lim_method="2D-Alcala", lim=0.95, row_limits=False)[()]
    scored = pca.score_rows(df, {(): model}, ("T_sq_con", "SRE_con"))
    np.testing.assert_allclose(back(scored, [f"T_sq_con_{v}" for v in names(5)]), (z @ d) ** 2 / np.diag(d), rtol=1e-8)
    np.testing.assert_allclose(back(scored, [f"SRE_con_{v}" for v in names(5)]), (z @ c) ** 2 / np.diag(c), rtol=1e-8)
    s = np.cov(z.T)
    np.testing.assert_allclose(model.limits["SRE_con"], np.diag(c @ s @ c) / np.diag(c) * chi2_ppf(0.95, 1), rtol=1e-9)


def test_press_from_moments_equals_direct_split(table):
    x, df = table
    folded = moments.with_folds(df, 4, 1, seed=5).persist()
    total, folds = moments.fold_moments(folded, names(5), 4, 1)[()]
    press = components.press_matrix(total, folds, 4)
    of_row = back(folded, ["fold_0"])[:, 0].astype(int)
    for f in range(4):
        train, test = x[of_row != f], x[of_row == f]
        mu, sd = train.mean(0), train.std(0, ddof=1)
        _, p, _ = dense(train, 5)
        zt = (test - mu) / sd
        kept = np.eye(5)
        for a in range(5):
            deflated = kept - np.outer(p[:, a], p[:, a])
            if (np.diag(deflated) >= 10 * np.finfo(float).eps).all():
                kept = deflated
            r = kept / np.diag(kept)
            if a < 4:  # the last deflation removes everything but rounding
                assert press[a, f] == pytest.approx(((zt @ r) ** 2).sum(0).mean(), rel=1e-8)


def test_component_rules():
    press = np.array([[5.0, 5.2, 5.1], [1.0, 1.2, 1.1], [1.08, 1.2, 1.0]])
    assert components.one_standard_error(press) == 2
    assert components.one_standard_error(np.ones((2, 3))) == 1
    assert components.max_components(10, 14, 5, 9) == 8
    spread = np.ones((2, 30)) + np.random.default_rng(0).normal(size=(2, 30)) * 0.01
    spread[:, 7] = 50
    assert components.without_outlier_splits(spread).shape[1] == 29


def test_grouped_model_equals_separate_models(spark):
    x = low_rank(300, 4, 2, 0.3)
    g = np.arange(300) % 3
    df = to_spark(spark, x, extra={"g": g})
    grouped = pca.fit_pca(df, names(4), 2, group_cols=["g"])
    for k in range(3):
        _, p, _ = dense(x[g == k], 2)
        np.testing.assert_allclose(grouped[(k,)].p, p, atol=1e-9)
    chart = pca.row_control_chart(df, grouped, ["g"])
    assert 0 < chart.count() < 300


def test_dual_equals_primal(spark):
    x = np.random.default_rng(3).normal(size=(6, 9))
    x -= x.mean(0)
    df = to_spark(spark, x)
    rows = {r["variable"]: (r["loading_1"], r["loading_2"]) for r in pca.pca_dual(df, names(9), 2).collect()}
    _, _, vt = np.linalg.svd(x)
    p = vt[:2].T
    p = p * np.sign(p[np.abs(p).argmax(0), [0, 1]])
    np.testing.assert_allclose([rows[v] for v in names(9)], p, atol=1e-9)
    with pytest.raises(ValueError):
        pca.pca_dual(to_spark(spark, np.ones((9, 3))), names(3), 1)


def test_validation(table, spark):
    _, df = table
    with pytest.raises(ValueError):
        pca.fit_pca(df, names(5), 6)
    with pytest.raises(ValueError):
        pca.fit_pca(df, names(5), 2, contrib="other")
    with pytest.raises(ValueError, match="missing"):
        pca.fit_pca(to_spark(spark, [[1.0, np.nan], [2.0, 3.0], [4.0, 1.0]]), names(2), 1)


def test_zero_variance_column(spark):
    x = low_rank(50, 3, 1, 0.2)
    x[:, 1] = 4.0
    df = to_spark(spark, x)
    scaled = back(scaling.autoscale(df, names(3)), names(3))
    assert (scaled[:, 1] == 0).all()
    model = pca.fit_pca(df, names(3), 1, row_limits=False)[()]
    assert model.sigma[1] == 0 and abs(model.p[1, 0]) < 1e-12


def test_constant_data_without_spread_has_no_components(spark):
    with pytest.raises(ValueError, match="no variance"):
        pca.fit_pca(to_spark(spark, np.ones((20, 3))), names(3), 1)
