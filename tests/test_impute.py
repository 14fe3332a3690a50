import numpy as np
import pytest

from rowmend.operators.impute import ALGORITHMS, PCADA, donors, engine
from rowmend.plans.fill import fill_als, fill_missing, run_all, status_table, trace_table

from .helpers import back, holes, low_rank, names, to_spark

V = 6
COLS = names(V)


@pytest.fixture(scope="module")
def data(spark):
    x = low_rank(500, V, 2, 0.1)
    gapped = holes(x, 0.12)
    return x, gapped, to_spark(spark, gapped).persist()


def error(filled, x, gapped):
    m = np.isnan(gapped)
    return np.sqrt((((filled - x) / x.std(0))[m] ** 2).mean())


@pytest.mark.parametrize("name", ["Alternating", "SVDImpute", "PCADA", "PPCA", "PPCA-M", "BPCA", "ALM"])
def test_recovers_planted_structure(data, name):
    x, gapped, df = data
    mean = back(fill_missing(df, COLS, "MI", 2).df, COLS)
    got = fill_missing(df, COLS, name, 2, prefill="mean", max_iter=60, max_rounds=0)
    filled = back(got.df, COLS)
    observed = ~np.isnan(gapped)
    np.testing.assert_array_equal(filled[observed], gapped[observed])
    assert error(filled, x, gapped) < 0.5 * error(mean, x, gapped)


def test_svt_with_a_matching_threshold(data):
    x, gapped, df = data
    mean = back(fill_missing(df, COLS, "MI", 2).df, COLS)
    got = fill_missing(df, COLS, "SVT", 2, max_iter=40, max_rounds=0, tau=60.0)
    assert error(back(got.df, COLS), x, gapped) < 0.7 * error(mean, x, gapped)


def test_als_picks_a_candidate(data):
    x, gapped, df = data
    mean = back(fill_missing(df, COLS, "MI", 2).df, COLS)
    got = fill_als(df, COLS, 2, candidates=2, max_iter=40)
    assert error(back(got.df, COLS), x, gapped) < error(mean, x, gapped)
    assert 1 <= got.components[()] <= V


def test_svd_error_never_grows(data):
    got = fill_missing(data[2], COLS, "SVDImpute", 2, max_iter=15, max_rounds=0)
    values = [t["value"] for t in got.trace][1:]
    assert all(b <= a + 1e-12 for a, b in zip(values, values[1:]))


def ppca_by_rows(x, a, iterations, p, latent_missing):
    """Row-by-row EM in plain loops."""
    n, v = x.shape
    mu, s2 = np.zeros(v), 1.0
    for _ in range(iterations):
        t, second, w_inv = np.zeros((n, a)), np.zeros((n, a, a)), np.zeros((n, a, a))
        for i in range(n):
            o = ~np.isnan(x[i])
            w_inv[i] = np.linalg.inv(p[o].T @ p[o] + s2 * np.eye(a))
            t[i] = w_inv[i] @ p[o].T @ (x[i, o] - mu[o])
            second[i] = s2 * w_inv[i] + np.outer(t[i], t[i])
        if not latent_missing:
            mu_new, p_new, total, count = np.zeros(v), np.zeros((v, a)), 0.0, 0
            for j in range(v):
                o = ~np.isnan(x[:, j])
                mu_new[j] = (x[o, j] - t[o] @ p[j]).mean()
                p_new[j] = np.linalg.inv(second[o].sum(0)) @ (t[o].T @ (x[o, j] - mu_new[j]))
                for i in np.flatnonzero(o):
                    total += (x[i, j] - p_new[j] @ t[i] - mu_new[j]) ** 2 + s2 * p_new[j] @ w_inv[i] @ p_new[j]
                    count += 1
            s2_new = total / count
        else:
            full = np.where(np.isnan(x), t @ p.T + mu, x)
            xt = np.zeros((v, a))
            trace = 0.0
            for i in range(n):
                m = np.isnan(x[i]).astype(float)
                xt += np.outer(full[i], t[i]) + m[:, None] * (s2 * p @ w_inv[i])
                trace += (full[i] ** 2).sum() + (m * s2 * (1 + np.einsum("va,ab,vb->v", p, w_inv[i], p))).sum()
            mu_new = (full - t @ p.T).mean(0)
            p_new = (xt - np.outer(mu_new, t.sum(0))) @ np.linalg.inv(second.sum(0))
            s2_new = (trace - 2 * (xt * p_new).sum() - 2 * mu_new @ full.sum(0) + 2 * mu_new @ p_new @ t.sum(0)
                      + np.trace(p_new @ second.sum(0) @ p_new.T) + n * mu_new @ mu_new) / (n * v)
        p, mu, s2 = p_new, mu_new, s2_new
    return np.where(np.isnan(x), t @ p.T + mu, x)


@pytest.mark.parametrize("name", ["PPCA", "PPCA-M"])
def test_em_equals_loops_over_rows(data, name):
    _, gapped, df = data
    mu = np.nanmean(gapped, 0)
    sd = np.sqrt(np.nansum((gapped - mu) ** 2, 0) / len(gapped))
    p0 = np.linalg.qr(np.arange(V * 2.0).reshape(V, 2) % 5 + 1)[0]
    expected = ppca_by_rows((gapped - mu) / sd, 2, 4, p0, name == "PPCA-M") * sd + mu
    got = fill_missing(df, COLS, name, 2, prefill="mean", max_iter=4, max_rounds=0, start_loadings=p0, start_variance=1.0)
    np.testing.assert_allclose(back(got.df, COLS), expected, rtol=1e-8)


def donors_of(missing, group, seed, copies):
    """The keyed draws of the operator: row numbers of the donors per variable, (copies, missing cells)."""
    import hashlib
    out = []
    for j in range(missing.shape[1]):
        pool = np.flatnonzero(~missing[:, j])
        rows = np.flatnonzero(missing[:, j])
        drawn = np.empty((copies, len(rows)), int)
        for c, row in enumerate(rows):
            for k in range(copies):
                digest = hashlib.md5("|".join(map(str, (seed, *group, row, f"x{j + 1}", k // 2))).encode()).hexdigest()
                low, high = (int(digest[16 * (k % 2) + 8 * i :][:8], 16) / 2**32 for i in (0, 1))
                drawn[k, c] = pool[int((low + high / 2**32) * len(pool))]
        out.append(drawn)
    return out


def test_donor_augmentation_equals_dense_loop(data):
    """The same draws, from all observed cells, through plain numpy."""
    _, gapped, df = data
    mu = np.nanmean(gapped, 0)
    sd = np.sqrt(np.nansum((gapped - mu) ** 2, 0) / len(gapped))
    x = (gapped - mu) / sd
    m = np.isnan(x)
    copies, iterations, a = 7, 3, 2
    donors = donors_of(m, (), 0, copies)
    s = np.where(m, 0.0, x)

    def top(g):
        lam, p = np.linalg.eigh(g)
        return p[:, np.argsort(lam)[::-1][:a]]

    p = top(np.corrcoef(s.T))
    for it in range(iterations):
        est = s @ p @ p.T
        stack = np.repeat(np.where(m, est, x)[None], copies, axis=0)
        for j in range(V):
            stack[:, m[:, j], j] += (x - est)[:, j][donors[j]]
        s = stack.mean(0)
        if it < iterations - 1:
            found = [top(c.T @ c) for c in stack]
            found = [f * np.where((f * found[0]).sum(0) < 0, -1, 1) for f in found]
            u, _, vt = np.linalg.svd(np.mean(found, 0), full_matrices=False)
            p = u @ vt
    got = fill_missing(df, COLS, "PCADA", a, prefill="mean", max_iter=iterations, max_rounds=0, copies=copies)
    np.testing.assert_allclose(back(got.df, COLS), s * sd + mu, rtol=1e-7)


@pytest.mark.parametrize("name", ["SVDImpute", "SVT", "ALM"])
def test_storing_the_state_changes_nothing(data, name, monkeypatch):
    _, _, df = data
    options = {"tau": 60.0} if name == "SVT" else {}
    whole = back(fill_missing(df, COLS, name, 2, max_iter=6, max_rounds=0, **options).df, COLS)
    monkeypatch.setattr(engine, "REPLAY_LIMIT", 2)
    stored = back(fill_missing(df, COLS, name, 2, max_iter=6, max_rounds=0, **options).df, COLS)
    np.testing.assert_allclose(stored, whole, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(set(ALGORITHMS) - {"ALS"}))
def test_groups_equal_separate_fits_and_partitioning_is_irrelevant(spark, name):
    x = holes(low_rank(240, 4, 1, 0.3), 0.15)
    g = np.arange(240) % 2
    cols = names(4)
    options = {"max_iter": 3, "max_rounds": 0}
    if name == "SVT":
        options["tau"] = 20.0
    grouped = back(fill_missing(to_spark(spark, x, extra={"g": g}), cols, name, {(0,): 1, (1,): 1}, group_cols=["g"],
                                **options).df, cols)
    for k in (0, 1):
        part = to_spark(spark, x, extra={"g": g}, partitions=1 + 6 * k).filter(f"g = {k}")
        # donors are drawn by group, so there the group stays a column of the separate fit
        own = {"components": {(k,): 1}, "group_cols": ["g"]} if name == "PCADA" else {"components": 1}
        np.testing.assert_allclose(grouped[g == k], back(fill_missing(part, cols, name, **own, **options).df, cols), rtol=1e-7)


def test_component_loop_stops_on_a_repeat(data):
    got = fill_missing(data[2], COLS, "SVDImpute", 4, max_iter=20, max_rounds=6, num_repeat=2)
    assert 1 <= got.rounds <= 6
    assert got.components[()] == 2
    assert not np.isnan(back(got.df, COLS)).any()


def test_run_all_reports_failures(spark, data):
    x = data[1].copy()
    x[:, 2] = np.nan
    results = run_all(to_spark(spark, x), COLS, 1, ["MI", "PPCA"], max_iter=2, max_rounds=0)
    status = {r["algorithm"]: (r["status"], r["error"]) for r in status_table(spark, results).collect()}
    assert status["MI"][0] == "incomplete"
    assert status["PPCA"][0] == "failed" and "x3" in status["PPCA"][1]


def test_bpca_leaves_empty_rows_and_trace_is_kept(spark, data):
    x = data[1].copy()
    x[7] = np.nan
    results = run_all(to_spark(spark, x), COLS, 2, ["BPCA"], max_iter=5, max_rounds=1, num_repeat=1)
    filled = back(results["BPCA"].df, COLS)
    assert np.isnan(filled[7]).all() and not np.isnan(np.delete(filled, 7, 0)).any()
    assert results["BPCA"].status == "incomplete"
    trace = trace_table(spark, results).collect()
    assert [r["iteration"] for r in trace] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("least, rows", [(7, None), (50, 100), (1000, 40)])
def test_blocks_of_any_size_borrow_the_same_cells(data, monkeypatch, least, rows):
    """The same fit for one block, for many blocks and for a table whose order is found in parts."""
    _, _, df = data
    options = {"max_iter": 3, "max_rounds": 0, "copies": 5}
    whole = back(fill_missing(df, COLS, "PCADA", 2, **options).df, COLS)
    monkeypatch.setattr(donors, "LEAST_ROWS", least)
    monkeypatch.setattr(donors, "BLOCK_ROWS", least)
    cut = back(fill_missing(df, COLS, "PCADA", 2, max_rows=rows, **options).df, COLS)
    np.testing.assert_allclose(cut, whole, rtol=1e-9)


def test_donors_come_from_all_observed_cells():
    drawn = np.concatenate([donors.draws(f"1|{row}", "x1", 4, 3000) for row in range(800)])
    assert len(drawn) == 3200 and drawn.min() >= 0 and drawn.max() < 3000
    assert np.histogram(drawn, 10, (0, 3000))[0].min() > 0.07 * len(drawn)


def test_an_iteration_of_donor_augmentation_moves_values_once(data, monkeypatch):
    """One exchange of values between blocks; the packed table and the lists of cells stay where they are."""
    from rowmend.plans import fill as plan

    fitted, original = [], plan.fitted_values
    monkeypatch.setattr(plan, "fitted_values", lambda state: fitted.append(state) or original(state))
    fill_missing(data[2], COLS, "PCADA", 2, max_iter=2, max_rounds=0, copies=5)
    static = fitted[0].links.static
    stored = static._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in stored and "Scan ExistingRDD" in stored


def test_donor_augmentation_beats_the_mean(data):
    filled = fill_missing(data[2], COLS, "PCADA", 2, prefill="mean", max_iter=5, max_rounds=0)
    mean = back(fill_missing(data[2], COLS, "MI", 2).df, COLS)
    assert error(back(filled.df, COLS), data[0], data[1]) < 0.6 * error(mean, data[0], data[1])


def test_packed_donors_take_two_bytes_and_the_state_is_as_large_as_its_cells(data, monkeypatch):
    from rowmend.plans import fill as plan

    fitted, original = [], plan.fitted_values
    monkeypatch.setattr(plan, "fitted_values", lambda state: fitted.append(state) or original(state))
    fill_missing(data[2], COLS, "PCADA", 2, max_iter=6, max_rounds=0, copies=5)
    links, cells = fitted[0].links, int(np.isnan(data[1]).sum())
    rows = links.static.select("src", "to").collect()
    assert sum(len(r["src"]) for r in rows) == 2 * 5 * cells
    assert sum(len(t["idx"]) for r in rows for t in r["to"] or ()) <= 2 * 5 * cells + 4 * V * len(rows) ** 2
    assert sum(len(r["s"]) for r in links.state.select("s").collect()) == 8 * cells
    size = int(links.state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size < 100 * 8 * cells + 100_000  # Spark's estimate squared with every iteration when it was taken from the plan
