"""Passes over the rows that all fits from one start share (F6)."""

import numpy as np
import pytest

from rowmend.operators.impute import donors, fitted_values, patterns
from rowmend.operators.moments import fold_moments, with_folds
from rowmend.plans import fill
from rowmend.plans.fill import fill_missing, run_all

from .helpers import back, holes, low_rank, names, to_spark

COLS = names(5)


@pytest.fixture(scope="module")
def data(spark):
    x = holes(low_rank(400, 5, 2, 0.3), 0.2)
    x[7] = np.nan
    return to_spark(spark, x, extra={"g": np.arange(400) % 2})


def _numbers(moments):
    return np.concatenate([[moments.n], moments.mean, moments.second(np.zeros(5)).ravel()])


@pytest.mark.parametrize("name", ["PPCA", "SVDImpute", "BPCA"])
@pytest.mark.parametrize("prefill", ["mean", "interpolation"])
def test_folds_of_patterns_are_those_of_the_filled_rows(data, name, prefill):
    got = fill_missing(data, COLS, name, 2, group_cols=["g"], prefill=prefill, max_iter=4, max_rounds=0)
    state = got.state
    rows = fold_moments(with_folds(fitted_values(state), 3, 2, 5), COLS, 3, 2, ["g"], state.scale, drop_incomplete=True)
    sums = patterns.fold_sums(with_folds(state.df, 3, 2, 5), COLS, state.filled_cols, state.scale, 3, 2, ["g"])
    found = patterns.filled_folds(state, sums, 3, 2, drop_incomplete=True)
    assert set(found) == set(rows) == {(0,), (1,)}
    for key in rows:
        for a, b in zip([found[key][0], *found[key][1]], [rows[key][0], *rows[key][1]], strict=True):
            np.testing.assert_allclose(_numbers(a), _numbers(b), rtol=1e-9, atol=1e-6)
    if name == "BPCA":  # the row without any observed cell
        with pytest.raises(ValueError, match="1 rows have missing cells"):
            patterns.filled_folds(state, sums, 3, 2)


def test_all_fits_share_their_passes(data, monkeypatch):
    """Every algorithm filled all rows for its folds, and once more to count the cells it leaves empty."""
    calls = []

    def counted(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: calls.append(name) or real(*a, **k))

    for name in ("fold_sums", "empty_cells", "fold_moments", "largest_contribution"):
        counted(fill, name)
    options = {"max_iter": 3, "max_rounds": 1, "n_splits": 3, "num_repeat": 2}
    chosen = ["Alternating", "PPCA", "SVDImpute", "BPCA", "SVT", "ALM", "ALS"]
    short = run_all(data, COLS, 1, chosen, **options)
    assert sorted(calls) == ["empty_cells"] * 2 + ["fold_sums"] * 3  # two starts; the folds of ALS are others
    monkeypatch.setattr(patterns, "MAX_NUMBERS", 0)
    rows = run_all(data, COLS, 1, chosen, **options)
    assert list(short) == list(rows) == chosen
    for name in chosen:
        a, b = short[name], rows[name]
        assert (a.status, a.error, a.rounds, a.components) == (b.status, b.error, b.rounds, b.components)
        np.testing.assert_allclose(back(a.df, COLS), back(b.df, COLS), rtol=1e-7)
    assert short["BPCA"].error == "5 cells left missing"


def test_few_folds_of_many_patterns_are_summed_over_the_rows(data, monkeypatch):
    """Sums by pattern and fold that would be too many for the driver are taken of the filled rows."""
    short = fill_missing(data, COLS, "PPCA", 2, max_iter=3, max_rounds=1, num_repeat=2)
    monkeypatch.setattr(fill, "patterns_fit", lambda *_: False)
    rows = fill_missing(data, COLS, "PPCA", 2, max_iter=3, max_rounds=1, num_repeat=2)
    assert rows.state.patterns is not None and short.components == rows.components
    np.testing.assert_allclose(back(short.df, COLS), back(rows.df, COLS), rtol=1e-9)


def test_gram_matrices_of_the_copies():
    rng = np.random.default_rng(4)
    base, missing = rng.normal(size=(300, 5)), rng.random((300, 5)) < 0.3
    missing[:, 4] = False
    borrowed = rng.normal(size=(int(missing.sum()), 7))
    got = donors._grams(base, missing, borrowed)
    for k in range(7):
        x = base.copy()
        added = np.zeros(x.shape)
        added.T[missing.T] = borrowed[:, k]
        np.testing.assert_allclose(got[k], (x + added).T @ (x + added), rtol=1e-10, atol=1e-10)
    np.testing.assert_allclose(donors._grams(base, np.zeros_like(missing), np.zeros((0, 7))), np.repeat((base.T @ base)[None], 7, axis=0))


def test_draws_of_many_cells():
    cells = [f"1|{row}|x1" for row in range(5000)]
    many = donors.draws_of(cells, 5, 3000)
    np.testing.assert_array_equal(many, [donors.draws(c.rpartition("|")[0], "x1", 5, 3000) for c in cells])
