import numpy as np
import pytest

from rowmend.operators.impute import ALGORITHMS, engine, patterns
from rowmend.plans.fill import fill_als, fill_missing

from .helpers import back, holes, low_rank, names, to_spark

COLS = names(5)
ITERATED = sorted(set(ALGORITHMS) - {"PCADA", "ALS"})


@pytest.fixture(scope="module")
def data(spark):
    x = holes(low_rank(400, 5, 2, 0.3), 0.2)
    x[7] = np.nan  # a pattern without any observed cell
    return to_spark(spark, x, extra={"g": np.arange(400) % 2})


def _fit(df, name, **options):
    if name == "SVT":
        options["tau"] = 40.0
    return fill_missing(df, COLS, name, {(0,): 1, (1,): 2}, group_cols=["g"], max_iter=12, **options)


@pytest.mark.parametrize("prefill", ["mean", "interpolation"])
@pytest.mark.parametrize("name", ITERATED)
def test_patterns_give_the_sums_of_the_rows(data, name, prefill, monkeypatch):
    short = _fit(data, name, prefill=prefill, max_rounds=2, num_repeat=2)
    monkeypatch.setattr(patterns, "MAX_NUMBERS", 0)
    rows = _fit(data, name, prefill=prefill, max_rounds=2, num_repeat=2)
    np.testing.assert_allclose(back(short.df, COLS), back(rows.df, COLS), rtol=1e-7)
    assert short.components == rows.components
    assert [(t["group"], t["round"], t["iteration"], t["metric"]) for t in short.trace] == \
        [(t["group"], t["round"], t["iteration"], t["metric"]) for t in rows.trace]
    np.testing.assert_allclose([t["value"] for t in short.trace], [t["value"] for t in rows.trace], rtol=1e-5, atol=1e-9)


@pytest.mark.parametrize("name", ITERATED)
def test_iterations_do_not_pass_over_the_rows(data, name, monkeypatch):
    """Every iteration was a pass over the table before."""
    def refuse(*_):
        raise AssertionError("an iteration reads the rows")

    monkeypatch.setattr(engine, "sum_stats", refuse)
    monkeypatch.setattr(engine, "REPLAY_LIMIT", 2)
    monkeypatch.setattr(engine, "store_state", refuse)
    assert back(_fit(data, name, max_rounds=0).df, COLS).shape == (400, 5)


def test_random_starts_share_the_patterns(data, monkeypatch):
    short = fill_als(data, COLS, 1, candidates=3, max_iter=15)
    monkeypatch.setattr(patterns, "MAX_NUMBERS", 0)
    rows = fill_als(data, COLS, 1, candidates=3, max_iter=15)
    np.testing.assert_allclose(back(short.df, COLS), back(rows.df, COLS), rtol=1e-7)
