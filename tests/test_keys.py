"""Null groups, codes for missing values, limits of the searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmend.functions.quantiles import norm_ppf, t_ppf
from rowmend.operators import gaps, inject, pca, scaling
from rowmend.plans.fill import fill_als, fill_missing, run_all
from rowmend.sources import tables
from tests.helpers import back, holes, low_rank, names, to_spark

COLS = names(4)


@pytest.fixture(scope="module")
def grouped(spark):
    x = holes(low_rank(600, 4, 2), 0.1)
    key = F.col("row_id") % 3
    return to_spark(spark, x).withColumn("g", F.when(key > 0, key)).cache()


@pytest.mark.parametrize("kind", [1, 2, 3, 4, 5])
def test_a_null_group_is_a_group(spark, grouped, kind):
    full = gaps.impute_mean(grouped, COLS, ["g"])
    assert full.count() == 600 and full.where(" or ".join(f"{c} is null" for c in COLS)).count() == 0
    out = inject.inject(full, COLS, kind, 0.2, 0.05, seed=kind, group_cols=["g"])
    rates = {r.g: r.missing_rate for r in inject.missing_rate(out, COLS, ["g"]).collect()}
    assert out.count() == 600 and set(rates) == {None, 1, 2} and all(0.05 < x < 0.4 for x in rates.values())


def test_null_groups_in_scaling_charts_and_fits(grouped):
    assert scaling.autoscale(grouped, COLS, group_cols=["g"]).count() == 600
    full = gaps.impute_mean(grouped, COLS, ["g"])
    models = pca.fit_pca(full, COLS, 2, group_cols=["g"], lim=0.5)
    found = {r.g for r in pca.row_control_chart(full, models, ["g"]).select("g").distinct().collect()}
    assert found == {None, 1, 2}
    filled = fill_missing(grouped, COLS, "PPCA", 2, prefill="mean", group_cols=["g"], max_iter=3, max_rounds=0).df
    assert filled.count() == 600 and filled.where("x1 is null").count() == 0


def test_grouped_als_equals_separate_fits(spark, grouped):
    options = dict(candidates=2, max_iter=4, prefill="mean")
    together = fill_als(grouped, COLS, 2, group_cols=["g"], **options)
    assert set(together.components) == {(None,), (1,), (2,)}
    for key in (None, 1, 2):
        own = grouped.where(F.col("g").eqNullSafe(F.lit(key)))
        alone = fill_als(own.drop("g"), COLS, 2, **options)
        assert np.allclose(back(together.df.where(F.col("g").eqNullSafe(F.lit(key))), COLS), back(alone.df, COLS), atol=1e-6)
    status = run_all(grouped, COLS, 2, ["ALS"], group_cols=["g"], max_iter=3)["ALS"]
    assert status.status == "ok" and set(status.components) == set(together.components)


def test_grouped_comparison_and_grid(spark):
    from rowmend.plans.compare import compare_algorithms
    from rowmend.plans.grid import experiment_grid
    x = low_rank(120, 4, 1)
    truth = to_spark(spark, x).withColumn("g", F.when(F.col("row_id") % 2 == 0, 1))
    masked = inject.inject_mcar(truth, COLS, 0.1, 0.02, 1, group_cols=["g"])
    wide, _ = compare_algorithms(masked, COLS, 1, algorithms=["MI", "PPCA"], truth=truth, group_cols=["g"], max_iter=2, max_rounds=0, with_time=False)
    assert {(r.g, r.algorithm) for r in wide.collect()} == {(g, a) for g in (None, 1) for a in ("MI", "PPCA")}
    grid = experiment_grid(truth, COLS, sims=2, miss_types=[1], algorithms=["ALS"], components=1, with_time=False, max_iter=2, level=0.1, tol=0.02)
    assert {(r.sim, r.algorithm) for r in grid.select("sim", "algorithm").distinct().collect()} == {(1, "ALS"), (2, "ALS")}


def test_codes_and_thresholds(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(0.0, 1.0, 999.0), (1.0, 1500.0, 2.0)], "t double, a double, b double").write.parquet(path)
    rows = lambda **k: [tuple(r) for r in tables.read_matrix(spark, path, **k).orderBy("t").collect()]
    assert rows(sentinel=999) == [(0.0, 1.0, None), (1.0, 1500.0, 2.0)]
    assert rows(above=900) == [(0.0, 1.0, None), (1.0, None, 2.0)]


@pytest.mark.parametrize("mode", inject.MULTIRATE_MODES)
def test_multirate_counts_gaps_once(spark, mode):
    df = to_spark(spark, holes(low_rank(2000, 6, 2), 0.1, 5))
    out = inject.inject_multirate(df, names(6), 0.3 if mode == "drop_every" else 0.45, 0.02, 3, mode)
    assert abs(inject.missing_rate(out, names(6)).first()[0] - (0.3 if mode == "drop_every" else 0.45)) <= 0.02


def test_censoring_of_values_far_out(spark):
    x = np.ones((4000, 2)) + np.random.default_rng(0).normal(size=(4000, 2)) * 1e-3
    x[:4] = 1e6
    df = to_spark(spark, x)
    out = inject.inject_censoring(df, names(2), 0.3, 0.02, 1)
    assert 0.0 <= inject.missing_rate(out, names(2)).first()[0] <= 1.0 and out.count() == 4000


def test_student_quantiles_of_many_degrees_of_freedom():
    values = [t_ppf(0.9999, n) for n in (30, 1000, 9_999, 10_000, 10**6, 10**10, 10**12)]
    assert values == sorted(values, reverse=True) and all(v > norm_ppf(0.9999) for v in values)
    assert t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-10)
    assert t_ppf(0.9999, 10_000) == pytest.approx(t_ppf(0.9999, 9_999), rel=1e-6)


@pytest.fixture(scope="module")
def three_groups(spark):
    """Groups with very different spread, one of them null; the last shares its row ids with the first."""
    x = low_rank(360, 4, 1, 0.5)
    x[1::3] *= 100
    truth = to_spark(spark, x).withColumn("g", F.element_at(F.array(F.lit("p"), F.lit("q"), F.lit(None)), (F.col("row_id") % 3 + 1).cast("int")))
    truth = truth.withColumn("row_id", F.when(F.col("g").isNull(), F.col("row_id") - 2).otherwise(F.col("row_id"))).cache()
    masked = inject.inject_mcar(truth, COLS, 0.15, 0.02, 1, group_cols=["g"]).cache()
    return truth, masked, gaps.impute_mean(masked, COLS, ["g"]).cache()


def test_every_group_is_scored_like_a_table_of_its_own(spark, three_groups):
    from rowmend.operators import evaluate as ev
    truth, masked, filled = three_groups
    bounds = spark.createDataFrame([(c, -3.0, 3.0) for c in COLS], "variable string, lb double, ub double")
    keys, g = ["g", "row_id"], ["g"]

    def own(df, key):
        return df.where(F.col("g").eqNullSafe(F.lit(key))).drop("g")

    scores = {(r.g, r.variable): r.nrmse for r in ev.nrmse(filled, truth, masked, COLS, keys, keys, g).collect()}
    inside = {r.g: r.feasibility for r in ev.feasibility(filled, masked, bounds, COLS, keys, g).collect()}
    odd = {r.g: r.plausibility for r in ev.plausibility(filled, masked, COLS, 1, keys, g, lim=0.9).collect()}
    missed = {r.g: r.rmse for r in ev.missing_nrmse(filled, truth, masked, COLS, keys, g).collect()}
    assert set(inside) == set(odd) == set(missed) == {"p", "q", None} and len(scores) == 15
    for key in ("p", "q", None):
        parts = own(filled, key), own(truth, key), own(masked, key)
        for r in ev.nrmse(*parts, COLS).collect():
            assert scores[key, r.variable] == pytest.approx(r.nrmse, rel=1e-9)
        assert inside[key] == ev.feasibility(parts[0], parts[2], bounds, COLS).first()[0]
        assert odd[key] == ev.plausibility(parts[0], parts[2], COLS, 1, lim=0.9).first()[0]
        assert missed[key] == pytest.approx(ev.missing_nrmse(*parts, COLS).first().rmse, rel=1e-9)


def test_reports_and_holdout_by_group(spark, three_groups):
    from rowmend.operators import evaluate as ev
    from rowmend.operators import selection
    from rowmend.plans.compare import holdout_reestimate
    truth, masked, filled = three_groups
    labelled = selection.relabel(selection.label_missing(masked, COLS), COLS, {selection.MISSING: selection.IMPUTED})
    counts = {(r.g, r.variable, r.label): r.n for r in ev.label_counts(labelled, COLS, ["g"]).collect()}
    pairs = ev.before_after(labelled, filled, COLS, group_cols=["g"]).collect()
    assert len(pairs) == sum(n for (_, v, lab), n in counts.items() if v is None and lab == selection.IMPUTED)
    for key in ("p", "q", None):
        part = labelled.where(F.col("g").eqNullSafe(F.lit(key)))
        assert {(r.variable, r.label): r.n for r in ev.label_counts(part, COLS).collect()} == {k[1:]: n for k, n in counts.items() if k[0] == key}
    scores = {r.g: r.nrmse for r in holdout_reestimate(truth, COLS, "PPCA", 1, 0.1, group_cols=["g"], prefill="mean", max_iter=5, max_rounds=0).collect()}
    assert set(scores) == {"p", "q", None} and all(0 < s < 1 for s in scores.values())


@pytest.mark.parametrize("split", [None, 40])
def test_a_large_null_group_is_cut_like_any_other(spark, three_groups, split):
    _, masked, _ = three_groups
    out = gaps.impute_interpolate(masked, COLS, group_cols=["g"], max_rows=split)
    alone = gaps.impute_interpolate(masked.where("g is null"), COLS)
    assert np.allclose(back(out.where("g is null"), COLS), back(alone, COLS))
    if split:
        from rowmend.operators.ordering import BUCKET, with_buckets
        cut, _ = with_buckets(masked, ("t", "row_id"), ["g"], split)
        assert cut.where("g is null").select(BUCKET).distinct().count() > 1
