import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmend.functions.draws import uniform, uniform_value
from rowmend.operators import evaluate, inject, selection
from rowmend.operators.outliers import detect_outliers
from rowmend.plans.clean import clean
from rowmend.plans.grid import experiment_grid, summarise_grid
from rowmend.plans.waves import in_waves
from rowmend.sources import tables

from .helpers import back, low_rank, names, to_spark

V = 8
COLS = names(V)


@pytest.fixture(scope="module")
def complete(spark):
    return to_spark(spark, low_rank(2000, V, 2, 0.3)).persist()


def rate(df):
    return inject.missing_rate(df, COLS).first()[0]


def test_draws_agree_between_engine_and_driver(spark):
    got = spark.range(20).select(uniform(5, F.col("id"), "x").alias("u")).collect()
    assert [r["u"] for r in got] == [uniform_value(5, i, "x") for i in range(20)]
    big = spark.range(20000).select(*[uniform(1, F.col("id"), slot=k).alias(f"u{k}") for k in range(4)])
    means = big.agg(*[F.avg(f"u{k}") for k in range(4)]).first()
    assert all(abs(m - 0.5) < 0.01 for m in means)


@pytest.mark.parametrize("kind", [1, 2, 3, 4, 5])
def test_injection_reaches_the_level(complete, kind):
    tol = 0.02 if kind == 3 else 0.004
    got = inject.inject(complete, COLS, kind, 0.1, tol, seed=kind)
    assert abs(rate(got) - 0.1) <= tol
    assert got.columns == complete.columns
    again = inject.inject(complete.repartition(13), COLS, kind, 0.1, tol, seed=kind)
    np.testing.assert_array_equal(np.isnan(back(got, COLS)), np.isnan(back(again, COLS)))


@pytest.mark.parametrize("kind", [1, 2, 3, 4, 5])
def test_grouped_injection(spark, kind):
    df = to_spark(spark, low_rank(1200, V, 2, 0.3), extra={"g": np.arange(1200) % 2})
    tol = 0.03 if kind == 3 else 0.006
    got = inject.inject(df, COLS, kind, 0.1, tol, seed=kind, group_cols=["g"])
    rates = [r["missing_rate"] for r in inject.missing_rate(got, COLS, ["g"]).collect()]
    assert len(rates) == 2 and all(abs(r - 0.1) <= tol for r in rates)


def test_dropout_runs_and_existing_gaps(complete):
    got = inject.inject(complete, COLS, 2, 0.05, 0.004, seed=9)
    gaps = np.isnan(back(got, COLS))
    assert gaps.any(0).sum() > 3
    some = inject.mcar_cells(complete, COLS, 0.03, seed=1)
    for kind in (1, 2):
        more = inject.inject(some, COLS, kind, 0.1, 0.005, seed=4)
        assert abs(rate(more) - 0.1) <= 0.005
        assert (np.isnan(back(some, COLS)) <= np.isnan(back(more, COLS))).all()


def test_low_level_multirate_keeps_every_fourth_row(complete):
    got = np.isnan(back(inject.inject(complete, COLS, 3, 0.01, 0.001, seed=2), COLS))
    hit = np.flatnonzero(gap := got.any(0))
    assert gap.sum() == 1
    assert not got[::4, hit[0]].any() and got[1::4, hit[0]].all()


def test_multirate_modes(complete):
    with pytest.raises(ValueError):
        inject.inject_multirate(complete, COLS, 0.1, mode="other")
    kept = inject.inject_multirate(complete, COLS, 0.1, 0.02, mode="keep_every", seed=1)
    assert abs(rate(kept) - 0.1) < 0.06


def test_outliers_are_found_protected_and_sticky(spark):
    x = low_rank(1500, V, 2, 0.1)
    clean_x = x.copy()
    rng = np.random.default_rng(2)
    cells = [(int(r), int(rng.integers(V))) for r in rng.choice(np.arange(50, 1500), 12, replace=False)]
    for r, c in cells:
        x[r, c] += 12 * x[:, c].std()
    x[3, 2] += 15 * x[:, 2].std()  # inside the protected period
    df = to_spark(spark, x, np.arange(1500) / 2.0)
    found = detect_outliers(df, COLS, num_repeat=2, max_iter=8, lim=0.9999)
    labels = found.labelled.select("row_id", *[selection.label(v) for v in COLS]).toPandas().sort_values("row_id")
    flagged = {(int(r), j) for r, row in zip(labels["row_id"], labels[[selection.label(v) for v in COLS]].to_numpy())
               for j, value in enumerate(row) if value == "outlier"}
    assert set(cells) <= flagged
    assert not any(r <= 13 for r, _ in flagged)
    assert found.trace[-1]["new_outliers"] == 0 or len(found.trace) == 8
    np.testing.assert_allclose(back(found.labelled, COLS), x)
    split = detect_outliers(df, COLS, num_repeat=2, max_iter=8, lim=0.9999, max_rows=200)
    assert split.trace == found.trace
    assert clean_x.shape == x.shape


def test_clean_pipeline(spark):
    x = low_rank(600, V, 2, 0.1)
    x[100] = np.nan
    x[200, 3] += 8 * np.nanstd(x[:, 3])
    result = clean(to_spark(spark, x, np.arange(600) / 2.0), COLS, condition=F.col("t") < 250, num_repeat=1, max_iter=3,
                   min_elements=1)
    gone = result.labelled.filter("label_x1 = 'removed'").count()
    assert result.labelled.count() == 500 and 1 <= gone <= 2 and result.ready.count() == 500 - gone
    ready = result.ready.toPandas()
    for v in COLS:
        assert (ready[v].isna() == (ready[selection.label(v)] != "observed")).all()
        assert set(ready[selection.label(v)]) <= {"observed", "imputed", "replaced"}
    spike = result.labelled.filter("row_id = 200").first()
    assert spike["x4"] == pytest.approx(x[200, 3]) and spike["label_x4"] in ("outlier", "removed")
    removed = result.labelled.filter("row_id = 100").first()
    assert all(removed[selection.label(v)] == "removed" for v in COLS)
    with pytest.raises(ValueError):
        clean(to_spark(spark, x), COLS, mask=[True])


def test_selection_checks(spark, complete):
    with pytest.raises(ValueError):
        selection.select_variables(complete, COLS, [True])
    assert selection.select_variables(complete, COLS, [True] + [False] * 7, ["t"]).columns == ["t", "x1"]


def test_reading(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(0.0, 1.0, 999.0), (1440.0, float("nan"), 2.0), (2880.0, 3.0, None)],
                          "Time double, a double, b double").coalesce(1).write.csv(path, header=True)
    df = tables.read_matrix(spark, path, fmt="csv", time_unit="minutes", above=900.0)
    rows = sorted(tuple(r) for r in df.select("t", F.coalesce("a", F.lit(-1.0)), F.coalesce("b", F.lit(-1.0))).collect())
    assert rows == [(0.0, 1.0, -1.0), (1.0, -1.0, 2.0), (2.0, 3.0, -1.0)]
    with pytest.raises(ValueError):
        tables.read_matrix(spark, path, time_unit="weeks")


def test_nrmse_joins_by_row_and_scores_zero_without_gaps(spark):
    truth = np.array([[1.0, 5.0], [3.0, 5.5], [5.0, 7.0]])
    gapped = truth.copy()
    gapped[1, 0] = np.nan
    filled = np.where(np.isnan(gapped), 4.0, gapped)
    args = (to_spark(spark, filled).filter("row_id > 0"), to_spark(spark, truth), to_spark(spark, gapped), names(2))
    got = {r["variable"]: r["nrmse"] for r in evaluate.nrmse(*args).collect()}
    assert got["x1"] == pytest.approx(1 / truth[:, 0].std()) and got["x2"] == 0.0
    assert got[None] == pytest.approx(got["x1"])


def test_grid_with_step_a_and_summary(spark):
    df = to_spark(spark, low_rank(400, 4, 1, 0.3))
    out = experiment_grid(df, names(4), sims=2, miss_types=(1, 4), algorithms=("MI", "PPCA"), tol=0.02, step_a=True,
                          cross_validation={"num_repeat": 1}, detect={"max_iter": 2}, max_iter=3, max_rounds=1).persist()
    rows = out.collect()
    assert {(r["sim"], r["miss_type"]) for r in rows} == {(s, m) for s in (1, 2) for m in (1, 4)}
    assert {r["metric"] for r in rows} == {"nrmse", "plausibility", "components", "rapidity"}
    summary = summarise_grid(out)
    assert summary.count() == 2 * 2 * (3 + 5)
    assert summary.filter("lower > mean").count() == 0


def test_waves_cover_all_groups(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 17)
    got = in_waves(df, ["g"], 4, lambda part: part.groupBy("g").count())
    assert sorted(r["g"] for r in got.collect()) == list(range(17))
