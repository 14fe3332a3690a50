import numpy as np
import pytest

from rowmend.operators import gaps
from rowmend.operators.ordering import BUCKET, WHOLE, with_buckets, with_position

from .helpers import back, holes, names, to_spark

NAN = np.nan


def brute(x, t, method):
    out = x.copy()
    for j in range(x.shape[1]):
        seen = np.flatnonzero(~np.isnan(x[:, j]))
        for i in np.flatnonzero(np.isnan(x[:, j])):
            before, after = seen[seen < i], seen[seen > i]
            if not len(seen):
                continue
            if not len(before):
                out[i, j] = x[after[0], j]
            elif method == "last_observed" or not len(after):
                out[i, j] = x[before[-1], j]
            else:
                a, b = before[-1], after[0]
                out[i, j] = x[a, j] if t[a] == t[b] else x[a, j] + (x[b, j] - x[a, j]) * (t[i] - t[a]) / (t[b] - t[a])
    return out


def test_edges_of_a_series(spark):
    x = np.array([[NAN, 1.0, NAN], [2.0, NAN, NAN], [NAN, NAN, NAN], [4.0, 7.0, NAN], [NAN, NAN, NAN]])
    t = np.array([0.0, 1.0, 1.5, 3.0, 9.0])
    df = to_spark(spark, x, t)
    filled = back(gaps.impute_interpolate(df, names(3)), names(3))
    np.testing.assert_allclose(filled[:, 0], [2, 2, 2.5, 4, 4])
    np.testing.assert_allclose(filled[:, 1], [1, 3, 4, 7, 7])
    assert np.isnan(filled[:, 2]).all()
    last = back(gaps.impute_locf(df, names(3)), names(3))
    np.testing.assert_allclose(last[:, 0], [2, 2, 2, 4, 4])


def test_equal_times_take_the_earlier_value(spark):
    df = to_spark(spark, [[1.0], [NAN], [5.0]], [2.0, 2.0, 2.0])
    np.testing.assert_allclose(back(gaps.impute_interpolate(df, ["x1"]), ["x1"])[:, 0], [1, 1, 5])


def test_single_row_and_linear_series(spark):
    assert back(gaps.impute_interpolate(to_spark(spark, [[3.0]]), ["x1"]), ["x1"]).item() == 3.0
    line = np.arange(50.0)[:, None] * 2 + 1
    gapped = line.copy()
    gapped[5:20] = NAN
    np.testing.assert_allclose(back(gaps.impute_interpolate(to_spark(spark, gapped), ["x1"]), ["x1"]), line)


@pytest.mark.parametrize("method", ["interpolation", "last_observed"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_buckets_and_ties_do_not_change_results(spark, method, partitions):
    rng = np.random.default_rng(0)
    t = np.sort(rng.integers(0, 40, 500)).astype(float)
    t[100:300] = t[100]  # one time stamp holds more rows than a bucket
    x = holes(rng.normal(size=(500, 3)), 0.4)
    x[120:320, 1] = NAN  # a gap longer than several buckets
    df = to_spark(spark, x, np.sort(t), partitions=partitions)
    got = back(gaps.impute(df, names(3), method, max_rows=40), names(3))
    np.testing.assert_allclose(got, brute(x, np.sort(t), method))


def test_hot_group_is_split_and_small_groups_are_not(spark):
    rng = np.random.default_rng(4)
    g = np.where(rng.random(900) < 0.6, 0, rng.integers(1, 9, 900))
    x = holes(rng.normal(size=(900, 2)), 0.3)
    df = to_spark(spark, x, extra={"g": g})
    marked, split = with_buckets(df, ("t", "row_id"), ["g"], max_rows=100)
    counts = {(r["g"], r[BUCKET]): r["count"] for r in marked.groupBy("g", BUCKET).count().collect()}
    assert split
    assert len([k for k in counts if k[0] == 0]) > 3
    assert max(counts.values()) < 300
    assert all(b == WHOLE for g_, b in counts if g_ != 0)
    got = back(gaps.impute(df, names(2), "interpolation", group_cols=["g"], max_rows=100), names(2))
    for k in range(9):
        rows = np.flatnonzero(g == k)
        np.testing.assert_allclose(got[rows], brute(x[rows], rows.astype(float), "interpolation"))


def test_gap_islands_across_buckets(spark):
    x = np.ones((200, 1))
    x[0:3] = x[10:150] = x[199] = NAN
    expected = {(0.0, 2.0, 3), (10.0, 149.0, 140), (199.0, 199.0, 1)}
    for max_rows in (None, 20):
        rows = gaps.gap_islands(to_spark(spark, x), ["x1"], max_rows=max_rows).collect()
        assert {(r["start_t"], r["end_t"], r["length"]) for r in rows} == expected


def test_positions(spark):
    df = to_spark(spark, np.zeros((300, 1)), np.repeat(np.arange(100.0), 3))
    for max_rows in (None, 25):
        rows = with_position(df, max_rows=max_rows).orderBy("row_id").collect()
        assert [r["pos"] for r in rows] == list(range(300))


def test_mean_and_unknown_method(spark):
    df = to_spark(spark, [[1.0, 5.0], [NAN, NAN], [3.0, 5.0]])
    np.testing.assert_allclose(back(gaps.impute(df, names(2), "mean"), names(2))[1], [2, 5])
    with pytest.raises(ValueError):
        gaps.impute(df, names(2), "spline")


def test_split_plan_shuffles_rows_once(spark):
    df = to_spark(spark, holes(np.random.default_rng(0).normal(size=(400, 2))))
    plan = gaps.impute_interpolate(df, names(2), max_rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SortAggregate" not in plan


def test_checkpoint_keeps_the_partitioning(spark):
    from rowmend.session import cut_lineage
    df = to_spark(spark, holes(np.random.default_rng(0).normal(size=(400, 2))))
    marked, _ = with_buckets(df, ("t", "row_id"), max_rows=50)
    stored = cut_lineage(marked.repartition(8, BUCKET), keep_partitioning=True)
    plan = gaps.impute(stored, names(2), "interpolation", split=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
