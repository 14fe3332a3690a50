"""Headline timings; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
`rows_per_sec` is rows of the order matrix over the whole time of an operator, `sec_per_iteration` that time over its iterations.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowmend.operators import gaps, inject, pca  # noqa: E402
from rowmend.operators.components import select_components  # noqa: E402
from rowmend.operators.outliers import detect_outliers  # noqa: E402
from rowmend.plans import fixtures as fx  # noqa: E402
from rowmend.plans.fill import fill_missing  # noqa: E402
from rowmend.session import get_spark, release_kept  # noqa: E402

V = fx.OM_VARIABLES
ITERATIONS = 10
ALGORITHMS = ("MI", "Alternating", "SVDImpute", "PCADA", "PPCA", "PPCA-M", "BPCA", "SVT", "ALM", "ALS")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(os.environ.get("BENCH_CPUS", "8"), "bench")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    # warm the JVM and the Python workers on the smallest cut
    small = sf_dir.replace("sf0.1", "sf0.001")
    warm = fx.masked(fx.order_matrix(spark, small if os.path.isdir(small) else sf_dir), V)
    drain(fill_missing(warm, V, "PPCA", 1, max_iter=1, max_rounds=0).df)
    release_kept()

    om = fx.order_matrix(spark, sf_dir).persist()
    rows = timed("order_matrix", lambda: om.count())
    masked = fx.masked(om, V).persist()
    timed("inject_mcar", lambda: masked.count())
    timed("impute_interpolate", lambda: drain(gaps.impute_interpolate(masked, V)))
    series = fx.masked(fx.event_series(spark, sf_dir), ["x"]).persist()
    series.count()
    timed("impute_interpolate_series", lambda: drain(gaps.impute_interpolate(series, ["x"], group_cols=["series"])))
    filled = gaps.impute_mean(masked, V).persist()
    filled.count()
    models = timed("pca_fit", lambda: pca.fit_pca(filled, V, 2, contrib="2D-Chiang", lim=0.999))
    timed("pca_score", lambda: drain(pca.score_rows(filled, models, ("T_sq", "SRE", "T_sq_con", "SRE_con"))))
    timed("select_components", lambda: select_components(filled, V, 5, 10))
    spiked = fx.masked(fx.spiked(om, V), V).persist()
    spiked.count()
    timed("outlier_round", lambda: detect_outliers(spiked, V, max_iter=1, num_repeat=10))
    for name in ALGORITHMS:
        def run(name=name):
            result = fill_missing(masked, V, name, 2, max_iter=ITERATIONS, max_rounds=0)
            drain(result.df)
        timed(f"fill_{name.lower().replace('-', '')}", run)
        release_kept()
    for kind, label in inject.MISS_TYPES.items():
        timed(f"inject_{label}", lambda k=kind: drain(inject.inject(om, V, k, 0.1, 0.001, seed=k)))

    per_iteration = {k: round(t / ITERATIONS, 3) for k, t in times.items() if k.startswith("fill_") and k != "fill_mi"}
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
            "cores": spark.sparkContext.defaultParallelism, "rows": rows,
            "rows_per_sec": {k: round(rows / t) for k, t in times.items() if t}, "sec_per_iteration": per_iteration}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
