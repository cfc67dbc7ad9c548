"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from checks.compare import session
from ledgersift.functions import minor_units
from ledgersift.operators import features as prep
from ledgersift.operators.autoencoder import autoencoder_sample
from ledgersift.operators.clustering import kmeans_sample
from ledgersift.operators.isolation import isolation_forest_sample
from ledgersift.operators.neighbours import approximate_knn_search, distinct_points
from ledgersift.operators.monetary import mus_sample
from ledgersift.operators.outlier_factor import lof_sample
from ledgersift.operators.random_sampling import random_sample, systematic_sample
from ledgersift.operators.ranking import prefix_sum, with_row_key
from ledgersift.operators.stratified import stratified_sample
from ledgersift.operators.summaries import strata_comparison

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = session(CPUS)

    def table(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    def done(df):
        df.write.format("noop").mode("overwrite").save()

    orders, events, lines, parts = table("orders"), table("events"), table("lineitem"), table("part")
    # lineitem has no unique key; all its columns together are one.
    keyed_lines = lines.withColumn("line_id", F.xxhash64(*lines.columns))
    _, plan = prep.fit_features(lines, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"])
    line_features = keyed_lines.select("line_id", plan.vector().alias("features"))
    part_points = parts.select(
        "p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("features")
    )
    _, order_plan = prep.fit_features(orders, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])
    order_features = orders.select("o_orderkey", order_plan.vector().alias("features"))
    # More distinct points than a broadcast holds, so the blocks are timed.
    some_lines = line_features.where("line_id % 10 = 0")

    def prepare():
        rows, fitted = prep.fit_features(
            lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]
        )
        done(fitted.apply(rows))

    runs = {
        "random_sample": lambda: done(random_sample(orders, 1_000, ["o_orderkey"], 42)),
        "systematic_sample": lambda: done(systematic_sample(events, 1_000, ["ts"], ["event_id"], 42)),
        "stratified_sample": lambda: done(stratified_sample(orders, 1_000, ["o_orderpriority"], ["o_orderkey"], 42)),
        "strata_comparison": lambda: done(
            strata_comparison(stratified_sample(orders, 1_000, ["o_orderpriority"], ["o_orderkey"], 42), "o_orderpriority")
        ),
        "mus_sample": lambda: done(mus_sample(orders, 1_000, "o_totalprice", ["o_orderkey"], seed=42)),
        "mus_stratified": lambda: done(
            mus_sample(orders, 1_000, "o_totalprice", ["o_orderkey"], threshold=100_000, strata=["o_orderstatus"], seed=42)
        ),
        "prefix_sum": lambda: done(prefix_sum(orders, minor_units(F.col("o_totalprice")), ["o_orderdate"], ["o_orderkey"])),
        "with_row_key": lambda: done(with_row_key(lines)),
        "prepare_features": prepare,
        "isolation_forest_sample": lambda: done(isolation_forest_sample(line_features, "features", 1_000, ["line_id"], 42)),
        # 100 trials on all rows: some 500 runs that move together.
        "kmeans_sample": lambda: done(kmeans_sample(order_features, "features", 1_000, ["o_orderkey"], 42)[0]),
        "autoencoder_sample": lambda: done(autoencoder_sample(line_features, "features", 1_000, ["line_id"], 42)),
        "lof_sample": lambda: done(lof_sample(part_points, "features", 100, "p_partkey")),
        "lof_sample_blocks": lambda: done(lof_sample(some_lines, "features", 100, "line_id")),
        "approximate_knn_join": lambda: done(approximate_knn_search(distinct_points(some_lines, "features", "line_id"), 5).pairs),
    }
    chosen = os.environ.get("BENCH_ONLY")
    times = {}
    for name, run in runs.items():
        if chosen and name not in chosen.split(","):
            continue
        at = time.time()
        run()
        times[name] = round(time.time() - at, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
