"""Distribution, invariance, and agreement with brute force on small data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersift.operators import order_statistics as stats
from ledgersift.operators.autoencoder import autoencoder_sample, pca_reconstruction_sample
from ledgersift.operators.clustering import kmeans_sample, nearest_centroid
from ledgersift.operators.density import (
    DensitySettings, cluster_labels, core_distances, dense_tree, density_cluster_sample, density_clusters,
    spanning_forest, spanning_tree,
)
from ledgersift.operators.features import fit_features
from ledgersift.operators.isolation import average_path, fit_forest, forest_score, isolation_forest_sample
from ledgersift.operators.monetary import mus_sample
from ledgersift.operators.neighbours import distinct_points, knn_join
from ledgersift.operators.outlier_factor import lof_sample
from ledgersift.operators.quality import silhouette
from ledgersift.operators.random_sampling import random_sample, systematic_sample
from ledgersift.operators.ranking import RangeBuckets, global_rank, prefix_sum
from ledgersift.operators.stratified import stratified_allocation, stratified_sample


def picked(df, key="o_orderkey"):
    return {r[key] for r in df.where("is_sample = 1").select(key).collect()}


@pytest.mark.parametrize("select", [
    lambda df: random_sample(df, 50, ["o_orderkey"], 5),
    lambda df: systematic_sample(df, 50, ["o_orderdate"], ["o_orderkey"], 5),
    lambda df: stratified_sample(df, 50, ["o_orderstatus"], ["o_orderkey"], 5),
    lambda df: mus_sample(df, 50, "o_totalprice", ["o_orderkey"], seed=5),
])
def test_selection_ignores_partitioning(orders, select):
    first, second = picked(select(orders)), picked(select(orders.repartition(7, "o_custkey")))
    assert len(first) == 50 and first == second


def test_inclusion_is_uniform(spark):
    """Over many seeds every row is drawn about equally often."""
    seeds, rows, n = 400, 40, 10
    grid = spark.range(rows).crossJoin(spark.range(seeds).withColumnRenamed("id", "seed"))
    drawn = grid.withColumn("h", F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.lit("srs"), F.col("id").cast("string"))))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("seed").orderBy("h"))
    freq = drawn.withColumn("r", rank).where(F.col("r") <= n).groupBy("id").count().collect()
    share, sigma = n / rows, math.sqrt(n / rows * (1 - n / rows) / seeds)
    assert all(abs(r["count"] / seeds - share) < 4.5 * sigma for r in freq)
    one = random_sample(spark.range(rows), n, ["id"], 7)
    assert picked(one, "id") == {r["id"] for r in drawn.where("seed = 7").orderBy("h").limit(n).collect()}


def test_inclusion_grows_with_value(spark):
    df = spark.range(60).withColumn("v", F.when(F.col("id") < 20, 1.0).when(F.col("id") < 40, 5.0).otherwise(10.0))
    hits = np.zeros(3)
    for seed in range(12):
        for i in picked(mus_sample(df, 12, "v", ["id"], seed=seed), "id"):
            hits[i // 20] += 1
    assert hits[0] < hits[1] < hits[2]


def test_allocation_is_close_to_proportional(orders):
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("stratum_size"))
    got = stratified_allocation(counts, ["o_custkey"], 211).collect()
    total = sum(r["stratum_size"] for r in got)
    assert sum(r["allocated"] for r in got) == 211
    assert all(abs(r["allocated"] - 211 * r["stratum_size"] / total) < 1 for r in got)


def test_many_strata_use_distributed_tables(orders, monkeypatch):
    """Above the broadcast limit the same rows are selected with shuffled joins."""
    near = picked(stratified_sample(orders, 400, ["o_custkey"], ["o_orderkey"], 5))
    from ledgersift import cluster

    far_limit = lambda df, max_rows=10: (df, False)
    for module in ("order_statistics", "stratified", "ranking"):
        monkeypatch.setattr(f"ledgersift.operators.{module}.bounded", far_limit)
    assert cluster.BROADCAST_ROWS
    assert picked(stratified_sample(orders, 400, ["o_custkey"], ["o_orderkey"], 5)) == near


@pytest.mark.parametrize("n", [1, 17, 400, 999, 1000])
def test_kth_cut_matches_sort(spark, n):
    """One score value holds a third of the rows."""
    df = spark.range(1_000).withColumn("s", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.sin("id") * F.pow(F.lit(10.0), F.col("id") % 5)))
    got = picked(stats.top_n_by_score(df, "s", n, ["id"]), "id")
    assert got == {r["id"] for r in df.orderBy("s", "id").limit(n).collect()}


def test_rank_with_one_value_on_most_rows(spark):
    df = spark.range(5_000).withColumn("k", F.when(F.col("id") % 10 < 7, "same").otherwise(F.col("id").cast("string")))
    plan = RangeBuckets.plan(df, ["k"], ["id"], 5_000, buckets=16)
    sizes = [r["__rows"] for r in plan.totals(df).collect()]
    assert max(sizes) < 3 * 5_000 / 16
    ranked = global_rank(df, ["k"], ["id"])
    expected = {r["id"]: i for i, r in enumerate(df.orderBy("k", "id").collect())}
    assert {r["id"]: r["position"] for r in ranked.collect()} == expected


def test_prefix_sum_with_nulls_in_the_order(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") % 4 != 0, F.col("id") % 9))
    got = {r["id"]: r["running_total"] for r in prefix_sum(df, F.col("id"), ["k"], ["id"]).collect()}
    total = 0
    for r in df.orderBy("k", "id").collect():
        total += r["id"]
        assert got[r["id"]] == total


def blobs(spark, per=80, outliers=6, seed=3):
    """Three tight groups, a few far points, and some exact copies."""
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [6, 6, 0], [0, 6, 6]], dtype=float)
    x = np.concatenate([c + rng.normal(0, 0.4, (per, 3)) for c in centres])
    x = np.concatenate([x, x[:5], x[:5], rng.uniform(25, 60, (outliers, 3)) * rng.choice([-1, 1], (outliers, 3))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, features array<double>").repartition(4), x, outliers


def brute_neighbours(x, k):
    pid = {}
    for i, r in enumerate(map(tuple, x)):
        pid.setdefault(r, i)
    rep = np.array([pid[tuple(r)] for r in x])
    out = {}
    for p in sorted(set(rep)):
        d = np.sqrt(((x - x[p]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), rep, d)) if i != p][:k]
        taken = {}
        for i in order:
            taken[rep[i]] = taken.get(rep[i], 0) + 1
        out[p] = (taken, d[order[-1]])
    return out


@pytest.mark.parametrize("limits", [{}, {"broadcast_points": 0, "block_rows": 32}, {"broadcast_points": 0, "block_rows": 7}])
def test_neighbours_match_brute_force(spark, limits):
    df, x, _ = blobs(spark)
    near = knn_join(distinct_points(df, "features", "id"), 9, **limits).collect()
    expected = brute_neighbours(x, 9)
    got = {}
    for r in near:
        got.setdefault(r["a"], {})[r["b"]] = r["take"]
    assert got == {int(a): {int(b): n for b, n in t.items()} for a, (t, _) in expected.items()}


def far_points(df, x, outliers):
    return set(range(len(x) - outliers, len(x)))


@pytest.mark.parametrize("select", [
    lambda df, n: isolation_forest_sample(df, "features", n, ["id"], 1),
    lambda df, n: lof_sample(df, "features", n, "id"),
    lambda df, n: autoencoder_sample(df, "features", n, ["id"], 1, epochs=3),
    lambda df, n: pca_reconstruction_sample(df, "features", n, ["id"], 1),
])
def test_planted_outliers_are_selected(spark, select):
    df, x, outliers = blobs(spark)
    found = picked(select(df, outliers), "id")
    assert len(found) == outliers
    assert len(found & far_points(df, x, outliers)) >= outliers - 1


def test_forest_scores_are_centred_on_even_data(spark):
    df = spark.range(4_000).select("id", F.array(F.col("id") / 4_000.0).alias("features"))
    row = isolation_forest_sample(df, "features", 10, ["id"], 1).agg(F.min("anomaly_score"), F.max("anomaly_score"), F.avg("anomaly_score")).first()
    assert -0.5 < row[0] and row[1] < 0.5 and abs(row[2]) < 0.05
    assert float(average_path(256)) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_forest_scores_match_a_plain_walk(spark):
    df, x, _ = blobs(spark, per=120)
    nodes = fit_forest(df, "features", ["id"], 5, trees=7).collect()
    trees = {}
    for r in nodes:
        trees.setdefault(r["tree"], {})[r["node"]] = r
    scored = df.withColumn("s", forest_score(fit_forest(df, "features", ["id"], 5, trees=7), len(x), "features"))
    for r in scored.collect():
        total = 0.0
        for tree in trees.values():
            at = 0
            while tree[at]["feature"] >= 0:
                at = 2 * at + (1 if r["features"][tree[at]["feature"]] <= tree[at]["threshold"] else 2)
            total += tree[at]["path"]
        assert r["s"] == pytest.approx(0.5 - 2 ** (-total / 7 / float(average_path(256))))


def test_kmeans_finds_the_groups(spark):
    df, x, outliers = blobs(spark, outliers=0)
    flagged, trials = kmeans_sample(df, "features", 9, ["id"], 1)
    assert flagged.select("cluster").distinct().count() == 3
    assert len(picked(flagged, "id")) == 9
    best = trials.orderBy(F.desc("value")).first()
    assert best["params"]["n_clusters"] == 3


def test_density_labels(spark):
    df, x, outliers = blobs(spark)
    settings = DensitySettings(10, 5)
    found = {r["id"]: r["cluster"] for r in density_clusters(df, "features", "id", settings).collect()}
    assert {i for i, c in found.items() if c == -1} >= far_points(df, x, outliers)
    groups = [{found[i] for i in range(g * 80, g * 80 + 80)} - {-1} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    cores = np.sort(d, axis=1)[:, settings.min_samples - 1]
    labels = cluster_labels(*dense_tree(x, cores, 1.0), np.ones(len(x), dtype=int), cores, settings)
    pairs = {(int(a), found[i]) for i, a in enumerate(labels)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_density_through_the_neighbour_graph(spark):
    df, x, outliers = blobs(spark)
    settings = DensitySettings(10, 5)
    exact = {r["id"]: r["cluster"] for r in density_clusters(df, "features", "id", settings).collect()}
    graph = {r["id"]: r["cluster"] for r in density_clusters(df, "features", "id", settings, broadcast_points=0).collect()}
    pairs = {(graph[i], c) for i, c in exact.items() if c >= 0}
    assert len({a for a, _ in pairs} - {-1}) == 3


def test_spanning_tree_weight(spark):
    df, x, _ = blobs(spark, per=30)
    points = distinct_points(df, "features", "id")
    cored = core_distances(points, knn_join(points, 20), 5).cache()
    tree = spanning_tree(cored, 1.0)
    rows = cored.orderBy("pid").collect()
    v, core = np.array([r["v"] for r in rows]), np.array([r["core"] for r in rows])
    d = np.maximum(np.maximum(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), core[:, None]), core[None])
    i, j = np.triu_indices(len(v), 1)
    edges = spark.createDataFrame(
        [(int(a), int(b), float(d[a, b])) for a, b in zip(i, j)], "i bigint, j bigint, length double"
    )
    forest = spanning_forest(edges, edges_per_group=500)
    for f in (tree, forest):
        assert f.count() == len(v) - 1
    total = [f.agg(F.sum("length")).first()[0] for f in (tree, forest)]
    assert total[0] == pytest.approx(total[1])
    assert sum(dense_tree(v, core, 1.0)[1]) == pytest.approx(total[0])


def test_density_sample_is_noise_only(spark):
    df, x, outliers = blobs(spark)
    flagged, trials, _ = density_cluster_sample(df, "features", 4, "id", 1, trials=10)
    rows = flagged.where("is_sample = 1").collect()
    assert rows and all(r["cluster"] == -1 for r in rows) and trials.count() == 10


def test_silhouette_of_a_refit(spark):
    df, _, _ = blobs(spark, outliers=0)
    fit = lambda part: part.withColumn("cluster", (F.get("features", 0) > 3).cast("int"))
    assert silhouette(df, "features", ["id"], 1, fit=fit) > 0.3
    assert silhouette(df.withColumn("cluster", F.lit(0)), "features", ["id"], 1) == float("-inf")


@pytest.mark.parametrize("kind", [
    "CAST(id % 7 AS DECIMAL(20,3)) / 3", "CASE WHEN id % 5 = 0 THEN double('NaN') WHEN id % 5 = 1 THEN double('Infinity') ELSE id / 9.0D END",
    "id % 2 = 0", "CONCAT('ключ\"\\\\', id % 11)", "DATE_ADD(DATE '2020-02-27', CAST(id % 9 AS INT))",
    "TIMESTAMP_MICROS(id % 50 * 1000001)", "CAST(TIMESTAMP_MICROS(id % 50 * 1000001) AS TIMESTAMP_NTZ)", "(id % 13) * 1000000000000000 + 9007199254740993",
])
def test_rank_by_every_type(spark, kind):
    df = spark.range(700).withColumn("k", F.expr(kind))
    got = {r["id"]: r["position"] for r in global_rank(df, ["k"], ["id"]).collect()}
    assert got == {r["id"]: i for i, r in enumerate(df.orderBy("k", "id").select("id").collect())}


def test_nearest_centre_forms_agree(spark, monkeypatch):
    df, x, _ = blobs(spark)
    centres = [[float(v) for v in r] for r in x[::40]]
    rows = nearest_centroid(df, "features", centres).orderBy("id").collect()
    monkeypatch.setattr("ledgersift.operators.clustering.EXPRESSION_TERMS", 0)
    assert nearest_centroid(df, "features", centres).orderBy("id").collect() == rows


def test_scores_can_be_stored_with_any_column_name(spark):
    df = spark.createDataFrame([(i, float(i % 5), "a b;c" if i % 2 else "d,(e)") for i in range(60)], "id bigint, v double, g string")
    rows, plan = fit_features(df, ["v"], ["g"])
    prepared = plan.apply(rows, ["id"]).withColumn("features", plan_vector(plan))
    assert isolation_forest_sample(prepared, "features", 3, ["id"], 1, 5).where("is_sample = 1").count() == 3


def plan_vector(plan):
    return F.array(*[F.col(f"`{n}`").cast("double") for n in plan.names])


def test_top_n_with_null_and_nan_scores(spark):
    from ledgersift.operators.order_statistics import top_n_by_score

    rows = [(i, None if i % 4 == 0 else float("nan") if i % 5 == 0 else float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, s double")
    known = [(i, s) for i, s in rows if s is not None and s == s]
    for highest in (False, True):
        for n in (1, 3, 17, 30, 40, 60):
            got = {r["k"] for r in top_n_by_score(df, "s", n, ["k"], highest).where("is_sample = 1").collect()}
            best = sorted(known, key=lambda r: (-r[1] if highest else r[1], r[0]))[:n]
            assert len(got) == min(n, 40) and {i for i, _ in best} <= got


def test_cut_is_narrowed_by_counting(spark, monkeypatch):
    """No task ranks more than EDGE_ROWS rows of a group, whatever ties there are; the cut stays exact."""
    from ledgersift.operators import order_statistics

    monkeypatch.setattr(order_statistics, "EDGE_ROWS", 50)
    monkeypatch.setattr(order_statistics, "CUTS", 20)
    df = spark.range(20_000).selectExpr("id AS k", "id % 3 AS g", "CAST(id % 2 AS double) AS s").repartition(6)
    for n in (1, 4_000, 19_999):
        got = {r["k"] for r in order_statistics.top_n_by_score(df, "s", n, ["k"]).where("is_sample = 1").collect()}
        assert got == set(sorted(range(20_000), key=lambda i: (i % 2, i))[:n])
    got = order_statistics.top_n_by_score(df, "s", 10, ["k"], groups=["g"]).where("is_sample = 1").collect()
    assert {(r["g"], r["k"]) for r in got} == {(g, k) for g in range(3) for k in [i for i in range(20_000) if i % 3 == g and i % 2 == 0][:10]}
    same = spark.range(3_000).selectExpr("1 AS k", "0.5 AS s")
    assert order_statistics.top_n_by_score(same, "s", 5, ["k"]).where("is_sample = 1").count() == 3_000


def test_keys_of_unlike_rows_differ(spark):
    from ledgersift.operators.ranking import with_row_key

    df = spark.createDataFrame([("a|", "b"), ("a", "|b"), (None, "x"), ("\u0000", "x"), ("null;", ""), (None, ""), ("1:a", "b"), ("", None)], "p string, q string")
    assert with_row_key(df).select("row_key").distinct().count() == 8


def test_repeated_keys_are_refused(spark):
    import pytest

    from ledgersift.errors import ColumnError
    from ledgersift.operators.monetary import mus_sample
    from ledgersift.operators.random_sampling import systematic_sample

    df = spark.range(100).selectExpr("id % 10 AS k", "id AS o", "1.0 AS v")
    with pytest.raises(ColumnError):
        systematic_sample(df, 10, ["o"], ["k"], 1)
    with pytest.raises(ColumnError):
        mus_sample(df, 10, "v", ["k"], seed=1)


def test_money_keeps_every_digit(spark):
    from ledgersift.operators.summaries import population_totals

    df = spark.sql("SELECT CAST('90071992547409.93' AS decimal(20,2)) AS v UNION ALL SELECT CAST('-0.05' AS decimal(20,2))")
    assert population_totals(df, "v").first()["total_minor"] == 9007199254740993 - 5
    assert population_totals(spark.sql("SELECT 7 AS v"), "v").first()["total_minor"] == 700


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    from ledgersift.cluster import shared_dir
    from ledgersift.errors import SharedFolderError

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(SharedFolderError):
        shared_dir(Session(), "x")


def test_run_method_options_and_report(spark):
    from ledgersift.plans import run_method

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    found = run_method(orders, 5, 20, ["o_orderkey"], ["o_totalprice"], ["o_orderpriority"], seed=3, sample_fraction=0.5, skew_threshold=0.0)
    assert found.population.count() == round(orders.count() * 0.5) and found.sample.count() == 20
    report = {(r["section"], r["item"]): r["value"] for r in found.report().collect()}
    assert ("method", "anomalies") in report and report["settings", "trees"] == "100"
    assert any("log" in str(v) for (section, _), v in report.items() if section == "preparation")
    found = run_method(orders, 2, 30, ["o_orderkey"], seed=3, order_by=["o_orderdate"])
    report = {(r["section"], r["item"]): r["value"] for r in found.report().collect()}
    assert report["settings", "step"] == str(orders.count() // 30)
    found = run_method(orders, 3, 30, ["o_orderkey"], seed=3, strata=["o_orderpriority"])
    assert sum(r["section"] == "strata" for r in found.report().collect()) == 5


def test_level_limit_is_exact_and_names_do_not_collide(spark):
    import pytest

    from ledgersift.errors import ColumnError
    from ledgersift.operators.features import distinct_levels, fit_features, sparse_one_hot

    df = spark.range(1_001).selectExpr("CAST(id AS string) AS c", "IF(id < 1000, id, 0) AS d")
    with pytest.raises(ColumnError):
        distinct_levels(df, ["c"])
    assert len(distinct_levels(df, ["d"])["d"]) == 1_000
    hot = sparse_one_hot(spark.createDataFrame([("b",), ("a",), (None,)], "c string"), "c", "v").collect()
    assert [tuple(r["v"].toArray()) for r in hot] == [(0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    rows = spark.createDataFrame([("b_c", "x"), ("y", "c")], "a string, a_b string")
    with pytest.raises(ColumnError):
        fit_features(rows, [], ["a", "a_b"])
