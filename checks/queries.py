"""One query per operator over the standard tables; every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgersift.cluster import shared_dir
from ledgersift.functions import minor_units
from ledgersift.operators import features as prep
from ledgersift.operators.autoencoder import autoencoder_sample, pca_reconstruction_sample, projection_2d
from ledgersift.operators.clustering import (
    calinski_harabasz, cluster_distance_std, kmeans_sample, nearest_centroid, quota_sample, relative_distance,
)
from ledgersift.operators.density import (
    DensitySettings, density_cluster_sample, density_clusters, noise_sample, tune_density,
)
from ledgersift.operators.isolation import isolation_forest_sample
from ledgersift.operators.kmeans_search import kmeans_search
from ledgersift.operators.monetary import mus_picked, mus_sample, threshold_filter
from ledgersift.operators.neighbours import approximate_knn_search, distinct_points, knn_join
from ledgersift.operators.order_statistics import top_n_by_score
from ledgersift.operators.outlier_factor import lof_sample
from ledgersift.operators.quality import silhouette, silhouette_rows, silhouette_sizes, silhouette_squared, subsample
from ledgersift.operators.random_sampling import (
    fraction_subsample, mark_sample, random_sample, systematic_sample,
)
from ledgersift.operators.ranking import global_rank, prefix_sum, with_row_key
from ledgersift.operators.stratified import (
    mus_allocation, stratified_allocation, stratified_sample, stratum_counts,
)
from ledgersift.operators.summaries import (
    cumulative_curve, method_summary, param_effect, population_totals, strata_comparison, stratum_shares,
    trial_history, trials_long,
)
from ledgersift.plans import run_method
from ledgersift.sources import load, scan_csv, scan_dbf, scan_xlsx, sniff_csv_dialects, write_results
from ledgersift.sources.files import CSV_TEXT, list_files, scan_json

from .exports import dbf_files, xlsx_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Three fixed centres for the distance queries (scaled price, scaled day of month).
CENTRES = [[0.2, 0.25], [0.5, 0.75], [0.8, 0.25]]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# Sources and sinks ---------------------------------------------------------------------------


def orders_text(spark, sf):
    """Orders with types that survive a text file."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@query
def scan_csv_orders(spark, sf):
    path = shared_dir(spark, "csv")
    orders_text(spark, sf).write.option("header", "true").option("sep", ";").csv(path)
    return scan_csv(spark, path, ORDERS_SCHEMA)


@query
def scan_csv_documents(spark, sf):
    """Texts with quotes and line breaks, written as CSV and read back."""
    path = shared_dir(spark, "csv")
    rows = table(spark, sf, "documents")
    rows.write.options(**CSV_TEXT).csv(path)
    return scan_csv(spark, path, rows.schema)


@query
def scan_csv_conversations(spark, sf):
    path = shared_dir(spark, "csv")
    rows = table(spark, sf, "conversations")
    rows.write.options(**CSV_TEXT, sep="|").csv(path)
    return scan_csv(spark, path, rows.schema)


@query
def write_results_csv_text(spark, sf):
    flagged = random_sample(table(spark, sf, "documents").select("doc_id", "text", "source"), 150, ["doc_id"], 11)
    _, sample = write_results(flagged, shared_dir(spark, "out"), "Random Sampling", "csv")
    return scan_csv(spark, sample, flagged.schema)


@query
def sniff_csv_dialect(spark, sf):
    path = shared_dir(spark, "dialects")
    out = orders_text(spark, sf).repartition(4, "o_orderkey")
    for sep, name in ((",", "comma"), (";", "semicolon"), ("\t", "tab"), ("|", "pipe")):
        out.write.option("header", "true").option("sep", sep).csv(f"{path}/{name}")
    found = sniff_csv_dialects(list_files(spark, path).where("path LIKE '%.csv'"))
    kind = F.element_at(F.split("path", "/"), -2)
    return found.groupBy(kind.alias("kind"), "encoding", "sep", "n_cols").agg(F.count(F.lit(1)).alias("files"))


@query
def scan_json_orders(spark, sf):
    path = shared_dir(spark, "json")
    orders_text(spark, sf).write.json(path)
    return scan_json(spark, path, schema=ORDERS_SCHEMA)


@query
def scan_parquet(spark, sf):
    return table(spark, sf, "customer")


@query
def scan_dbf_suppliers(spark, sf):
    """Supplier table exported as one DBF file per nation, read back as one table."""
    path = shared_dir(spark, "dbf")
    dbf_files(table(spark, sf, "supplier"), "s_nationkey", path)
    return scan_dbf(spark, path).withColumn("s_nationkey", F.col("s_nationkey").cast("int"))


@query
def scan_xlsx_suppliers(spark, sf):
    """Supplier table exported as one workbook per nation, read back as one table."""
    path = shared_dir(spark, "xlsx")
    xlsx_files(table(spark, sf, "supplier"), "s_nationkey", path)
    rows = scan_xlsx(spark, path)
    return rows.withColumn("s_nationkey", F.col("s_nationkey").cast("int")).withColumn(
        "s_suppkey", F.col("s_suppkey").cast("long")
    )


@query
def load_table(spark, sf):
    return load(spark, f"{sf}/part.parquet")


@query
def write_results_read_back(spark, sf):
    flagged = random_sample(orders_text(spark, sf), 200, ["o_orderkey"], 11)
    _, sample = write_results(flagged, shared_dir(spark, "out"), "Random Sampling")
    return load(spark, sample, "parquet")


@query
def table_shape(spark, sf):
    rows, columns = prep.table_shape(table(spark, sf, "lineitem"))
    return spark.createDataFrame([(rows, columns)], "n_rows bigint, n_columns int")


@query
def column_catalog(spark, sf):
    catalog = prep.column_catalog(table(spark, sf, "lineitem"))
    return spark.createDataFrame([(n, k) for n, _, k in catalog], "name string, is_numeric boolean")


# Filters and projections ----------------------------------------------------------------------


@query
def threshold_filter_orders(spark, sf):
    return threshold_filter(table(spark, sf, "orders"), "o_totalprice", 250000).select("o_orderkey", "o_totalprice")


@query
def flag_init(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.lit(0).alias("is_sample"))


@query
def drop_null_labels(spark, sf):
    marked = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return prep.drop_null_labels(marked, "quality", "toxic").select("doc_id", "quality", "toxic")


@query
def resolve_features(spark, sf):
    events = table(spark, sf, "events")
    rows, plan = prep.fit_features(events, ["value"], ["event_type"])
    prepared = plan.apply(rows, ["event_id"])
    names = prep.resolve_features(prepared.columns, ["value", "event_type"])
    return prepared.agg(*[r6(F.sum(F.col(n).cast("double"))).alias(f"sum_{n}") for n in names])


@query
def project_features(spark, sf):
    lines = table(spark, sf, "lineitem")
    hot = prep.one_hot("l_returnflag", prep.distinct_levels(lines, ["l_returnflag"])["l_returnflag"])
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", *hot)


@query
def fraction_subsample_exact(spark, sf):
    return fraction_subsample(table(spark, sf, "events"), 0.15, ["event_id"], 5).select("event_id")


@query
def fraction_subsample_bernoulli(spark, sf):
    return fraction_subsample(table(spark, sf, "events"), 0.15, ["event_id"], 5, "bernoulli").select("event_id")


# Keys, ranks, running totals -------------------------------------------------------------------


@query
def row_keys_unique_lineitem(spark, sf):
    return with_row_key(table(spark, sf, "lineitem")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("row_key").alias("n_keys")
    )


@query
def row_keys_unique_documents(spark, sf):
    return with_row_key(table(spark, sf, "documents")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("row_key").alias("n_keys")
    )


@query
def with_row_key_lineitem(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return with_row_key(lines)


@query
def global_rank_events(spark, sf):
    ranked = global_rank(table(spark, sf, "events"), ["event_type", "ts"], ["event_id"])
    return ranked.select("event_id", "position")


@query
def prefix_sum_orders(spark, sf):
    amount = minor_units(F.col("o_totalprice"))
    total = prefix_sum(table(spark, sf, "orders"), amount, ["o_orderdate"], ["o_orderkey"])
    return total.select("o_orderkey", "position", "running_total")


@query
def prefix_sum_by_stratum(spark, sf):
    amount = minor_units(F.col("o_totalprice"))
    total = prefix_sum(table(spark, sf, "orders"), amount, ["o_orderdate"], ["o_orderkey"], ["o_orderstatus"])
    return total.select("o_orderkey", "position", "running_total")


@query
def sorted_prefix_sum(spark, sf):
    amount = minor_units(F.col("value"))
    total = prefix_sum(table(spark, sf, "events").select("event_id", "value"), amount, ["value"], ["event_id"])
    return total.select("event_id", "position", "running_total")


# Statistical selection --------------------------------------------------------------------------


@query
def random_sample_orders(spark, sf):
    flagged = random_sample(table(spark, sf, "orders"), 500, ["o_orderkey"], 42)
    return flagged.select("o_orderkey", "is_sample")


@query
def random_sample_third(spark, sf):
    """A third of the table: located by bucket counts rather than a top-k."""
    from ledgersift.operators import order_statistics as stats

    events = table(spark, sf, "events")
    rows = events.count()
    h = stats.hash_hex(42, "srs", "event_id")
    order = [h.alias("__h"), F.col("event_id")]
    cuts = stats.kth_cut(events, [], F.lit(rows // 3).cast("long"), stats.hash_bucket(h, F.lit(256).cast("long")), order)
    return stats.flag_up_to_cut(events, [], cuts, order).select("event_id", "is_sample")


@query
def systematic_sample_events(spark, sf):
    flagged = systematic_sample(table(spark, sf, "events"), 300, ["ts"], ["event_id"], 42)
    return flagged.select("event_id", "is_sample")


@query
def systematic_sample_fractional(spark, sf):
    flagged = systematic_sample(table(spark, sf, "events"), 333, ["ts"], ["event_id"], 42, "fractional")
    return flagged.select("event_id", "is_sample")


@query
def stratified_allocation_orders(spark, sf):
    counts = stratum_counts(table(spark, sf, "orders"), ["o_orderpriority"])
    return stratified_allocation(counts, ["o_orderpriority"], 137)


@query
def stratified_sample_orders(spark, sf):
    flagged = stratified_sample(table(spark, sf, "orders"), 137, ["o_orderpriority"], ["o_orderkey"], 42)
    return flagged.select("o_orderkey", "o_orderpriority", "is_sample")


@query
def stratified_sample_documents(spark, sf):
    flagged = stratified_sample(table(spark, sf, "documents"), 100, ["lang", "source"], ["doc_id"], 7)
    return flagged.select("doc_id", "is_sample")


@query
def mus_allocation_orders(spark, sf):
    kept = threshold_filter(table(spark, sf, "orders"), "o_totalprice", 100000)
    return mus_allocation(stratum_counts(kept, ["o_orderstatus"]), ["o_orderstatus"], 301)


@query
def mus_sample_orders(spark, sf):
    flagged = mus_sample(table(spark, sf, "orders"), 500, "o_totalprice", ["o_orderkey"], seed=42)
    return flagged.select("o_orderkey", "is_sample")


@query
def point_in_cumulative_range(spark, sf):
    """Rows hit by the drawn monetary units, before any top-up."""
    return mus_picked(
        table(spark, sf, "orders"), 700, "o_totalprice", ["o_orderkey"], ["o_orderdate", "o_orderkey"], None, (), 42,
        "error", 2, False,
    )


@query
def mus_topup(spark, sf):
    """Half the customers asked for: many rows are hit twice, the race fills the rest."""
    customers = table(spark, sf, "customer")
    n = customers.count() // 2
    flagged = mus_sample(customers, n, "c_acctbal", ["c_custkey"], seed=42, negatives="drop")
    return flagged.select("c_custkey", "is_sample")


@query
def mus_stratified(spark, sf):
    flagged = mus_sample(
        table(spark, sf, "orders"), 301, "o_totalprice", ["o_orderkey"], threshold=100000,
        strata=["o_orderstatus"], seed=42,
    )
    return flagged.select("o_orderkey", "o_orderstatus", "is_sample")


@query
def mark_sample_orders(spark, sf):
    orders = table(spark, sf, "orders")
    big = orders.where("o_totalprice >= 400000").select("o_orderkey")
    return mark_sample(orders, big, ["o_orderkey"], orders.count()).select("o_orderkey", "is_sample")


@query
def semi_mark(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    active = orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    flagged = mark_sample(customers, active, ["c_custkey"], customers.count())
    return flagged.select("c_custkey", "is_sample")


@query
def method_summary_orders(spark, sf):
    flagged = mus_sample(table(spark, sf, "orders"), 200, "o_totalprice", ["o_orderkey"], threshold=50000, seed=9)
    return method_summary(flagged, "Monetary Unit Sampling", 200, 9, "o_totalprice", 50000, created="2024-01-01")


@query
def row_limits(spark, sf):
    from ledgersift.cluster import require_rows
    from ledgersift.errors import RowLimitError

    events, found = table(spark, sf, "events"), []
    for limit in (100, 1_000_000_000):
        try:
            require_rows(events, limit)
            found.append((limit, True))
        except RowLimitError:
            found.append((limit, False))
    return spark.createDataFrame(found, "max_rows bigint, accepted boolean")


# Aggregates ----------------------------------------------------------------------------------------


@query
def population_totals_orders(spark, sf):
    return population_totals(table(spark, sf, "orders"), "o_totalprice")


@query
def stratum_counts_documents(spark, sf):
    return stratum_counts(table(spark, sf, "documents"), ["lang", "source"])


@query
def stratum_shares_customers(spark, sf):
    shares = stratum_shares(table(spark, sf, "customer"), "c_mktsegment")
    return shares.withColumn("percent", r6(F.col("percent")))


@query
def skewness_events(spark, sf):
    found = prep.skewness(table(spark, sf, "events"), ["value"])
    return spark.createDataFrame([(round(found["value"], 6),)], "skew double")


@query
def min_max(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    parts = [g(c).alias(f"{n}_{c}") for c in columns for n, g in (("min", F.min), ("max", F.max))]
    return table(spark, sf, "lineitem").agg(*parts)


@query
def mean_std(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    parts = [r6(g(c)).alias(f"{n}_{c}") for c in columns for n, g in (("mean", F.avg), ("sd", F.stddev_pop))]
    return table(spark, sf, "lineitem").agg(*parts)


@query
def distinct_levels(spark, sf):
    levels = prep.distinct_levels(table(spark, sf, "part"), ["p_brand", "p_type"])
    rows = [(c, v) for c, values in levels.items() for v in values]
    return spark.createDataFrame(rows, "name string, level string")


# Feature preparation ----------------------------------------------------------------------------------


@query
def one_hot(spark, sf):
    orders = table(spark, sf, "orders")
    levels = prep.distinct_levels(orders, ["o_orderstatus"])["o_orderstatus"]
    return orders.select("o_orderkey", *prep.one_hot("o_orderstatus", levels))


@query
def number_levels_orders(spark, sf):
    """Levels of a column that grows with the table, by their place in ascending order."""
    return prep.number_levels(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "number")[0]


@query
def sparse_one_hot_customers(spark, sf):
    """More levels than columns could hold: place of the one, and the vector's length."""
    hot = prep.sparse_one_hot(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "hot")
    shape = r"\((\d+),\[(\d+)\]"
    size, place = (F.regexp_extract(F.col("hot").cast("string"), shape, i).cast("int") for i in (1, 2))
    return hot.select("o_orderkey", size.alias("levels"), place.alias("place"))


@query
def skew_route(spark, sf):
    _, plan = prep.fit_features(table(spark, sf, "events"), ["value", "user_id"], [])
    rows = [(c, c in plan.log_route) for c in plan.order]
    return spark.createDataFrame(rows, "name string, log_route boolean")


@query
def log1p_positive(spark, sf):
    customers = table(spark, sf, "customer")
    return customers.select("c_custkey", r6(prep.log1p_positive(F.col("c_acctbal"))).alias("logged"))


@query
def minmax_scale(spark, sf):
    events = table(spark, sf, "events")
    low, high = events.agg(F.min("value"), F.max("value")).first()
    return events.select("event_id", r6(prep.minmax_scaled(F.col("value"), low, high)).alias("scaled"))


@query
def standard_scale(spark, sf):
    orders = table(spark, sf, "orders")
    mean, sd = orders.agg(F.avg("o_totalprice"), F.stddev_pop("o_totalprice")).first()
    return orders.select("o_orderkey", r6(prep.standard_scaled(F.col("o_totalprice"), mean, sd)).alias("scaled"))


@query
def prepare_features(spark, sf):
    rows, plan = prep.fit_features(table(spark, sf, "events"), ["value", "user_id"], ["event_type"])
    prepared = plan.apply(rows, ["event_id"])
    return prepared.withColumn("value", r6(F.col("value"))).withColumn("user_id", r6(F.col("user_id")))


# Clusters and anomaly scores ------------------------------------------------------------------------


def priced_days(spark, sf):
    """Orders as points (price / 500000, day of month / 31)."""
    orders = table(spark, sf, "orders")
    day = F.dayofmonth("o_orderdate").cast("double") / 31.0
    return orders.select("o_orderkey", F.array(F.col("o_totalprice") / 500000.0, day).alias("features"))


def placed_orders(spark, sf):
    return nearest_centroid(priced_days(spark, sf), "features", CENTRES)


def part_points(spark, sf):
    parts = table(spark, sf, "part")
    return parts.select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("features"))


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


def order_features(spark, sf):
    rows, plan = prep.fit_features(table(spark, sf, "orders"), ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])
    return rows.select("o_orderkey", plan.vector().alias("features"))


@query
def nearest_centroid_orders(spark, sf):
    placed = placed_orders(spark, sf)
    return placed.select("o_orderkey", "cluster", r6(F.col("distance_to_centroid")).alias("distance_to_centroid"))


@query
def cluster_distance_std_orders(spark, sf):
    spread = cluster_distance_std(placed_orders(spark, sf))
    return spread.select("cluster", "cluster_size", r6(F.col("distance_std")).alias("distance_std"))


@query
def kmeans_quota_fixed_centres(spark, sf):
    """Quota, fill-up and flags of k-means selection for given centres."""
    placed = relative_distance(placed_orders(spark, sf))
    rounded = placed.withColumn("relative_distance", r6(F.col("relative_distance")))
    return quota_sample(rounded, 50, ["o_orderkey"]).select("o_orderkey", "cluster", "is_sample")


@query
def top_n_per_group(spark, sf):
    flagged = top_n_by_score(table(spark, sf, "orders"), "o_totalprice", 7, ["o_orderkey"], True, ["o_orderpriority"])
    return flagged.where("is_sample = 1").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query
def top_n_by_score_lowest(spark, sf):
    flagged = top_n_by_score(table(spark, sf, "customer"), "c_acctbal", 100, ["c_custkey"])
    return flagged.select("c_custkey", "is_sample")


@query
def global_nlargest(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").limit(25).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"
    )


@query
def sorted_output(spark, sf):
    return table(spark, sf, "supplier").orderBy("s_acctbal", "s_suppkey").select("s_suppkey", "s_acctbal")


@query
def concat_strata(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parts = [orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def distinct_hits(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    hits = lines.select(F.col("l_orderkey").alias("o_orderkey")).dropDuplicates()
    return orders.join(hits, "o_orderkey", "left_semi").select("o_orderkey")


@query
def anomaly_and_cluster_count(spark, sf):
    placed = placed_orders(spark, sf).withColumn("is_anomaly", (F.col("distance_to_centroid") > 0.3).cast("int"))
    return placed.agg(
        F.sum("is_anomaly").alias("anomaly_count"), (F.max("cluster") + 1).cast("int").alias("cluster_count")
    )


@query
def share_left_join(spark, sf):
    """Sample share of every stratum, 0 where the sample has none."""
    flagged = table(spark, sf, "part").withColumn("is_sample", (F.col("p_size") == 1).cast("int"))
    both = strata_comparison(flagged, "p_brand")
    return both.select("stratum", r6(F.col("sample_percent")).alias("sample_percent"))


@query
def knn_join_parts(spark, sf):
    near = knn_join(distinct_points(part_points(spark, sf), "features", "p_partkey"), 5)
    return near.select("a", "b", r6(F.col("dist")).alias("dist"), "take")


@query
def knn_join_blocks(spark, sf):
    """The same join through pivot cells, rings and bounded visits."""
    near = knn_join(distinct_points(part_points(spark, sf), "features", "p_partkey"), 5, broadcast_points=0, block_rows=256)
    return near.select("a", "b", r6(F.col("dist")).alias("dist"), "take")


@query
def knn_join_vector_blocks(spark, sf):
    """Wide vectors through pivot cells and rounds of visits."""
    near = knn_join(distinct_points(vectors(spark, sf), "features", "vec_id"), 5, broadcast_points=0, block_rows=64)
    return near.select("a", "b", r6(F.col("dist")).alias("dist"), "take")


@query
def approximate_knn_vectors(spark, sf):
    """Neighbours by random-projection tables; exact as long as one cell holds all vectors."""
    near = approximate_knn_search(distinct_points(vectors(spark, sf), "features", "vec_id"), 5).pairs
    return near.select("a", "b", r6(F.col("dist")).alias("dist"), "take")


@query
def lof_vector_blocks(spark, sf):
    """Local outlier factors of wide vectors through the same blocks."""
    flagged = lof_sample(vectors(spark, sf), "features", 20, "vec_id", broadcast_points=0, block_rows=64)
    return flagged.select("vec_id", F.round("anomaly_score", 5).alias("anomaly_score"), "is_anomaly")


@query
def lof_sample_parts(spark, sf):
    flagged = lof_sample(part_points(spark, sf), "features", 20, "p_partkey")
    return flagged.select("p_partkey", r6(F.col("anomaly_score")).alias("anomaly_score"), "is_anomaly", "is_sample")


@query
def lof_numbered_parts(spark, sf):
    """Outlier factors where a category is held as numbers of its levels instead of one column per level."""
    parts, _ = prep.number_levels(table(spark, sf, "part"), "p_type", "type")
    points = F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 100.0, F.col("type").cast("double"))
    flagged = lof_sample(parts.select("p_partkey", points.alias("features")), "features", 20, "p_partkey", broadcast_points=0, block_rows=256, codes=1)
    return flagged.select("p_partkey", F.round("anomaly_score", 5).alias("anomaly_score"), "is_anomaly")


@query
def run_method_many_levels(spark, sf):
    """The one call with a category of as many levels as there are customers."""
    found = run_method(table(spark, sf, "orders"), 5, 50, ["o_orderkey"], ["o_totalprice"], ["o_custkey"], seed=42, max_levels=50)
    return found.population.select("o_orderkey", "anomaly_score", "is_anomaly", "is_sample")


@query
def lof_sample_vectors(spark, sf):
    flagged = lof_sample(vectors(spark, sf), "features", 20, "vec_id", pick="lowest")
    return flagged.select("vec_id", F.round("anomaly_score", 5).alias("anomaly_score"), "is_anomaly")


@query
def calinski_harabasz_vectors(spark, sf):
    score = calinski_harabasz(vectors(spark, sf), "features", "label", 64)
    return score.withColumn("calinski_harabasz", r6(F.col("calinski_harabasz")))


@query
def silhouette_vectors(spark, sf):
    """Silhouette values of the first subsample (every row below 1,000 rows)."""
    rows = vectors(spark, sf)
    count = rows.count()
    part = subsample(rows, silhouette_sizes(count)[0], ["vec_id"], 42, 0, count)
    scores = silhouette_rows(part, "features", "label", ["vec_id"])
    return scores.select("vec_id", r6(F.col("silhouette")).alias("silhouette"))


@query
def silhouette_mean_vectors(spark, sf):
    """The score itself: mean over all subsamples."""
    found = silhouette(vectors(spark, sf), "features", ["vec_id"], 42, "label")
    return spark.createDataFrame([(round(found, 6),)], "silhouette double")


@query
def silhouette_squared_vectors(spark, sf):
    value = silhouette_squared(vectors(spark, sf), "features", "label")
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query
def silhouette_sizes_tables(spark, sf):
    names = ["supplier", "customer", "part", "orders", "lineitem"]
    rows = [(n, table(spark, sf, n).count()) for n in names]
    out = [(n, len(silhouette_sizes(c)), silhouette_sizes(c)[0]) for n, c in rows]
    return spark.createDataFrame(out, "name string, parts int, size int")


@query
def isolation_forest_sample_orders(spark, sf):
    flagged = isolation_forest_sample(order_features(spark, sf), "features", 50, ["o_orderkey"], 42)
    return flagged.select("o_orderkey", "anomaly_score", "is_anomaly", "is_sample")


@query
def kmeans_sample_orders(spark, sf):
    flagged, _ = kmeans_sample(order_features(spark, sf), "features", 50, ["o_orderkey"], 42)
    return flagged.select("o_orderkey", "cluster", "distance_to_centroid", "relative_distance", "is_sample")


@query
def tune_kmeans_vectors(spark, sf):
    return kmeans_search(vectors(spark, sf), "features", ["vec_id"], 42).trials


@query
def autoencoder_sample_orders(spark, sf):
    flagged = autoencoder_sample(order_features(spark, sf), "features", 50, ["o_orderkey"], 42)
    return flagged.select("o_orderkey", "anomaly_score", "is_sample")


@query
def pca_reconstruction_sample_orders(spark, sf):
    flagged = pca_reconstruction_sample(order_features(spark, sf), "features", 50, ["o_orderkey"])
    return flagged.select("o_orderkey", "anomaly_score", "is_sample")


@query
def pca_reconstruction_parts(spark, sf):
    """One component of two: the distance to the main axis."""
    flagged = pca_reconstruction_sample(part_points(spark, sf), "features", 50, ["p_partkey"], 1)
    return flagged.select("p_partkey", r6(F.col("anomaly_score")).alias("anomaly_score"), "is_sample")


@query
def projection_2d_parts(spark, sf):
    placed = projection_2d(part_points(spark, sf), "features", ["p_partkey"])
    return placed.select("p_partkey", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query
def density_clusters_parts(spark, sf):
    found = density_clusters(part_points(spark, sf), "features", "p_partkey", DensitySettings(10, 5))
    return found.select("p_partkey", "cluster", "is_anomaly")


@query
def density_cluster_sample_parts(spark, sf):
    flagged, _, _ = density_cluster_sample(part_points(spark, sf), "features", 30, "p_partkey", 42, trials=20)
    return flagged.select("p_partkey", "cluster", "is_anomaly", "is_sample")


@query
def tune_density_parts(spark, sf):
    return tune_density(part_points(spark, sf), "features", ["p_partkey"], 42, 20)[1]


@query
def noise_sample_documents(spark, sf):
    """Random choice among given anomaly labels."""
    labels = table(spark, sf, "labels").withColumn("is_anomaly", F.col("toxic").cast("int"))
    return noise_sample(labels, 20, ["doc_id"], 42)[0].select("doc_id", "is_anomaly", "is_sample")


@query
def run_method_stratified(spark, sf):
    found = run_method(
        table(spark, sf, "orders"), "Stratified Sampling", 137, ["o_orderkey"], seed=42, strata=["o_orderpriority"]
    )
    return found.population.select("o_orderkey", "is_sample")


@query
def run_method_isolation_forest(spark, sf):
    found = run_method(table(spark, sf, "events"), 5, 40, ["event_id"], ["value", "user_id"], ["event_type"], seed=42)
    return found.population.select("event_id", "anomaly_score", "is_sample")


@query
def run_method_systematic(spark, sf):
    found = run_method(table(spark, sf, "events"), "Systematic Sampling", 300, ["event_id"], seed=42, order_by=["ts"])
    return found.population.select("event_id", "is_sample")


@query
def run_method_mus(spark, sf):
    found = run_method(table(spark, sf, "orders"), 4, 500, ["o_orderkey"], seed=42, value="o_totalprice")
    return found.population.select("o_orderkey", "is_sample")


@query
def run_method_lof(spark, sf):
    found = run_method(table(spark, sf, "part"), 6, 20, ["p_partkey"], ["p_size", "p_retailprice"], seed=42)
    return found.population.select("p_partkey", r6(F.col("anomaly_score")).alias("anomaly_score"), "is_sample")


@query
def run_method_kmeans(spark, sf):
    found = run_method(table(spark, sf, "customer"), 7, 50, ["c_custkey"], ["c_acctbal"], ["c_mktsegment"], seed=42)
    return found.population.select("c_custkey", "cluster", "is_sample")


@query
def run_method_autoencoder(spark, sf):
    found = run_method(table(spark, sf, "orders"), 8, 50, ["o_orderkey"], ["o_totalprice"], ["o_orderpriority"], seed=42)
    return found.population.select("o_orderkey", "anomaly_score", "is_sample")


# Summary tables -----------------------------------------------------------------------------------------


@query
def strata_comparison_orders(spark, sf):
    flagged = stratified_sample(table(spark, sf, "orders"), 137, ["o_orderpriority"], ["o_orderkey"], 42)
    both = strata_comparison(flagged, "o_orderpriority", 100000, "o_totalprice")
    return both.select(
        "stratum", r6(F.col("population_percent")).alias("population_percent"),
        r6(F.col("sample_percent")).alias("sample_percent"),
    )


@query
def cumulative_curve_orders(spark, sf):
    flagged = random_sample(table(spark, sf, "orders"), 500, ["o_orderkey"], 42)
    return cumulative_curve(flagged, "o_totalprice", ["o_orderkey"], ["o_orderstatus"], 100000)


@query
def projection_2d_vectors(spark, sf):
    return projection_2d(vectors(spark, sf), "features", ["vec_id", "label"])


def value_trials(spark, sf):
    """A trials table derived from events: one trial per event, two parameters, value = amount."""
    e = table(spark, sf, "events")
    params = F.create_map(
        F.lit("hour"), F.hour("ts").cast("double"), F.lit("user"), (F.col("user_id") % 10).cast("double")
    )
    return e.select(F.col("event_id").alias("trial"), params.alias("params"), F.col("value"))


@query
def trial_history_events(spark, sf):
    return trial_history(value_trials(spark, sf))


@query
def trials_long_events(spark, sf):
    return trials_long(value_trials(spark, sf))


@query
def param_effect_events(spark, sf):
    effect = param_effect(trials_long(value_trials(spark, sf)))
    return effect.select("param", r6(F.col("effect")).alias("effect"))


@query
def sampling_report_orders(spark, sf):
    found = run_method(
        table(spark, sf, "orders"), "Random Sampling", 100, ["o_orderkey"], seed=3, created="2024-01-01"
    )
    return found.report()
