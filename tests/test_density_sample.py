"""Selection of noise rows where the clusters leave none."""

from pyspark.sql import functions as F

from ledgersift.operators.density import DensitySettings, density_cluster_sample


def test_population_without_noise_keeps_its_labels(spark):
    """Every point repeats often enough to be a cluster of its own."""
    rows = spark.range(120).withColumn("features", F.array((F.col("id") % 4).cast("double"), F.lit(0.0)))
    flagged, study, warning = density_cluster_sample(rows, "features", 3, "id", 1, DensitySettings(5, 5))
    got = flagged.collect()
    assert len(got) == 120 and len({r["cluster"] for r in got}) == 4 and study is None
    assert {(r["is_anomaly"], r["is_sample"]) for r in got} == {(0, 0)} and "no noise" in warning


def test_noise_is_still_chosen(spark):
    rows = spark.range(60).withColumn("x", F.when(F.col("id") < 57, F.col("id") % 3).otherwise(F.col("id") * F.col("id")).cast("double"))
    rows = rows.select("id", F.array("x", F.lit(0.0)).alias("features"))
    flagged, _, warning = density_cluster_sample(rows, "features", 2, "id", 1, DensitySettings(5, 5))
    assert flagged.where("is_sample = 1 AND is_anomaly = 1").count() == 2 and not warning
