"""Steps that grow no faster than their input."""

from pyspark.sql import functions as F

from graphlens.operators import calculus


def test_groups_are_dealt_out_by_their_number(spark):
    """A fixed number of partitions made a task's memory grow with the table."""
    rows = spark.range(1_600_000).select((F.col("id") % 9973).alias("slot"), (F.col("id") % 7).alias("callback"), F.col("id").alias("group"), F.lit(0.5).alias("score"), F.lit("NONE").alias("match"))
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = calculus.group_max(rows)
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count()
        assert max(r["count"] for r in sizes.collect()) < 300_000 and out.count() == 1_600_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_without_a_group_stand_alone(spark):
    rows = [(1, 1, None, 0.5, "NONE"), (1, 1, None, 0.5, "NONE"), (1, 1, 7, 0.25, "NONE"), (1, 1, 7, 0.75, "RESOLVED_VALUE"), (2, 1, None, 0.5, "NONE")]
    out = calculus.group_max(spark.createDataFrame(rows, "slot int, callback int, `group` int, score double, match string"))
    assert sorted((r["slot"], r["group"] or 0, r["g"], r["strong"]) for r in out.collect()) == [(1, 0, 0.5, False), (1, 0, 0.5, False), (1, 7, 0.75, True), (2, 0, 0.5, False)]
