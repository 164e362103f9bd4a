import pytest
from pyspark.sql import functions as F

from sieveline.operators.skew import heavy_keys, salted_join


@pytest.fixture
def rows(spark):
    return spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4000)).alias("key"), "id"
    )


def test_only_heavy_keys_are_salted_by_their_share(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = heavy_keys(rows, "key")
        hot = spark.sql("select xxhash64('hot') as h").first().h
        assert found == {hot: 11} or found == {hot: 10}
        dimension = rows.select("key").distinct().withColumn("size", F.length("key"))
        plain = rows.join(dimension, "key")
        salted = salted_join(rows, dimension, "key", "id")
        assert salted.columns == plain.columns
        assert salted.exceptAll(plain).count() == plain.exceptAll(salted).count() == 0
        spread = salted_join(rows.hint("merge"), dimension, "key", "id").where("key = 'hot'")
        counts = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert len(counts) > 5 and max(counts) < 6667
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_even_keys_null_keys_and_empty_tables_join_plainly(spark, rows):
    even = rows.withColumn("key", F.col("id").cast("string"))
    assert heavy_keys(even, "key") == {} == heavy_keys(even.limit(0), "key")
    assert salted_join(even, even.select("key", F.lit(1).alias("one")), "key", "id").count() == 20_000
    nulls = rows.withColumn("key", F.lit(None).cast("string"))
    dimension = rows.select("key").distinct().withColumn("size", F.length("key"))
    assert salted_join(nulls, dimension, "key", "id", "left").where("size is null").count() == 20_000
    assert salted_join(nulls, dimension, "key", "id").count() == 0
