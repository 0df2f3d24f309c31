import pytest
from pyspark.sql import functions as F

from replyforge.operators import joins


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows has one key, another third no key at all."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(3000)]
    left = spark.createDataFrame(rows, "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", 3), ("unused", 4)], "key string, v int")
    return left, right


def result(df):
    return sorted((r.id, r.key, r.v) for r in df.select("id", "key", "v").collect())


def test_hot_keys_are_cut_into_parts(spark, sides):
    left, _ = sides
    hot = joins.hot_keys(left, ["key"], hot_rows=100).collect()
    assert sorted(r._parts for r in hot) == [10, 10]


@pytest.mark.parametrize("hot_rows", [100, 1_000_000])
def test_salted_join_is_a_left_join(spark, sides, hot_rows):
    left, right = sides
    assert result(joins.salted_left_join(left, right, ["key"], ["id"], hot_rows)) == result(left.join(right, "key", "left"))


def test_hot_rows_are_spread(spark, sides):
    left, right = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = joins.salted_left_join(left, right, ["key"], ["id"], hot_rows=50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # Unsalted, one partition would hold a thousand rows of the hot key and another a thousand without one.
    assert sum(sizes) == 3000 and max(sizes) < 700


@pytest.mark.parametrize("max_rows", [0, 100])
def test_lookup_join_beyond_the_bound(spark, sides, max_rows):
    left, right = sides
    assert joins.fits_broadcast(right, max_rows) == (max_rows == 100)
    assert result(joins.lookup_join(left, right, ["key"], ["id"], max_rows, hot_rows=100)) == result(left.join(right, "key", "left"))


def test_broadcast_bound_counts_bytes(spark):
    wide = spark.createDataFrame([("x" * 1000,)], "v string")
    assert joins.fits_broadcast(wide) and not joins.fits_broadcast(wide, max_bytes=500)


def test_anti_join(spark, sides):
    left, right = sides
    rest = joins.salted_anti_join(left, right.unionByName(right), ["key"], ["id"])
    want = [r.id for r in left.join(right, "key", "left_anti").collect()]
    assert sorted(r.id for r in rest.collect()) == sorted(want) and rest.columns == left.columns
