from pyspark.sql import Window, functions as F

from invoicelens.plans.params import sort_key
from invoicelens.plans.ranking import with_row_number, with_tile


def test_row_number_equals_the_window_with_a_hot_value(spark):
    # A third of the rows share one value, some are NULL.
    data = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).alias("v"))
    order = [sort_key("v", True), sort_key("id", False)]
    ranked = with_row_number(data, order)
    expected = data.withColumn("e", F.row_number().over(Window.orderBy(*order)))
    joined = ranked.join(expected, "id")
    assert joined.filter("rn <> e OR n <> 3000").count() == 0 and joined.count() == 3000


def test_tiles_equal_ntile_for_any_size(spark):
    for size in (0, 1, 3, 4, 5, 10, 11, 103):
        data = spark.range(size)
        tiled = with_tile(data, [F.col("id").asc()], "t", 4)
        expected = data.withColumn("e", F.ntile(4).over(Window.orderBy("id")))
        assert tiled.join(expected, "id").filter("t <> e").count() == 0
        assert tiled.count() == size
