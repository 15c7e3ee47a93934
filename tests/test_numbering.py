import random

import pytest
from helpers import tuples
from pyspark.sql import Window
from pyspark.sql import functions as F

from occuspan.operators.numbering import POSITION_BITS, number_rows


def table(spark, seed=3):
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(6), rng.choice(["", "x", "가", None]), i) for i in range(700)]
    rows += [(f"g{i % 40}", rng.randrange(6), "y", i) for i in range(200)]
    rows += [(None, rng.randrange(6), "y", i) for i in range(90)]
    return spark.createDataFrame(rows, "g string, a int, b string, tie int").repartition(6)


@pytest.mark.parametrize("group", ["g", ["g", "b"]])
def test_numbers_and_sums_are_those_of_one_window(spark, group):
    df = table(spark)
    keys = [group] if isinstance(group, str) else group
    whole = Window.partitionBy(*keys).orderBy("a", "b", "tie")
    ahead = F.coalesce(F.sum("a").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plain = df.withColumn("n", F.row_number().over(whole)).withColumn("s", ahead)
    numbered = number_rows(df, group, ["a", "b", "tie"], "n", {"s": F.col("a")})
    assert numbered.columns == ["g", "a", "b", "tie", "n", "s"]
    assert tuples(numbered, *numbered.columns) == tuples(plain, *plain.columns)


def test_equal_rows_get_distinct_numbers(spark):
    df = spark.createDataFrame([("g", 1)] * 30 + [("g", 2)] * 5, "g string, a int")
    found = number_rows(df, "g", ["a"], "n")
    assert [r[0] for r in found.orderBy("n").select("n").collect()] == list(range(1, 36))
    assert found.filter("a = 2").agg(F.min("n")).first()[0] == 31


def test_no_rows(spark):
    found = number_rows(spark.createDataFrame([], "g string, a int"), "g", ["a"], "n")
    assert found.columns == ["g", "a", "n"] and found.collect() == []


def test_rows_equal_in_group_and_order_are_spread_over_tasks(spark, tmp_path):
    """One group holds all rows, and all of them are equal in its order."""
    df = spark.range(20_000).select(F.lit("p").alias("g"), F.lit(1).alias("a"), "id").repartition(8)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        numbered = number_rows(df, "g", ["a"], "n", folder=str(tmp_path))
        assert numbered.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (20_000, 1, 20_000)
    finally:
        spark.conf.unset(coalesce)
    part = F.shiftright("_place", POSITION_BITS)
    sizes = [r[0] for r in spark.read.parquet(f"{tmp_path}/placed_n").groupBy(part).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 5_000
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "windowspec" in line]
    assert windows and all("_part#" in line for line in windows)
