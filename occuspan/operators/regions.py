"""Statistics over the three-level region hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occuspan.functions.text import round_half_up

# The levels from coarse to fine and the turnover of a hot place.
LEVELS = ("sido", "sigungu", "dong")
HOT_TURNOVER = 3

REGION_COLUMNS = (
    "region_level", "region_code", "region_name", "center_lat", "center_lng", "place_count", "turnover_sum",
    "turnover_avg", "hot_place_count", "avg_tenure_months",
)


def _per_level(of_level) -> Column:
    """Pick an expression by the grouping set a row belongs to."""
    chosen = F.when(F.grouping(F.col("sido_code")) == 0, of_level("sido"))
    chosen = chosen.when(F.grouping(F.col("sigungu_code")) == 0, of_level("sigungu"))
    return chosen.otherwise(of_level("dong"))


def region_names(stores: DataFrame) -> DataFrame:
    """Latest name of every region code, per level.

    Codes are first grouped together with their names, which keeps only an
    integer per group and reduces inside the map tasks.
    """
    pairs = [[F.col(f"{level}_code"), F.col(f"{level}_name")] for level in LEVELS]
    seen = stores.groupingSets(pairs, *[column for pair in pairs for column in pair]).agg(
        _per_level(F.lit).alias("region_level"),
        _per_level(lambda level: F.col(f"{level}_code")).alias("region_code"),
        _per_level(lambda level: F.col(f"{level}_name")).alias("name"),
        F.max("qord").alias("q"),
    )
    newest = F.max(F.when(F.col("name").isNotNull(), F.struct("q", "name")))
    return seen.groupBy("region_level", "region_code").agg(newest["name"].alias("region_name"))


def region_stats(places: DataFrame, names: DataFrame, hot_turnover: int = HOT_TURNOVER) -> DataFrame:
    """Centre, turnover and mean stay of every region at all three levels.

    The mean stay averages the already rounded stays of the places; tenths are
    summed as whole numbers, so the result does not depend on row order.
    """
    codes = [F.col(f"{level}_code") for level in LEVELS]
    tenths = F.floor(F.col("avg_tenure_months") * 10.0 + 0.5)
    stats = places.groupingSets([[code] for code in codes], *codes).agg(
        _per_level(F.lit).alias("region_level"),
        _per_level(lambda level: F.col(f"{level}_code")).alias("region_code"),
        F.avg("lat").alias("center_lat"),
        F.avg("lng").alias("center_lng"),
        F.count(F.lit(1)).alias("place_count"),
        F.sum("turnover_count").alias("turnover_sum"),
        round_half_up(F.avg("turnover_count"), 2).alias("turnover_avg"),
        F.count_if(F.col("turnover_count") >= hot_turnover).alias("hot_place_count"),
        round_half_up(F.sum(tenths) / F.count(tenths) / F.lit(10.0), 1).alias("avg_tenure_months"),
    )
    return stats.join(names, ["region_level", "region_code"], "left").select(
        "region_level",
        "region_code",
        F.coalesce("region_name", "region_code").alias("region_name"),
        *REGION_COLUMNS[3:],
    )
