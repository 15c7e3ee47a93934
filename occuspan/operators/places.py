"""Published place and chronology tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occuspan.functions.geo import curve_key, point
from occuspan.functions.periods import BASE_YEAR, to_label
from occuspan.functions.text import UNKNOWN_FLOOR, round_half_up
from occuspan.operators.numbering import number_rows
from occuspan.operators.timeline import place_turnover

MONTHS_PER_PERIOD = 3.0

PLACE_COLUMNS = (
    "place_key", "building_id", "floor_label", "road_address", "sido_code", "sigungu_code", "dong_code", "lat", "lng",
    "turnover_count", "avg_tenure_months", "confidence", "stores_current", "is_occupied", "current_category_code",
    "current_category_name", "first_quarter", "last_quarter",
)
HISTORY_COLUMNS = (
    "place_key", "seq", "start_quarter", "end_quarter", "category_code", "category_name", "tenure_quarters",
)


def place_profile(spans: DataFrame, latest: int) -> DataFrame:
    """Latest known attributes and first, last and current presence per place.

    The newest row of a place is the end of one of its spans, so the profile
    is built from spans instead of from every sighting.
    """

    def newest_code(code: str) -> Column:
        seen = F.col(f"{code}_seen")
        candidate = F.when(seen.isNotNull(), F.struct(seen["q"], F.col("store_id"), seen["code"].alias("code")))
        return F.max(candidate)["code"].alias(code)

    newest = F.max(F.struct("end_q", "store_id", "building_id", "floor_label", "road_address", "lat", "lng"))
    at_latest = F.col("end_q") == latest
    one_before = (F.col("end_q") == latest - 1) | (at_latest & (F.col("seen_before") == latest - 1))
    profile = spans.groupBy("place_key").agg(
        newest.alias("newest"),
        newest_code("sido_code"),
        newest_code("sigungu_code"),
        newest_code("dong_code"),
        F.min("start_q").alias("first_q"),
        F.max("end_q").alias("last_q"),
        F.count_if(at_latest).alias("stores_current"),
        F.count_if(one_before).alias("stores_prev"),
    )
    return profile.select(
        "place_key",
        *[f"newest.{c}" for c in ("building_id", "floor_label", "road_address")],
        "sido_code",
        "sigungu_code",
        "dong_code",
        "newest.lat",
        "newest.lng",
        "first_q",
        "last_q",
        "stores_current",
        "stores_prev",
    )


def _tenure(latest: int) -> Column:
    months = (F.col("end_q") - F.col("start_q") + 1) * F.lit(MONTHS_PER_PERIOD)
    return F.avg(F.when(F.col("end_q") < latest, months)).alias("avg_tenure_months")


def _current(latest: int) -> Column:
    order = F.struct("start_q", "end_q", "name_norm", "cat_code", "cat_name")
    return F.max(F.when(F.col("end_q") == latest, order)).alias("current")


def place_tenure(logical: DataFrame, latest: int) -> DataFrame:
    """Mean length of the ended stays of a place, in months."""
    return logical.filter(F.col("end_q") < latest).groupBy("place_key").agg(_tenure(latest))


def current_category(logical: DataFrame, latest: int) -> DataFrame:
    """Category of the open stay that started last."""
    return (
        logical.filter(F.col("end_q") == latest)
        .groupBy("place_key")
        .agg(_current(latest))
        .select("place_key", F.col("current.cat_code").alias("code"), F.col("current.cat_name").alias("name"))
    )


def places(spans: DataFrame, logical: DataFrame, latest: int, base_year: int = BASE_YEAR) -> DataFrame:
    """One row per place: profile, turnover, mean stay, vacancy, category."""
    stays = logical.groupBy("place_key").agg(_tenure(latest), _current(latest))
    joined = (
        place_profile(spans, latest)
        .join(place_turnover(logical, latest), "place_key", "left")
        .join(stays, "place_key", "left")
    )
    low = F.col("floor_label") == UNKNOWN_FLOOR
    return joined.select(
        "place_key",
        "building_id",
        "floor_label",
        "road_address",
        "sido_code",
        "sigungu_code",
        "dong_code",
        "lat",
        "lng",
        F.coalesce("turnover_count", F.lit(0)).alias("turnover_count"),
        round_half_up(F.col("avg_tenure_months"), 1).alias("avg_tenure_months"),
        F.when(low, F.lit("low")).otherwise(F.lit("high")).alias("confidence"),
        "stores_current",
        ((F.col("stores_current") > 0) | (F.col("stores_prev") > 0)).alias("is_occupied"),
        F.col("current.cat_code").alias("current_category_code"),
        F.col("current.cat_name").alias("current_category_name"),
        to_label(F.col("first_q"), latest, base_year).alias("first_quarter"),
        to_label(F.col("last_q"), latest, base_year).alias("last_quarter"),
    )


def with_point(places: DataFrame) -> DataFrame:
    """Places with their coordinates as one point column, and the point's place on the curve of grid cells."""
    lng, lat = F.col("lng"), F.col("lat")
    return places.withColumns({"geom": point(lng, lat), "cell_key": curve_key(lng, lat)})


def place_history(
    logical: DataFrame,
    latest: int,
    base_year: int = BASE_YEAR,
) -> DataFrame:
    """Numbered chronology of every place, without any shop name."""
    keyed = logical.select(
        "*",
        F.coalesce("own_store", F.lit("")).alias("tie_store"),
        F.coalesce("own_island", F.lit(-1)).alias("tie_island"),
    )
    order = ["start_q", "end_q", "name_norm", "cat_code", "cat_name", "tie_store", "tie_island"]
    numbered = number_rows(keyed, "place_key", order, "seq")
    return numbered.select(
        "place_key",
        F.col("seq").cast("int").alias("seq"),
        to_label(F.col("start_q"), latest, base_year).alias("start_quarter"),
        F.when(F.col("end_q") < latest, to_label(F.col("end_q"), latest, base_year)).alias("end_quarter"),
        F.col("cat_code").alias("category_code"),
        F.col("cat_name").alias("category_name"),
        (F.col("end_q") - F.col("start_q") + 1).alias("tenure_quarters"),
    )


def top_turnover(places: DataFrame, k: int = 10) -> DataFrame:
    """The places whose occupant changed most often."""
    return (
        places.select("place_key", "turnover_count", "road_address", "floor_label")
        .orderBy(F.col("turnover_count").desc_nulls_last(), F.col("place_key"))
        .limit(k)
    )
