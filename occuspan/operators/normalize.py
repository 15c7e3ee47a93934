"""Raw snapshot rows to one clean row per period and shop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.functions import periods, text

# Headers of the snapshot files.
STORE_ID = "상가업소번호"
NAME = "상호명"
BRANCH = "지점명"
CATEGORY_TOP = "상권업종대분류명"
CATEGORY_CODE = "상권업종소분류코드"
CATEGORY_NAME = "상권업종소분류명"
SIDO_CODE, SIDO_NAME = "시도코드", "시도명"
SIGUNGU_CODE, SIGUNGU_NAME = "시군구코드", "시군구명"
DONG_CODE, DONG_NAME = "행정동코드", "행정동명"
ROAD_ADDRESS, LOT_ADDRESS = "도로명주소", "지번주소"
BUILDING = "건물관리번호"
FLOOR = "층정보"
UNIT = "호정보"
LNG, LAT = "경도", "위도"

REQUIRED = (STORE_ID, NAME, CATEGORY_CODE, SIDO_CODE, SIGUNGU_CODE, DONG_CODE, BUILDING, FLOOR, LNG, LAT)
OPTIONAL = (
    BRANCH, CATEGORY_TOP, CATEGORY_NAME, SIDO_NAME, SIGUNGU_NAME, DONG_NAME, ROAD_ADDRESS, LOT_ADDRESS, UNIT,
)
PERIOD = "qord"

STORE_COLUMNS = (
    PERIOD, "store_id", "name_norm", "cat_code", "cat_name", "sido_code", "sido_name", "sigungu_code",
    "sigungu_name", "dong_code", "dong_name", "road_address", "building_id", "floor_label", "place_key", "lng", "lat",
)

# Which of several rows of one shop in one period is kept.
KEEP_ORDER = (
    "place_key", "name_norm", "cat_code", "cat_name", "road_address", "sido_code", "sido_name", "sigungu_code",
    "sigungu_name", "dong_code", "dong_name", "building_id", "lng", "lat",
)


def coordinates_usable() -> Column:
    """Both coordinates parse and the longitude is not zero."""
    return (text.to_number(F.col(LNG)) != 0) & text.to_number(F.col(LAT)).isNotNull()


def row_usable() -> Column:
    return ~text.is_blank(F.col(BUILDING)) & F.coalesce(coordinates_usable(), F.lit(False))


def standard_rows(raw: DataFrame) -> DataFrame:
    """Usable rows in the standard schema; several rows per shop may remain.

    Coordinates and floor are parsed once: what is inlined is not repeated in filter and results.
    """
    once = F.struct(
        text.to_number(F.col(LNG)).alias("_lng"),
        text.to_number(F.col(LAT)).alias("_lat"),
        text.floor_label(F.col(FLOOR)).alias("_floor"),
    )
    parsed = raw.filter(~text.is_blank(F.col(BUILDING))).select("*", F.inline(F.array(once)))
    return parsed.filter((F.col("_lng") != 0) & F.col("_lat").isNotNull()).select(
        F.col(PERIOD).cast("int").alias(PERIOD),
        F.col(STORE_ID).alias("store_id"),
        text.normalized_name(F.col(NAME), F.col(BRANCH)).alias("name_norm"),
        F.coalesce(F.col(CATEGORY_CODE), F.lit(text.UNKNOWN_CATEGORY_CODE)).alias("cat_code"),
        F.coalesce(F.col(CATEGORY_NAME), F.lit(text.UNKNOWN_CATEGORY_NAME)).alias("cat_name"),
        F.col(SIDO_CODE).alias("sido_code"),
        F.col(SIDO_NAME).alias("sido_name"),
        F.col(SIGUNGU_CODE).alias("sigungu_code"),
        F.col(SIGUNGU_NAME).alias("sigungu_name"),
        F.col(DONG_CODE).alias("dong_code"),
        F.col(DONG_NAME).alias("dong_name"),
        text.address(F.col(ROAD_ADDRESS), F.col(LOT_ADDRESS)).alias("road_address"),
        F.col(BUILDING).alias("building_id"),
        F.col("_floor").alias("floor_label"),
        text.labelled_key(F.col(BUILDING), F.col("_floor")).alias("place_key"),
        F.col("_lng").alias("lng"),
        F.col("_lat").alias("lat"),
    )


def one_row_per_store(rows: DataFrame) -> DataFrame:
    """Keep the first row of every (period, shop) under a total order.

    Spark prunes to the first row inside each map task before the shuffle, so
    an id shared by a large part of the rows does not overload one task.
    """
    first = Window.partitionBy("store_id", PERIOD).orderBy(*[F.col(c).asc_nulls_last() for c in KEEP_ORDER])
    return rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def stores(raw: DataFrame) -> DataFrame:
    """The normalized snapshot table: usable rows, one per period and shop."""
    return one_row_per_store(standard_rows(raw)).select(*STORE_COLUMNS)


def drop_report(raw: DataFrame) -> DataFrame:
    """Rows read, rows dropped as unusable and rows kept, per period."""
    per_store = raw.groupBy(PERIOD, STORE_ID).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(row_usable()).alias("usable"),
    )
    return per_store.groupBy(PERIOD).agg(
        F.sum("rows").alias("total"),
        F.sum(F.col("rows") - F.col("usable")).alias("dropped"),
        F.count_if(F.col("usable") > 0).alias("kept"),
    )


def id_date_is_late(store_id: Column, month: Column) -> Column:
    """The shop id carries a date after the month of its snapshot."""
    digits = F.substring(store_id, 7, 6)
    return F.coalesce(digits.rlike(r"^\d{6}\z") & (digits > month), F.lit(False))


def id_contamination(raw: DataFrame, base_year: int = periods.BASE_YEAR) -> DataFrame:
    """Shop ids dated after their own snapshot, per period."""
    late = id_date_is_late(F.col(STORE_ID), periods.last_month(F.col(PERIOD), base_year))
    counted = raw.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("total"), F.count_if(late).alias("late_ids"))
    share = text.round_half_up(F.col("late_ids") * F.lit(100.0) / F.col("total"), 1)
    return counted.withColumn("late_pct", share)
