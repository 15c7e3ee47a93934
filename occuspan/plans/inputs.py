"""The given order tables read as shop snapshots, and the tables built on them."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.operators import normalize as raw_names
from occuspan.operators import places as place_tables
from occuspan.operators import regions as region_tables
from occuspan.operators import snapshot_diff, timeline
from occuspan.session import shared_folder, spread, stage, tune

BASE_YEAR = 1995

# Category groups a brand maps to; the last one is unknown on purpose.
GROUP_CODES = ("G2", "I1", "I2", "L1", "M1", "N1", "P1", "Q1", "R1", "S2", "Z9")

# Half widths of the viewports in hundredths of a degree, and row limits.
HALF_WIDTHS = (1, 2, 4, 8, 20, 80)
ROW_LIMITS = (0, 3, 10, 500, 5000)

SEARCH_TERMS = ("Road 1", "brand#2", "Brand#2 ", "ECONOMY", "(상호없음)", "x")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: Column) -> Column:
    return value.cast("string")


def _at_least(value: Column, width: int) -> Column:
    """Zero-padded number that is never cut."""
    digits = _text(value)
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def raw_snapshots(spark: SparkSession, sf_dir: str, period: int | None = None) -> DataFrame:
    """One row per order line, shaped like a row of a shop snapshot.

    The supplier is the building, the brand the shop, the quarter of shipment
    the period. Missing values, bad coordinates, repeated rows, missing
    periods and re-issued ids are derived from the keys. ``period`` selects one
    snapshot, as a period folder does.
    """
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    if period is not None:  # a range of dates reaches the scan, a quarter does not
        first, after = (date(BASE_YEAR + p // 4, p % 4 * 3 + 1, 1) for p in (period, period + 1))
        lines = lines.filter((F.col("l_shipdate") >= F.lit(first)) & (F.col("l_shipdate") < F.lit(after)))
    lines = spread(lines)
    # What one part or supplier fixes is worked out once for it, not again for each of its lines.
    # A brand without a number is an error only where a line has it.
    b, s = F.col("b"), F.col("s")
    digits = F.regexp_extract("p_brand", r"(\d+)", 1)
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", digits.alias("digits"))
    parts = parts.withColumn("b", F.col("digits").try_cast("int"))
    group = F.element_at(F.array(*[F.lit(code) for code in GROUP_CODES]), (b % len(GROUP_CODES)) + 1)
    parts = parts.select(
        "p_partkey",
        "p_brand",
        "p_type",
        "digits",
        F.upper("p_brand").alias("upper_brand"),
        F.lpad(_text(b), 2, "0").alias("two_digits"),
        F.concat(group, F.lpad(_text(F.col("p_size") % 7), 3, "0")).alias("code"),
        F.concat(F.lit(" "), _text(b % 4 + 1), F.lit(" ")).alias("own_floor"),
    )
    suppliers = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), "s_nationkey")
    suppliers = suppliers.select(
        "s",
        "s_nationkey",
        F.lpad(_text(s % 10000), 4, "0").alias("four_digits"),
        F.when(s >= 10000, _text(F.floor(s / 10000))).otherwise(F.lit("")).alias("overflow"),
        F.concat(F.lit("No."), _text(s % 4)).alias("own_branch"),
        _text(s % 3).alias("third"),
        F.when(s % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("Road "), _text(s))).alias("road"),
        F.when(s % 34 == 0, F.lit("")).otherwise(F.concat(F.lit("Lot "), _text(s))).alias("lot"),
        F.concat(F.lit("B"), _at_least(s, 5)).alias("own_building"),
        F.concat(F.lit("126."), _text(s % 50 + 50)).alias("own_lng"),
        F.concat(F.lit("37."), F.lpad(_text(s * 37 % 100), 2, "0")).alias("lat"),
    )
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name", _text(F.col("n_nationkey")).alias("sigungu"))
    regions = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name", _text(F.col("r_regionkey")).alias("sido"))
    joined = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == s)
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    year = F.year("l_shipdate")
    q = (year - BASE_YEAR) * 4 + F.quarter("l_shipdate") - 1
    base = joined.select(
        "*",
        F.col("l_orderkey").alias("k"),
        F.col("digits").cast("int").alias("b"),
        year.alias("y"),
        q.alias("q"),
        F.concat("sigungu", F.lit("-"), "third").alias("district"),
    ).filter(b % 5 != F.col("q") % 7)
    if period is not None:
        base = base.filter(F.col("q") == period)
    k, y = F.col("k"), F.col("y")
    dated = F.when(k % 211 == 0, F.lit("209912")).otherwise(F.concat(_text(y - y % 2), F.lit("01")))
    name = (
        F.when(k % 53 == 0, F.lit(None))
        .when(k % 5 == 0, F.concat(F.lit("(주) "), F.col("p_brand")))
        .when(k % 5 == 1, F.col("upper_brand"))
        .otherwise(F.col("p_brand"))
    )
    branch = F.when((b % 3 == 0) & (k % 53 != 0), F.col("own_branch"))
    code = F.when(k % 61 != 0, F.col("code"))
    building = (
        F.when(k % 89 == 0, F.lit(None))
        .when(k % 97 == 0, F.lit(" "))
        .otherwise(F.col("own_building"))
    )
    floor = F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(F.col("own_floor"))
    lng = (
        F.when(k % 101 == 0, F.lit("x"))
        .when(k % 103 == 0, F.lit("0"))
        .otherwise(F.col("own_lng"))
    )
    columns = [
        F.col("q").alias(raw_names.PERIOD),
        F.concat(F.lit("MA"), "four_digits", dated, "two_digits", "overflow").alias(raw_names.STORE_ID),
        name.alias(raw_names.NAME),
        branch.alias(raw_names.BRANCH),
        F.substring(code, 1, 2).alias(raw_names.CATEGORY_TOP),
        code.alias(raw_names.CATEGORY_CODE),
        F.when(k % 67 != 0, F.col("p_type")).alias(raw_names.CATEGORY_NAME),
        F.col("sido").alias(raw_names.SIDO_CODE),
        F.col("r_name").alias(raw_names.SIDO_NAME),
        F.when(k % 71 != 0, F.col("sigungu")).alias(raw_names.SIGUNGU_CODE),
        F.col("n_name").alias(raw_names.SIGUNGU_NAME),
        F.when(k % 73 != 0, F.col("district")).alias(raw_names.DONG_CODE),
        F.when(k % 79 != 0, F.concat(F.lit("DONG_"), F.col("district"))).alias(raw_names.DONG_NAME),
        F.col("road").alias(raw_names.ROAD_ADDRESS),
        F.col("lot").alias(raw_names.LOT_ADDRESS),
        building.alias(raw_names.BUILDING),
        floor.alias(raw_names.FLOOR),
        F.lit(None).cast("string").alias(raw_names.UNIT),
        lng.alias(raw_names.LNG),
        F.col("lat").alias(raw_names.LAT),
    ]
    # Inlining a struct evaluates each of these columns once; as a projection
    # they would be repeated inside every filter and rule that reads them.
    return base.select(F.inline(F.array(F.struct(*columns))))


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map request per customer; edges fall exactly on place coordinates."""
    v = F.col("c_custkey")
    half = F.element_at(F.array(*[F.lit(w) for w in HALF_WIDTHS]), (v % len(HALF_WIDTHS)).cast("int") + 1)
    x, y = v * 7 % 50 + 12650, v * 53 % 100 + 3700
    return read_table(spark, sf_dir, "customer").select(
        v.alias("viewport_id"),
        ((x - half) / F.lit(100.0)).alias("min_lng"),
        ((y - half) / F.lit(100.0)).alias("min_lat"),
        ((x + half) / F.lit(100.0)).alias("max_lng"),
        ((y + half) / F.lit(100.0)).alias("max_lat"),
        (v % 3 * 5).cast("int").alias("min_turnover"),
        F.element_at(F.array(*[F.lit(n) for n in ROW_LIMITS]), (v % len(ROW_LIMITS)).cast("int") + 1).alias("max_rows"),
    )


def expected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place keys one may ask for: every supplier on floors 1 to 5 and unknown."""
    floors = F.array(*[F.lit(floor) for floor in ("1", "2", "3", "4", "5", "미상")])
    asked = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(floors).alias("floor"))
    return asked.select(F.concat(F.lit("B"), _at_least(F.col("s_suppkey"), 5), F.lit("#"), "floor").alias("place_key"))


class Tables:
    """The stages of the build over one data directory, each a lazy DataFrame.

    ``stores``, ``spans`` and ``logical`` are plans down to the scan. The
    ``built`` tables are staged, for queries that read a stage several times.
    With ``stage_stores`` off, spans are read off the snapshot rows as these are made: for
    queries in which nothing but the spans reads them, and which build no regions.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stage_stores: bool = True):
        self.spark, self.sf_dir, self.stage_stores = tune(spark), sf_dir, stage_stores

    @cached_property
    def raw(self) -> DataFrame:
        return raw_snapshots(self.spark, self.sf_dir)

    @cached_property
    def latest(self) -> int:
        """Latest period on record, from one column of the scan."""
        shipped = F.max("l_shipdate")
        lines = read_table(self.spark, self.sf_dir, "lineitem")
        row = lines.agg(((F.year(shipped) - BASE_YEAR) * 4 + F.quarter(shipped) - 1).alias("q")).first()
        return row["q"]

    @cached_property
    def stores(self) -> DataFrame:
        return raw_names.stores(self.raw)

    @cached_property
    def spans(self) -> DataFrame:
        return timeline.spans(self.stores)

    @cached_property
    def logical(self) -> DataFrame:
        return timeline.logical_stores(self.spans)

    @cached_property
    def folder(self) -> str:
        return shared_folder(self.spark)

    @cached_property
    def built_stores(self) -> DataFrame:
        return stage(self.stores, self.folder, "stores")

    @cached_property
    def built_spans(self) -> DataFrame:
        return stage(timeline.spans(self.built_stores) if self.stage_stores else self.spans, self.folder, "spans")

    @cached_property
    def built_logical(self) -> DataFrame:
        return stage(timeline.logical_stores(self.built_spans), self.folder, "logical_stores")

    @cached_property
    def places(self) -> DataFrame:
        return place_tables.places(self.built_spans, self.built_logical, self.latest, BASE_YEAR)

    @cached_property
    def history(self) -> DataFrame:
        return place_tables.place_history(self.built_logical, self.latest, BASE_YEAR)

    @cached_property
    def regions(self) -> DataFrame:
        return region_tables.region_stats(self.built_places, region_tables.region_names(self.built_stores))

    @cached_property
    def built_places(self) -> DataFrame:
        return stage(self.places, self.folder, "places")

    @cached_property
    def built_history(self) -> DataFrame:
        return stage(self.history, self.folder, "place_history")

    @cached_property
    def built_regions(self) -> DataFrame:
        return stage(self.regions, self.folder, "region_stats")

    @cached_property
    def published(self) -> dict[str, DataFrame]:
        return {"places": self.built_places, "place_history": self.built_history, "region_stats": self.built_regions}

    @cached_property
    def viewports(self) -> DataFrame:
        return viewports(self.spark, self.sf_dir)

    @cached_property
    def gate_keys(self) -> DataFrame:
        return expected_keys(self.spark, self.sf_dir)

    @cached_property
    def first_rows(self) -> DataFrame:
        rows = snapshot_diff.snapshot_rows(raw_snapshots(self.spark, self.sf_dir, 0))
        return stage(rows, self.folder, "first_rows")

    @cached_property
    def latest_rows(self) -> DataFrame:
        rows = snapshot_diff.snapshot_rows(raw_snapshots(self.spark, self.sf_dir, self.latest))
        return stage(rows, self.folder, "latest_rows")

    @cached_property
    def diff(self) -> DataFrame:
        return snapshot_diff.snapshot_diff(self.first_rows, self.latest_rows)
