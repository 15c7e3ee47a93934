"""Small builders for hand-made tables."""

from pyspark.sql import functions as F

from occuspan.operators import normalize

STORES = (
    "qord int, store_id string, name_norm string, cat_code string, cat_name string, sido_code string, "
    "sido_name string, sigungu_code string, sigungu_name string, dong_code string, dong_name string, "
    "road_address string, building_id string, floor_label string, place_key string, lng double, lat double"
)
SPANS = "store_id string, place_key string, island int, start_q int, end_q int, name_norm string, cat_code string"
LOGICAL = "place_key string, name_norm string, start_q int, end_q int, cat_code string"


def store(q, store_id="s", place="b#1", name="n", **other):
    building, _, floor = place.partition("#")
    row = dict(
        qord=q, store_id=store_id, name_norm=name, cat_code="I201", cat_name="c", sido_code="1", sido_name="S",
        sigungu_code="11", sigungu_name="G", dong_code="111", dong_name="D", road_address="r", building_id=building,
        floor_label=floor, place_key=place, lng=127.0, lat=37.5,
    )
    row.update(other)
    return row


def stores(spark, rows):
    names = [part.split()[0] for part in STORES.split(", ")]
    return spark.createDataFrame([tuple(row[name] for name in names) for row in rows], STORES)


def spans(spark, rows):
    """Rows (store_id, place_key, start_q, end_q, name_norm[, cat_code])."""
    full = [(r[0], r[1], 0, r[2], r[3], r[4], r[5] if len(r) > 5 else "I201") for r in rows]
    return spark.createDataFrame(full, SPANS).withColumn("cat_name", F.col("cat_code"))


def logical(spark, rows):
    """Rows (place_key, name_norm, start_q, end_q[, cat_code])."""
    full = [(*r[:4], r[4] if len(r) > 4 else "I201") for r in rows]
    return spark.createDataFrame(full, LOGICAL).select(
        "*",
        F.col("cat_code").alias("cat_name"),
        F.lit(1).cast("bigint").alias("merged_spans"),
        F.lit(None).cast("string").alias("own_store"),
        F.lit(None).cast("int").alias("own_island"),
    )


RAW_DEFAULT = {
    normalize.PERIOD: 0, normalize.STORE_ID: "MA010120230301", normalize.NAME: "가게", normalize.BRANCH: None,
    normalize.CATEGORY_TOP: "음식", normalize.CATEGORY_CODE: "I20101", normalize.CATEGORY_NAME: "백반",
    normalize.SIDO_CODE: "11", normalize.SIDO_NAME: "서울", normalize.SIGUNGU_CODE: "11110",
    normalize.SIGUNGU_NAME: "종로구", normalize.DONG_CODE: "1111051", normalize.DONG_NAME: "청운동",
    normalize.ROAD_ADDRESS: "길 1", normalize.LOT_ADDRESS: "번지 1", normalize.BUILDING: "B1", normalize.FLOOR: "1",
    normalize.UNIT: None, normalize.LNG: "127.0", normalize.LAT: "37.5",
}


def raw(spark, rows):
    """Raw snapshot rows; each dict overrides the default row."""
    schema = ", ".join(f"`{c}` {'int' if c == normalize.PERIOD else 'string'}" for c in RAW_DEFAULT)
    return spark.createDataFrame([tuple({**RAW_DEFAULT, **row}.values()) for row in rows], schema)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
