import datetime

from helpers import tuples

from occuspan.operators import metadata, places, quality, regions

PLACE = (
    "place_key string, building_id string, floor_label string, road_address string, sido_code string, sigungu_code string, "
    "dong_code string, lat double, lng double, turnover_count int, avg_tenure_months double, confidence string, "
    "stores_current bigint, is_occupied boolean, current_category_code string, current_category_name string, "
    "first_quarter string, last_quarter string"
)
HISTORY = (
    "place_key string, seq int, start_quarter string, end_quarter string, category_code string, category_name string, "
    "tenure_quarters int"
)
REGION = (
    "region_level string, region_code string, region_name string, center_lat double, center_lng double, place_count bigint, "
    "turnover_sum bigint, turnover_avg double, hot_place_count bigint, avg_tenure_months double"
)


def place(key, turnover=0, months=None, floor="1", confidence="high", dong="111"):
    return (key, "b", floor, "r", "1", "11", dong, 37.0, 127.0, turnover, months, confidence, 1, True, "c", "n", "2023Q1", "2026Q1")


def tables(spark, place_rows=None, history_rows=None, dong_places=3):
    place_rows = place_rows or [place("a"), place("b", floor="미상", confidence="low"), place("c", 2, 9.0)]
    history_rows = history_rows or [("a", 1, "2023Q1", None, "c", "n", 13), ("c", 1, "2023Q1", "2023Q2", "c", "n", 2)]
    region = [("dong", "111", "D", 37.0, 127.0, dong_places, 2, 0.67, 0, 9.0), ("sido", "1", "S", 37.0, 127.0, 99, 2, 0.67, 0, None)]
    return (
        spark.createDataFrame(place_rows, PLACE),
        spark.createDataFrame(history_rows, HISTORY),
        spark.createDataFrame(region, REGION),
    )


def results(df):
    return {r["check"]: r["ok"] for r in df.collect()}


def test_all_checks_pass(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "place_key string")
    found = results(quality.quality_checks(*tables(spark), gate_keys=keys, place_count_range=(1, 10)))
    assert len(found) == 8 and all(found.values())


def test_each_check_can_fail(spark):
    default = results(quality.quality_checks(*tables(spark)))
    assert not default["place_count"] and "gate_places_found" not in default
    rows = [place("a", 1, 0.0), place("b", 1, 50.0, confidence="low"), place("c", 0)]
    history = [("zz", 1, "2023Q1", None, "c", "n", 1), ("a", 1, "2024Q1", "2023Q2", "c", "n", 1)]
    keys = spark.createDataFrame([("a",), ("nowhere",)], "place_key string")
    found = results(quality.quality_checks(*tables(spark, rows, history, dong_places=2), gate_keys=keys))
    assert found == dict.fromkeys(found, False) and len(found) == 8


def test_no_tenure_at_all_is_not_in_range(spark):
    found = results(quality.quality_checks(*tables(spark, [place("a"), place("b"), place("c")]), place_count_range=(1, 9)))
    assert not found["tenure_range"] and found["zero_turnover_is_mode"]


def test_histogram_orphans_and_gate(spark):
    place_rows, history, _ = tables(spark, history_rows=[("a", 1, "2023Q1", None, "c", "n", 1), ("zz", 1, "2023Q1", None, "c", "n", 1),
                                                          ("zz", 2, "2023Q1", None, "c", "n", 1)])
    assert tuples(quality.turnover_histogram(place_rows), "turnover_count", "places", "is_mode") == [(0, 2, True), (2, 1, False)]
    assert tuples(quality.orphan_history(history, place_rows), "place_key", "history_rows") == [("zz", 2)]
    assert tuples(quality.drop_orphans(history, place_rows), "place_key") == [("a",)]
    keys = spark.createDataFrame([("a",), ("b",), ("x",)], "place_key string")
    assert tuple(quality.gate_lookup(place_rows, keys).first()) == (3, 2, False)


def test_constraint_violations(spark):
    rows = [place("a", dong=None), place("a", confidence="medium"), place("c")]
    history = [("a", 1, None, None, "c", "n", 1), ("a", 1, "2023Q1", None, "c", "n", 1), ("zz", 1, "2023Q1", None, "c", "n", 1)]
    found = quality.constraint_violations(*tables(spark, rows, history))
    broken = {(r["table"], r["rule"]): r["violations"] for r in found.collect() if r["violations"]}
    assert broken == {
        ("places", "dong_code not null"): 1, ("places", "confidence allowed"): 1, ("places", "place_key unique"): 1,
        ("place_history", "start_quarter not null"): 1, ("place_history", "place_key,seq unique"): 1,
        ("place_history", "place_key references places"): 1,
    }


def test_metadata(spark):
    old, new = datetime.datetime(2026, 5, 1), datetime.datetime(2026, 8, 8)
    stamps = spark.createDataFrame([("2026Q1", "전국", new)], "latest_quarter string, coverage string, built_at timestamp")
    incoming = metadata.build_metadata(stamps)
    current = spark.createDataFrame([("coverage", "서울", old), ("extra", "kept", old), ("latest_quarter", "tie", new)],
                                    "key string, value string, updated_at timestamp")
    merged = metadata.upsert_metadata(current, incoming)
    assert tuples(merged, "key", "value") == [
        ("coverage", "전국"), ("data_version", "2026Q1+2026-08-08"), ("extra", "kept"), ("latest_quarter", "2026Q1"),
    ]
    assert tuple(metadata.metadata_record(merged).first()) == ("2026Q1", "전국", "2026Q1+2026-08-08")
    assert tuple(metadata.metadata_record(merged.filter("key = 'none'")).first()) == (None, None, None)


def test_schemas_fit_the_published_columns():
    assert tuple(c.split()[0] for c in PLACE.split(", ")) == places.PLACE_COLUMNS
    assert tuple(c.split()[0] for c in HISTORY.split(", ")) == places.HISTORY_COLUMNS
    assert tuple(c.split()[0] for c in REGION.split(", ")) == regions.REGION_COLUMNS
