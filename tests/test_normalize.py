from helpers import raw, tuples
from pyspark.sql import functions as F

from occuspan.operators import normalize as n
from occuspan.operators import snapshot_diff


def test_unusable_rows_are_dropped_and_counted(spark):
    rows = [
        {n.STORE_ID: "ok"},
        {n.STORE_ID: "ok", n.BUILDING: "B0"},
        {n.STORE_ID: "blank", n.BUILDING: " 　"},
        {n.STORE_ID: "null", n.BUILDING: None},
        {n.STORE_ID: "text", n.LNG: "x"},
        {n.STORE_ID: "zero", n.LNG: "0.0"},
        {n.STORE_ID: "lat0", n.LAT: "0"},
        {n.STORE_ID: "nolat", n.LAT: ""},
        {n.STORE_ID: "nan", n.LNG: "nan"},
        {n.STORE_ID: None, n.NAME: "a"},
        {n.STORE_ID: None, n.NAME: "b"},
        {n.STORE_ID: "ok", n.PERIOD: 1},
    ]
    df = raw(spark, rows)
    kept = n.stores(df)
    assert tuples(kept, "qord", "store_id", "place_key") == sorted(
        [(0, "ok", "B0#1"), (0, "lat0", "B1#1"), (0, "nan", "B1#1"), (0, None, "B1#1"), (1, "ok", "B1#1")], key=repr
    )
    assert tuples(n.drop_report(df), "qord", "total", "dropped", "kept") == [(0, 11, 5, 4), (1, 1, 0, 1)]


def test_defaults(spark):
    row = {n.CATEGORY_CODE: None, n.CATEGORY_NAME: None, n.ROAD_ADDRESS: "", n.FLOOR: " ", n.DONG_CODE: None}
    found = n.stores(raw(spark, [row])).first()
    assert (found["cat_code"], found["cat_name"], found["road_address"]) == ("?", "미분류", "번지 1")
    assert (found["place_key"], found["floor_label"], found["dong_code"]) == ("B1#미상", "미상", None)


def test_duplicates_do_not_depend_on_order(spark):
    rows = [{n.BUILDING: f"B{i % 7}", n.NAME: f"n{i % 5}", n.CATEGORY_CODE: None if i % 3 else "A"} for i in range(60)]
    wanted = tuples(n.stores(raw(spark, rows)), *n.STORE_COLUMNS)
    assert len(wanted) == 1
    assert tuples(n.stores(raw(spark, rows[::-1]).repartition(5)), *n.STORE_COLUMNS) == wanted


def test_dedupe_prunes_before_the_shuffle(spark):
    plan = n.stores(raw(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1


def test_late_ids_and_missing_values(spark):
    rows = [
        {n.STORE_ID: "MA0101202303xx"},
        {n.STORE_ID: "MA0101202304xx"},
        {n.STORE_ID: "MA01012023A4xx"},
        {n.STORE_ID: None, n.FLOOR: None, n.LAT: "x"},
    ]
    df = raw(spark, rows)
    assert tuples(n.id_contamination(df), "qord", "total", "late_ids", "late_pct") == [(0, 4, 1, 25.0)]
    profile = {r["metric"]: (r["rows"], r["pct"]) for r in snapshot_diff.missing_profile(df).collect()}
    assert profile == {
        "total": (4, 100.0), "no_building": (0, 0.0), "no_floor": (1, 25.0), "no_unit": (4, 100.0),
        "late_id": (1, 25.0), "bad_coordinates": (1, 25.0),
    }


def test_place_sizes(spark):
    rows = [{n.BUILDING: f"B{b}"} for b, size in enumerate((1, 1, 2, 10)) for _ in range(size)] + [{n.BUILDING: None}]
    found = snapshot_diff.place_size_quantiles(raw(spark, rows)).select("qord", "median", F.round("p95", 6), "largest")
    assert [tuple(r) for r in found.collect()] == [(0, 1.5, 8.8, 10)]
