import random

from helpers import logical, store, stores, tuples
from pyspark.sql import functions as F

from occuspan.operators import places, regions, timeline

LATEST = 12


def chain(spark, rows):
    spans = timeline.spans(stores(spark, rows))
    joined = timeline.logical_stores(spans)
    return spans, joined


def test_place_that_never_changes(spark):
    spans, joined = chain(spark, [store(q) for q in range(13)])
    row = places.places(spans, joined, LATEST).first()
    assert (row["turnover_count"], row["avg_tenure_months"], row["is_occupied"]) == (0, None, True)
    assert (row["first_quarter"], row["last_quarter"], row["stores_current"]) == ("2023Q1", "2026Q1", 1)
    assert row["current_category_code"] == "I201" and row["confidence"] == "high"
    assert tuple(row.asDict()) == places.PLACE_COLUMNS


def test_vacancy_needs_two_empty_periods(spark):
    rows = [store(q, "a", "gone#1") for q in range(11)] + [store(q, "b", "late#미상") for q in range(12)]
    rows += [store(12, "c", "new#1"), store(10, "d", "gap#1"), store(12, "d", "gap#1")]
    spans, joined = chain(spark, rows)
    found = tuples(places.places(spans, joined, LATEST), "place_key", "stores_current", "is_occupied", "confidence")
    assert found == [
        ("gap#1", 1, True, "high"), ("gone#1", 0, False, "high"), ("late#미상", 0, True, "low"), ("new#1", 1, True, "high"),
    ]
    previous = dict(tuples(places.place_profile(spans, LATEST), "place_key", "stores_prev"))
    assert previous == {"gap#1": 0, "gone#1": 0, "late#미상": 1, "new#1": 0}


def test_profile_takes_the_latest_known_value(spark):
    rows = [
        store(0, "a", dong_code="old", road_address="r0"),
        store(3, "b", dong_code=None, road_address="r3b", lat=1.0, lng=2.0),
        store(3, "a", dong_code=None, road_address="r3a", lat=3.0, lng=4.0),
    ]
    spans, _ = chain(spark, rows)
    row = places.place_profile(spans, LATEST).first()
    assert (row["dong_code"], row["road_address"], row["lat"], row["lng"]) == ("old", "r3b", 1.0, 2.0)


def test_profile_from_spans_equals_profile_from_sightings(spark):
    rng = random.Random(9)
    seen = {(f"s{rng.randrange(12)}", rng.randrange(13)) for _ in range(130)}
    rows = [
        store(
            q, s, f"b{(int(s[1:]) + q // 5) % 4}#1",
            sigungu_code=rng.choice([None, "1", "2"]), dong_code=rng.choice([None, None, "3", "4"]),
            road_address=f"r{rng.randrange(9)}",
        )
        for s, q in seen
    ]
    wanted = []
    for place in {r["place_key"] for r in rows}:
        here = sorted((r for r in rows if r["place_key"] == place), key=lambda r: (r["qord"], r["store_id"]))
        known = {c: next((r[c] for r in reversed(here) if r[c]), None) for c in ("sigungu_code", "dong_code")}
        wanted.append((
            place, here[-1]["road_address"], known["sigungu_code"], known["dong_code"], here[0]["qord"], here[-1]["qord"],
            sum(r["qord"] == 12 for r in here), sum(r["qord"] == 11 for r in here),
        ))
    spans, _ = chain(spark, rows)
    columns = "place_key road_address sigungu_code dong_code first_q last_q stores_current stores_prev".split()
    assert tuples(places.place_profile(spans, LATEST), *columns) == sorted(wanted, key=repr)


def test_history_is_numbered_and_has_no_names(spark):
    rows = [("p", "b", 2, 12, "B"), ("p", "a", 2, 12, "A"), ("p", "c", 0, 1, "C"), ("q", "z", 0, 0, "Z")]
    df = places.place_history(logical(spark, rows), LATEST)
    assert tuple(df.columns) == places.HISTORY_COLUMNS
    assert tuples(df, "place_key", "seq", "start_quarter", "end_quarter", "category_code", "tenure_quarters") == [
        ("p", 1, "2023Q1", "2023Q2", "C", 2), ("p", 2, "2023Q3", None, "A", 11), ("p", 3, "2023Q3", None, "B", 11),
        ("q", 1, "2023Q1", "2023Q1", "Z", 1),
    ]


def test_tenure_and_current_category(spark):
    rows = [("p", "a", 0, 2), ("p", "b", 3, 4), ("p", "c", 5, 12, "OLD"), ("p", "d", 7, 12, "NEW"), ("q", "e", 0, 12)]
    table = logical(spark, rows)
    assert tuples(places.place_tenure(table, LATEST), "place_key", "avg_tenure_months") == [("p", 7.5)]
    assert tuples(places.current_category(table, LATEST), "place_key", "code") == [("p", "NEW"), ("q", "I201")]


def place_rows(spark):
    schema = "place_key string, sido_code string, sigungu_code string, dong_code string, lat double, lng double, " \
             "turnover_count int, avg_tenure_months double"  # fmt: skip
    rows = [
        ("a", "1", "11", "111", 37.0, 127.0, 3, 6.1), ("b", "1", "11", "112", 38.0, 128.0, 0, None),
        ("c", "1", "12", None, 39.0, 129.0, 5, 6.2), ("d", "2", "21", "211", 30.0, 120.0, 1, 9.0),
    ]
    return spark.createDataFrame(rows, schema)


def test_region_stats_at_three_levels(spark):
    names = spark.createDataFrame([("sido", "1", "Seoul"), ("dong", "111", None)], "region_level string, region_code string, region_name string")
    stats = regions.region_stats(place_rows(spark), names)
    found = {(r["region_level"], r["region_code"]): r for r in stats.collect()}
    assert len(found) == 2 + 3 + 4
    seoul = found["sido", "1"]
    assert (seoul["region_name"], seoul["center_lat"], seoul["place_count"], seoul["turnover_sum"]) == ("Seoul", 38.0, 3, 8)
    assert (seoul["turnover_avg"], seoul["hot_place_count"], seoul["avg_tenure_months"]) == (2.67, 2, 6.2)
    assert found["dong", "112"]["avg_tenure_months"] is None and found["dong", "111"]["region_name"] == "111"
    assert found["dong", None]["place_count"] == 1 and found["dong", None]["region_name"] is None
    assert tuple(stats.columns) == regions.REGION_COLUMNS


def test_region_names_are_the_latest_known(spark):
    rows = [store(0, "a", dong_name="old"), store(5, "a", dong_name=None), store(3, "b", dong_name="new", sido_name=None)]
    found = tuples(regions.region_names(stores(spark, rows)), "region_level", "region_code", "region_name")
    assert found == [("dong", "111", "new"), ("sido", "1", "S"), ("sigungu", "11", "G")]


def test_region_stats_expand_once_before_one_shuffle(spark):
    plan = regions.region_stats(place_rows(spark), spark.createDataFrame([], "region_level string, region_code string, region_name string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Expand") == 1 and "Union" not in text


def test_top_turnover_and_point(spark):
    df = place_rows(spark).select("*", F.lit("r").alias("road_address"), F.lit("1").alias("floor_label"))
    assert [r["place_key"] for r in places.top_turnover(df, 2).collect()] == ["c", "a"]
    assert tuple(places.with_point(df.filter("place_key = 'a'")).first()["geom"]) == (127.0, 37.0)
