import json

import pytest
from helpers import logical, store, stores, tuples
from pyspark.sql import functions as F

from occuspan.operators import detail, places, regions, timeline

LATEST = 12


@pytest.fixture(scope="module")
def tables(spark):
    rows = [store(q, "a", "p#1") for q in range(4)] + [store(q, f"n{q}", "p#1", f"name{q}") for q in range(4, 13)]
    rows += [store(q, "b", "q#1", dong_code=None) for q in range(13)]
    rows = stores(spark, rows)
    spans = timeline.spans(rows)
    joined = timeline.logical_stores(spans)
    place_rows = places.places(spans, joined, LATEST)
    history = places.place_history(joined, LATEST)
    stats = regions.region_stats(place_rows, regions.region_names(rows))
    return place_rows.cache(), history.cache(), stats.cache()


def test_documents_hold_place_history_and_neighbourhood(tables):
    found = {r["place_key"]: r for r in detail.place_detail(*tables).collect()}
    assert set(found) == {"p#1", "q#1"}
    p = found["p#1"]
    assert [h["seq"] for h in p["history"]] == list(range(1, 11)) and p["page"] == 0
    assert p["place"]["turnover_count"] == 9 and p["dong"]["region_code"] == "111"
    assert found["q#1"]["dong"] is None and found["q#1"]["history"][0]["end_quarter"] is None


def test_only_known_keys_and_newest_first(spark, tables):
    keys = spark.createDataFrame([("p#1",), ("p#1",), ("nowhere",)], "place_key string")
    docs = detail.place_detail(*tables, keys=keys, newest_first=True)
    rows = docs.collect()
    assert [r["place_key"] for r in rows] == ["p#1"] and [h["seq"] for h in rows[0]["history"]] == list(range(10, 0, -1))
    body = json.loads(detail.detail_json(docs).first()["document"])
    assert set(body) == {"place", "history", "dong"} and body["history"][0]["end_quarter"] is None
    assert "end_quarter" in body["history"][0] and body["place"]["place_key"] == "p#1"


def test_long_histories_continue_on_further_pages(tables):
    docs = detail.place_detail(*tables, page_entries=4).filter("place_key = 'p#1'").orderBy("page").collect()
    assert [r["page"] for r in docs] == [0, 1, 2]
    assert [h["seq"] for r in docs for h in r["history"]] == list(range(1, 11))
    newest = detail.place_detail(*tables, newest_first=True, page_entries=4).filter("place_key = 'p#1'").orderBy("page").collect()
    assert [h["seq"] for r in newest for h in r["history"]] == list(range(10, 0, -1))


def test_place_without_history_has_an_empty_array(tables):
    place_rows, history, stats = tables
    docs = detail.place_detail(place_rows, history.filter("place_key = 'q#1'"), stats).filter("place_key = 'p#1'")
    assert docs.first()["history"] == []


def test_headlines_use_the_last_closed_stay(spark):
    rows = [("p", "a", 0, 3), ("p", "b", 2, 7), ("q", "c", 0, 12)]
    history = places.place_history(logical(spark, rows), LATEST)
    assert tuples(detail.last_ends(history), "place_key", "last_end") == [("p", "2024Q4"), ("q", None)]
    place_rows = spark.createDataFrame(
        [("p", False, 0, 1, 9.0, "2023Q1"), ("q", True, 1, 0, None, "2023Q1")],
        "place_key string, is_occupied boolean, stores_current bigint, turnover_count int, avg_tenure_months double, first_quarter string",
    )
    found = tuples(detail.headlines(place_rows, history), "place_key", "kind", "subtitle")
    assert found == [("p", "vacant", "마지막 영업 기록: 2024.4분기"), ("q", "kept_since_first", "2023년 1분기부터 계속 영업 중")]


def test_texts_and_groups(spark):
    history = places.place_history(logical(spark, [("p", "a", 0, 3, "I201"), ("p", "b", 4, 12, "Z1")]), LATEST)
    assert tuples(detail.history_texts(history), "seq", "symbol", "tenure_text", "period_text") == [
        (1, "🍽️", "1년", "2023.1분기 ~ 2023.4분기 (1년)"), (2, "🏪", "2년 3개월", "2024.1분기 ~ 영업 중"),
    ]
    assert tuples(detail.category_groups(history), "symbol", "stays", "tenure_quarters") == [("🍽️", 1, 4), ("🏪", 1, 9)]
    df = spark.createDataFrame([(0,), (5,), (8,)], "turnover_count int").withColumn("place_key", F.lit("p"))
    assert tuples(detail.turnover_buckets(df), "bucket", "places") == [(0, 1), (5, 2)]
