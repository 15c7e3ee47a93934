import struct

import duckdb
import pytest
from helpers import tuples
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from occuspan.functions import geo, labels, periods, text


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def mapped(spark, values, function, kind="string"):
    rows = one_column(spark, values, kind).select("i", function(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_names_are_compared_without_suffix_and_punctuation(spark):
    pairs = [("(주)파크이앤씨", None), ("파크이앤씨", ""), ("（주）", None), ("주식회사 A-B.C", " 1호·점 "), (None, None), ("㈜X&Y", None)]
    df = spark.createDataFrame(pairs, "name string, branch string")
    found = [r[0] for r in df.select(text.normalized_name(F.col("name"), F.col("branch"))).collect()]
    assert found == ["파크이앤씨", "파크이앤씨", "주", "abc1호점", "", "xy"]
    shown = [r[0] for r in df.select(text.display_name(F.col("name"), F.col("branch"))).collect()]
    assert shown[0] == "(주)파크이앤씨" and shown[4] == "(상호없음)" and shown[3] == "주식회사 A-B.C  1호·점 "


def test_floor_trims_spaces_but_not_tabs(spark):
    assert mapped(spark, [" 1 ", "　지 ", "\t1", "  ", "", None], text.floor_label) == [
        "1", "지", "\t1", "미상", "미상", "미상",
    ]


def test_place_key_keeps_building_as_written(spark):
    df = spark.createDataFrame([(" B1", " 2 "), ("B", None), (None, "1")], "b string, f string")
    assert [r[0] for r in df.select(text.place_key(F.col("b"), F.col("f"))).collect()] == [" B1#2", "B#미상", None]


def test_address_falls_back_to_lot(spark):
    df = spark.createDataFrame([("r", "l"), ("", "l"), (None, ""), (None, None)], "r string, l string")
    assert [r[0] for r in df.select(text.address(F.col("r"), F.col("l"))).collect()] == ["r", "l", "", ""]


NUMBERS = [
    "127", " 127.5 ", "", " ", "x", "0", "127.1d", "127.1f", "0x10", "1_000", "1__0", "_1", "1_", "1e5", "1e", ".5", "5.",
    "+5", "-5", "1e1_0", "\t12\n", "\v12", "1,000", "inf", "-Infinity", "NaN", "1.5_5", "１２", "1e400", None,
]


def test_numbers_parse_as_in_sql(spark):
    con = duckdb.connect()
    wanted = [con.execute("select try_cast(? as double)", [v]).fetchall()[0][0] for v in NUMBERS]
    assert repr(mapped(spark, NUMBERS, text.to_number)) == repr(wanted)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789._eE+- x", max_size=7), min_size=1, max_size=60))
def test_random_numbers_parse_as_in_sql(spark, values):
    # A sign followed by another sign is accepted by one SQL engine only.
    values = [v for v in values if "+-" not in v and "-+" not in v and "--" not in v and "++" not in v]
    con = duckdb.connect()
    wanted = [con.execute("select try_cast(? as double)", [v]).fetchall()[0][0] for v in values]
    assert mapped(spark, values or ["1"], text.to_number) == (wanted or [1.0])


def test_rounding_and_fixed_digits(spark):
    assert mapped(spark, [1.25, 1.005, 0.04, None], lambda v: text.round_half_up(v, 1), "double") == [1.3, 1.0, 0.0, None]
    values = [i / 100 for i in range(0, 3000, 5)] + [struct.unpack("d", struct.pack("Q", 0x3FB999999999999A))[0], 1234.25]
    assert mapped(spark, values, lambda v: text.fixed_digits(v, 1), "double") == [f"{v:.1f}" for v in values]
    negative = [-126.0005, -0.0004, 126.97656, 37.5]
    assert mapped(spark, negative, lambda v: text.fixed_digits(v, 3), "double") == [f"{v:.3f}" for v in negative]


def test_labels_and_ordinals(spark):
    assert mapped(spark, ["2023Q1", "2026Q1", "2022Q4", "2023Q5", "2023q1", "23Q1", "2023Q1\n", None], periods.to_ordinal) == [
        0, 12, -1, None, None, None, None, None,
    ]
    assert mapped(spark, [0, 9, 12, 13, -1, None], lambda q: periods.to_label(q, 12), "int") == [
        "2023Q1", "2025Q2", "2026Q1", None, None, None,
    ]
    assert [periods.label_of(q) for q in (0, 7, -1)] == ["2023Q1", "2024Q4", "2022Q4"]
    assert periods.ordinal_of("2025Q4") == 11
    for bad in ("2023Q0", "2023", "20233Q1", "2023Q11"):
        with pytest.raises(ValueError):
            periods.ordinal_of(bad)


def test_month_to_label(spark):
    months = mapped(spark, list(range(1, 13)), lambda m: periods.month_to_label(F.lit(2025), m), "int")
    assert months == ["2025Q1"] * 3 + ["2025Q2"] * 3 + ["2025Q3"] * 3 + ["2025Q4"] * 3
    assert mapped(spark, [0, 11], periods.last_month, "int") == ["202303", "202512"]


def test_quarter_display(spark):
    assert mapped(spark, ["2023Q1", "2023", "", "Q2023Q1", "2023Q", "aQbQc"], periods.short_display) == [
        "2023.1분기", "2023", "", "2023.1분기", "2023Q", "aQbQc",
    ]
    assert mapped(spark, ["2025Q4"], periods.long_display) == ["2025년 4분기"]


def test_tenure_and_period_text(spark):
    assert mapped(spark, [None, 0, -1, 1, 3, 4, 5, 13], labels.tenure_text, "int") == [
        None, None, None, "3개월", "9개월", "1년", "1년 3개월", "3년 3개월",
    ]
    df = spark.createDataFrame([("2024Q2", "2025Q1", 4), ("2025Q3", None, 2), ("2024Q1", "2024Q1", None)], "s string, e string, n int")
    assert [r[0] for r in df.select(labels.period_text(F.col("s"), F.col("e"), F.col("n"))).collect()] == [
        "2024.2분기 ~ 2025.1분기 (1년)", "2025.3분기 ~ 영업 중", "2024.1분기 ~ 2024.1분기",
    ]


def test_address_line(spark):
    df = spark.createDataFrame([("길 1", "1", 8.5), ("길 1", "미상", None)], "r string, f string, m double")
    assert [r[0] for r in df.select(labels.address_line(F.col("r"), F.col("f"), F.col("m"))).collect()] == [
        "길 1 · 1층 · 평균 9개월", "길 1 · 층 미상",
    ]


def test_headline_cases_in_order(spark):
    rows = [
        (False, 3, 5, 9.0, "2023Q1", "2025Q1"),
        (False, 0, 0, None, "2023Q1", None),
        (True, 2, 5, 9.0, "2023Q1", None),
        (True, 1, 1, 10.5, "2023Q1", None),
        (True, 0, 1, None, "2023Q1", None),
        (True, 1, 0, None, "2023Q1", None),
        (True, 1, 0, None, "2024Q2", None),
    ]
    df = spark.createDataFrame(rows, "o boolean, n bigint, t int, m double, f string, e string")
    line = labels.headline(*[F.col(c) for c in "ontmfe"])
    found = [tuple(r[0]) for r in df.select(line.alias("x")).collect()]
    assert [f[0] for f in found] == ["vacant", "vacant", "shared", "changed", "changed", "kept_since_first", "kept"]
    assert found[0][2] == "마지막 영업 기록: 2025.1분기" and found[1][2] is None
    assert found[2][1] == "이 층 점포 2곳 · 교체 5번"
    assert found[3][2] == "평균 11개월마다 새 가게가 들어왔어요" and found[4][2] is None
    assert found[5][2] == "2023년 1분기부터 계속 영업 중" and found[6][2] == "2024년 2분기부터 계속 영업 중"


def test_neighbourhood_comparison(spark):
    rows = [(4, 2.0), (1, 2.0), (51, 100.0), (3, 0.0), (1, None), (0, 0.25)]
    df = spark.createDataFrame(rows, "t int, m double")
    kinds = df.select(labels.neighbourhood_class(F.col("t"), F.col("m")), labels.neighbourhood_text(F.col("t"), F.col("m")))
    found = [tuple(r) for r in kinds.collect()]
    assert [f[0] for f in found] == ["frequent", "lasting", "similar", None, None, "lasting"]
    assert found[0][1] == "이 동네 평균(2.0번)보다 눈에 띄게 잦은 자리예요"
    assert found[3][1] is None and found[5][1].startswith("이 동네 평균(0.2번)")


def test_categories_and_buckets(spark):
    assert mapped(spark, ["I21201", "G2", "Z9", "", None], labels.category_symbol) == ["🍽️", "🛍️", "🏪", "🏪", "🏪"]
    assert mapped(spark, [0, 4, 5, 9], labels.turnover_bucket, "int") == [0, 4, 5, 5]


def test_map_levels_and_box_key(spark):
    assert mapped(spark, [0.0799, 0.08, 0.3499, 0.35, 1.4999, 1.5], geo.map_level, "double") == [
        "places", "dong", "dong", "sigungu", "sigungu", "sido",
    ]
    df = spark.createDataFrame([(126.97649, 37.1, 127.0, 38.12351)], "a double, b double, c double, d double")
    assert tuples(df.select(geo.box_key(*[F.col(c) for c in "abcd"]).alias("k")), "k") == [("126.976,37.100,127.000,38.124",)]


def test_plain_digits_skip_the_look_at_the_whole_form(spark):
    """Digits and points alone are cast at once; all other forms give what they gave."""
    cases = {
        "126.50": 126.5, "1.": 1.0, ".5": 0.5, "007": 7.0, ".": None, "..": None, "1.2.3": None, "": None, None: None,
        "1.5d": None, "0x1p3": None, " 2 ": 2.0, "1_0.5": 10.5, "1__0": None, "-3e2": -300.0, "١": None,
    }
    rows = spark.createDataFrame([(case,) for case in cases], "v string")
    number = text.to_number(F.col("v"))
    found = {row["v"]: row["n"] for row in rows.select("v", number.alias("n")).collect()}
    assert found == cases
    plan = rows.select(number)._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN RLIKE" in plan
