"""What one part, supplier or text fixes is worked out once, not again for every line of an order."""

from datetime import date

import pytest
from helpers import raw
from pyspark.sql import functions as F

from occuspan.functions import text
from occuspan.operators import normalize
from occuspan.plans import inputs, queries
from occuspan.plans.inputs import raw_snapshots


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("region", [(1, "ASIA")], "r_regionkey int, r_name string")
    write("nation", [(8, 1, "INDIA")], "n_nationkey int, n_regionkey int, n_name string")
    write("supplier", [(12345, 8), (None, 8)], "s_suppkey long, s_nationkey int")
    parts = [(1, "Brand#12", "SMALL", 9), (2, "Brand", "LARGE", 3), (3, None, "LARGE", None), (None, "Brand#7", "LARGE", 1)]
    write("part", parts, "p_partkey long, p_brand string, p_type string, p_size int")
    lines = [(5, 1, 12345, 1, date(1996, 5, 1)), (6, 1, 12345, 7, date(1996, 5, 1)), (7, 3, 12345, 1, date(1996, 5, 1)), (8, 1, None, 1, None)]
    write("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate date")
    return str(tmp_path)


def test_lines_get_the_texts_of_their_part_and_supplier(spark, tables):
    """A brand without a number is no error as long as no line has it."""
    rows = {r[normalize.NAME]: r for r in raw_snapshots(spark, tables).collect()}
    assert set(rows) == {"(주) Brand#12", "BRAND#12"}
    found = rows["(주) Brand#12"].asDict()
    assert found == {
        normalize.PERIOD: 5, normalize.STORE_ID: "MA2345199601121", normalize.NAME: "(주) Brand#12", normalize.BRANCH: "No.1",
        normalize.CATEGORY_TOP: "I1", normalize.CATEGORY_CODE: "I1002", normalize.CATEGORY_NAME: "SMALL",
        normalize.SIDO_CODE: "1", normalize.SIDO_NAME: "ASIA", normalize.SIGUNGU_CODE: "8", normalize.SIGUNGU_NAME: "INDIA",
        normalize.DONG_CODE: "8-0", normalize.DONG_NAME: "DONG_8-0", normalize.ROAD_ADDRESS: "Road 12345",
        normalize.LOT_ADDRESS: "Lot 12345", normalize.BUILDING: "B12345", normalize.FLOOR: " 1 ", normalize.UNIT: None,
        normalize.LNG: "126.95", normalize.LAT: "37.65",
    }
    assert rows["BRAND#12"][normalize.FLOOR] == ""


def test_a_brand_is_read_once_a_part(spark, tables):
    above_joins = optimized(raw_snapshots(spark, tables)).split("Join")[0]
    assert "upper(" not in above_joins and "regexp_extract" not in above_joins


def test_a_floor_is_cleaned_once_a_row(spark):
    above = optimized(normalize.standard_rows(raw(spark, [{}]))).split("Generate")[0]
    assert "trim(" not in above


def test_names_without_a_suffix_sign_skip_its_pattern_and_stay_as_they_were(spark):
    names = ["(주) Brand#1", "주", "(유)한", "㈜A-b", "주식회사 가", "유한회사나", "A(주(주))", "BRAND.2", "", None, "(  주)", "한식회사", "İ(주)"]
    df = spark.createDataFrame([(n, b) for n in names for b in (None, "No.1", "(주)", "유한회사")], "n string, b string")
    joined = F.lower(F.concat(F.coalesce("n", F.lit("")), F.coalesce("b", F.lit(""))))
    always = F.regexp_replace(F.regexp_replace(joined, text.COMPANY_SUFFIXES, ""), text.NAME_NOISE, "")
    found = text.normalized_name(F.col("n"), F.col("b"))
    assert df.filter(~found.eqNullSafe(always)).isEmpty()
    assert "contains(" in optimized(df.select(found)).lower()


def test_rows_that_only_spans_read_are_not_written(spark, tables, monkeypatch):
    staged = []
    monkeypatch.setattr(inputs, "stage", lambda df, folder, name: staged.append(name) or df)
    kinds = {name: queries.registered()[name](spark, tables) for name in ("place_history", "turnover_histogram")}
    assert "spans" in staged and "stores" not in staged
    assert kinds["place_history"].count() == 1 and kinds["turnover_histogram"].collect() == [(0, 1, True)]
    staged.clear()
    queries.registered()["region_stats"](spark, tables)  # names of regions read the rows as well
    assert staged.count("stores") == 1
