"""Texts and classes shown for a place, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from occuspan.functions.periods import BASE_YEAR, label_of, long_display, short_display
from occuspan.functions.text import UNKNOWN_FLOOR, fixed_digits

# Symbol of each two-character category group.
CATEGORY_SYMBOLS = {
    "G2": "🛍️",
    "I1": "🛏️",
    "I2": "🍽️",
    "L1": "🏠",
    "M1": "🔬",
    "N1": "🏢",
    "P1": "📚",
    "Q1": "🏥",
    "R1": "🎨",
    "S2": "🔧",
}
OTHER_CATEGORY_SYMBOL = "🏪"
TOP_BUCKET = 5


def tenure_text(quarters: Column) -> Column:
    """Length of stay in years and months; NULL when unknown or not positive."""
    months = quarters * 3
    rest = F.pmod(months, F.lit(12))
    years = F.floor(months / 12)
    year_part = F.when(years > 0, F.concat(years.cast("string"), F.lit("년")))
    month_part = F.when(rest > 0, F.concat(rest.cast("string"), F.lit("개월")))
    return F.when(quarters > 0, F.concat_ws(" ", year_part, month_part))


def period_text(start_label: Column, end_label: Column, quarters: Column) -> Column:
    """``start ~ end (length)``, or ``start ~ 영업 중`` for an open stay."""
    opening = F.concat(short_display(start_label), F.lit(" ~ "))
    length = F.coalesce(F.concat(F.lit(" ("), tenure_text(quarters), F.lit(")")), F.lit(""))
    return F.when(end_label.isNull(), F.concat(opening, F.lit("영업 중"))).otherwise(
        F.concat(opening, short_display(end_label), length)
    )


def _whole(value: Column) -> Column:
    return F.floor(value + 0.5).cast("string")


def address_line(road_address: Column, floor: Column, avg_months: Column) -> Column:
    """Address, floor and rounded mean stay; the last part only when it is known."""
    storey = F.when(floor == UNKNOWN_FLOOR, F.lit("층 미상")).otherwise(F.concat(floor, F.lit("층")))
    mean = F.concat(F.lit("평균 "), _whole(avg_months), F.lit("개월"))
    return F.concat_ws(" · ", road_address, storey, mean)


def headline(
    is_occupied: Column,
    stores_current: Column,
    turnover: Column,
    avg_months: Column,
    first_label: Column,
    last_end_label: Column,
    base_year: int = BASE_YEAR,
) -> Column:
    """Struct of class, headline and second line; the first matching case wins."""
    count, changes = stores_current.cast("string"), turnover.cast("string")

    def case(name: str, title: Column, subtitle: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), title.alias("title"), subtitle.alias("subtitle"))

    vacant = case(
        "vacant",
        F.lit("지금은 비어 있는 것으로 보이는 자리"),
        F.concat(F.lit("마지막 영업 기록: "), short_display(last_end_label)),
    )
    shared = case(
        "shared",
        F.concat(F.lit("이 층 점포 "), count, F.lit("곳 · 교체 "), changes, F.lit("번")),
        F.lit("층 단위 정보라 점포별 구분은 정확하지 않을 수 있어요"),
    )
    changed = case(
        "changed",
        F.concat(F.lit("이 자리, 주인이 "), changes, F.lit("번 바뀌었습니다")),
        F.concat(F.lit("평균 "), _whole(avg_months), F.lit("개월마다 새 가게가 들어왔어요")),
    )
    since_first = case(
        "kept_since_first",
        F.lit("한 가게가 3년 넘게 지키고 있는 자리"),
        F.concat(long_display(F.lit(label_of(0, base_year))), F.lit("부터 계속 영업 중")),
    )
    since_later = case(
        "kept",
        F.lit("한 가게가 지키고 있는 자리"),
        F.concat(long_display(first_label), F.lit("부터 계속 영업 중")),
    )
    return (
        F.when(~is_occupied, vacant)
        .when(stores_current >= 2, shared)
        .when(turnover >= 1, changed)
        .when(first_label == label_of(0, base_year), since_first)
        .otherwise(since_later)
    )


def neighbourhood_class(turnover: Column, neighbourhood_avg: Column) -> Column:
    """``frequent``, ``similar`` or ``lasting`` against the mean; NULL without a positive mean."""
    ratio = turnover.cast("double") / neighbourhood_avg
    return F.when(
        neighbourhood_avg > 0,
        F.when(ratio >= 2, F.lit("frequent")).when(ratio > 0.5, F.lit("similar")).otherwise(F.lit("lasting")),
    )


def neighbourhood_text(turnover: Column, neighbourhood_avg: Column) -> Column:
    kind = neighbourhood_class(turnover, neighbourhood_avg)
    ending = (
        F.when(kind == "frequent", F.lit("보다 눈에 띄게 잦은 자리예요"))
        .when(kind == "similar", F.lit("과 비슷한 수준이에요"))
        .when(kind == "lasting", F.lit("보다 오래 버티는 자리예요"))
    )
    return F.concat(F.lit("이 동네 평균("), fixed_digits(neighbourhood_avg, 1), F.lit("번)"), ending)


def category_symbol(code: Column) -> Column:
    """Symbol of the category group a code starts with."""
    table = F.create_map(*[F.lit(part) for pair in CATEGORY_SYMBOLS.items() for part in pair])
    return F.coalesce(F.try_element_at(table, F.substring(code, 1, 2)), F.lit(OTHER_CATEGORY_SYMBOL))


def turnover_bucket(turnover: Column) -> Column:
    return F.least(turnover, F.lit(TOP_BUCKET))
