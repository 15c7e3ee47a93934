"""Quarter labels (``2023Q1``) and the discrete ordinal axis they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first year of the axis and the label format.
BASE_YEAR = 2023
LABEL_PATTERN = r"^\d{4}Q[1-4]\z"


def label_of(ordinal: int, base_year: int = BASE_YEAR) -> str:
    """Driver-side label of one ordinal."""
    years, quarter = divmod(ordinal, 4)
    return f"{base_year + years}Q{quarter + 1}"


def ordinal_of(label: str, base_year: int = BASE_YEAR) -> int:
    """Driver-side ordinal of one label; a malformed label is an error."""
    year, sep, quarter = label.partition("Q")
    if not (sep and len(year) == 4 and year.isdecimal() and quarter in ("1", "2", "3", "4")):
        raise ValueError(f"not a quarter label: {label!r}")
    return 4 * (int(year) - base_year) + int(quarter) - 1


def to_ordinal(label: Column, base_year: int = BASE_YEAR) -> Column:
    """Label column to ordinal; malformed labels become NULL."""
    year = F.substring(label, 1, 4).try_cast("int")
    quarter = F.substring(label, 6, 1).try_cast("int")
    return F.when(label.rlike(LABEL_PATTERN), (year - base_year) * 4 + quarter - 1)


def to_label(ordinal: Column, latest: int | None = None, base_year: int = BASE_YEAR) -> Column:
    """Ordinal column to label; ordinals outside ``0..latest`` have no label."""
    text = F.concat(
        (F.floor(ordinal / 4) + base_year).cast("string"),
        F.lit("Q"),
        (F.pmod(ordinal, F.lit(4)) + 1).cast("string"),
    )
    if latest is None:
        return text
    return F.when(ordinal.between(0, latest), text)


def month_to_label(year: Column, month: Column) -> Column:
    """Quarter label of a year and a month number."""
    quarter = F.floor((month - 1) / 3) + 1
    return F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string"))


def last_month(ordinal: Column, base_year: int = BASE_YEAR) -> Column:
    """``YYYYMM`` text of the closing month of a quarter."""
    year = (F.floor(ordinal / 4) + base_year).cast("string")
    month = ((F.pmod(ordinal, F.lit(4)) + 1) * 3).cast("string")
    return F.concat(year, F.lpad(month, 2, "0"))


def _display(label: Column, middle: str, tail: str) -> Column:
    parts = F.filter(F.split(label, "Q"), lambda part: part != "")
    text = F.concat(F.element_at(parts, 1), F.lit(middle), F.try_element_at(parts, F.lit(2)), F.lit(tail))
    return F.when(F.size(parts) == 2, text).otherwise(label)


def short_display(label: Column) -> Column:
    """``2023Q1`` to ``2023.1분기``; anything else is left as it is."""
    return _display(label, ".", "분기")


def long_display(label: Column) -> Column:
    """``2023Q1`` to ``2023년 1분기``; anything else is left as it is."""
    return _display(label, "년 ", "분기")
