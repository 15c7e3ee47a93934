"""Scalar cleaning rules shared by the snapshot jobs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Company suffixes dropped first, then punctuation and blanks;
# placeholders for a missing floor, category and shop name.
COMPANY_SUFFIXES = r"\(주\)|\(유\)|㈜|주식회사|유한회사"
# Every suffix has one of these characters; finding them is much cheaper than trying the pattern everywhere.
SUFFIX_SIGNS = ("주", "유", "㈜")
NAME_NOISE = r"""[\t\n\f\r ()（）\-_.,'"㈜·&]+"""
UNKNOWN_FLOOR = "미상"
UNKNOWN_CATEGORY_CODE = "?"
UNKNOWN_CATEGORY_NAME = "미분류"
UNKNOWN_NAME = "(상호없음)"

# Unicode space separators, which trimming removes; tabs and line ends stay.
SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# A plain number: optional blanks around it, single underscores between digits.
_DIGITS = r"\d+(?:_\d+)*"
NUMBER = (
    rf"^[\t-\r ]*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    rf"|(?i:nan|inf|infinity))[\t-\r ]*\z"
)
PLAIN_DIGITS = r"\A[0-9.]++\z"


def strip_spaces(text: Column) -> Column:
    """Trim every Unicode space separator, but keep tabs and line ends."""
    return F.btrim(text, F.lit(SPACES))


def filled(text: Column) -> Column:
    """The text, or NULL when it is empty."""
    return F.nullif(text, F.lit(""))


def normalized_name(name: Column, branch: Column) -> Column:
    """Comparison form of a shop name: lower case, no company suffix, no punctuation."""
    joined = F.lower(F.concat(F.coalesce(name, F.lit("")), F.coalesce(branch, F.lit(""))))
    signed = reduce(or_, (joined.contains(sign) for sign in SUFFIX_SIGNS))
    bare = F.when(signed, F.regexp_replace(joined, COMPANY_SUFFIXES, "")).otherwise(joined)
    return F.regexp_replace(bare, NAME_NOISE, "")


def display_name(name: Column, branch: Column) -> Column:
    """Readable shop name with its branch."""
    shown = F.coalesce(filled(name), F.lit(UNKNOWN_NAME))
    return F.concat(shown, F.coalesce(F.concat(F.lit(" "), filled(branch)), F.lit("")))


def floor_label(floor: Column) -> Column:
    return F.coalesce(filled(strip_spaces(floor)), F.lit(UNKNOWN_FLOOR))


def place_key(building: Column, floor: Column) -> Column:
    """Building id and cleaned floor; NULL when the building is NULL."""
    return labelled_key(building, floor_label(floor))


def labelled_key(building: Column, label: Column) -> Column:
    """The place key of a floor that is cleaned already."""
    return F.concat(building, F.lit("#"), label)


def address(road: Column, lot: Column) -> Column:
    return F.coalesce(filled(road), filled(lot), F.lit(""))


def to_number(text: Column) -> Column:
    """Text to double; NULL for anything that is not a plain number.

    Surrounding ASCII blanks and single underscores between digits are allowed,
    suffixes such as ``127.1d`` and hexadecimal forms are not. Digits and points alone
    need no look at the whole form: the cast takes them or gives NULL for the same texts.
    """
    number = F.translate(F.regexp_extract(text, NUMBER, 0), "_", "")
    return F.when(text.rlike(PLAIN_DIGITS), text).otherwise(number).try_cast("double")


def is_blank(text: Column) -> Column:
    """True for NULL and for text made of spaces only."""
    return F.coalesce(strip_spaces(text), F.lit("")) == ""


def round_half_up(value: Column, digits: int) -> Column:
    """Round a non-negative double half up, without a detour over decimals."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def fixed_digits(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded on the exact binary value."""
    return F.translate(F.format_number(value, digits), ",", "")
