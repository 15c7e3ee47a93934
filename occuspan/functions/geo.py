"""Points, viewports and the grid that turns box containment into an equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from occuspan.functions.text import fixed_digits

# Visible width in degrees below which a map level applies.
PLACES_WIDTH = 0.08
DONG_WIDTH = 0.35
SIGUNGU_WIDTH = 1.5

# Grid: level n has cells of FINEST_CELL * 2**n degrees, the finest about a metre wide;
# coordinates are clipped far outside the valid range so that infinities still get a cell.
FINEST_CELL = 0.01 / 2**10
GRID_LEVELS = 27
CLIP = 1000.0
CELLS_PER_SIDE = 8
# Bits of one coordinate in a curve key: 2**KEY_BITS finest cells span the clipped range.
KEY_BITS = 28


def point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.alias("lng"), lat.alias("lat"))


def map_level(width: Column) -> Column:
    return (
        F.when(width < PLACES_WIDTH, F.lit("places"))
        .when(width < DONG_WIDTH, F.lit("dong"))
        .when(width < SIGUNGU_WIDTH, F.lit("sigungu"))
        .otherwise(F.lit("sido"))
    )


def box_key(min_lng: Column, min_lat: Column, max_lng: Column, max_lat: Column) -> Column:
    """Request key of a viewport: its edges to three decimals."""
    return F.concat_ws(",", *[fixed_digits(edge, 3) for edge in (min_lng, min_lat, max_lng, max_lat)])


def contains(lng: Column, lat: Column, min_lng: Column, min_lat: Column, max_lng: Column, max_lat: Column) -> Column:
    """Exact test, edges included."""
    return (lng >= min_lng) & (lng <= max_lng) & (lat >= min_lat) & (lat <= max_lat)


def _clipped(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(CLIP)), F.lit(-CLIP))


def cell(value: Column, level: Column) -> Column:
    """Cell index of a coordinate; monotone in the coordinate at every level."""
    return F.floor(_clipped(value) / (F.pow(F.lit(2.0), level) * FINEST_CELL)).cast("int")


def box_grid_level(min_lng: Column, min_lat: Column, max_lng: Column, max_lat: Column, cells: int = CELLS_PER_SIDE) -> Column:
    """Level at which the box is about ``cells`` cells wide or narrower."""
    finest = F.lit(cells * FINEST_CELL)
    extent = F.greatest(_clipped(max_lng) - _clipped(min_lng), _clipped(max_lat) - _clipped(min_lat), finest)
    return F.least(F.ceil(F.log2(extent / finest)).cast("int"), F.lit(GRID_LEVELS - 1))


def _spread_bits(value: Column) -> Column:
    """The bits of a number of up to KEY_BITS bits, one place apart."""
    value = value.cast("long")
    for shift in (16, 8, 4, 2, 1):
        # Groups of `shift` bits stay, gaps of as many bits are opened between them.
        mask = sum(((1 << shift) - 1) << at for at in range(0, 63, 2 * shift)) & ((1 << 63) - 1)
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def curve_key(lng: Column, lat: Column) -> Column:
    """Place of a point's finest cell on a Z-shaped curve; NULL without a coordinate.

    The key of the cell of level n around it is the key shifted right by 2 * n bits, and
    the keys of all points in a cell are one range.
    """
    x, y = (cell(v, F.lit(0)) + F.lit(1 << (KEY_BITS - 1)) for v in (lng, lat))
    return F.when(lng.isNotNull() & lat.isNotNull(), _spread_bits(x).bitwiseOR(F.shiftleft(_spread_bits(y), 1)))


def box_key_ranges(min_lng: float, min_lat: float, max_lng: float, max_lat: float, cells: int = CELLS_PER_SIDE) -> list[tuple[int, int]]:
    """The few ranges of curve keys that hold every point of one box, both ends included."""
    edges = [max(min(v, CLIP), -CLIP) for v in (min_lng, min_lat, max_lng, max_lat)]
    if not (edges[0] <= edges[2] and edges[1] <= edges[3]):
        return []
    x0, y0, x1, y1 = (math.floor(v / FINEST_CELL) + (1 << (KEY_BITS - 1)) for v in edges)
    level = max(0, (max(x1 - x0, y1 - y0) // cells).bit_length())
    found: list[tuple[int, int]] = []
    for first in sorted(_interleaved(x, y) for x in range(x0 >> level, (x1 >> level) + 1) for y in range(y0 >> level, (y1 >> level) + 1)):
        low, high = first << 2 * level, ((first + 1) << 2 * level) - 1
        if found and found[-1][1] + 1 == low:
            found[-1] = found[-1][0], high
        else:
            found.append((low, high))
    return found


def _interleaved(x: int, y: int) -> int:
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(KEY_BITS))
