"""Map requests: places and regions inside rectangles, one or many at a time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.functions import geo
from occuspan.operators.regions import LEVELS
from occuspan.session import shared_folder, stage

# Default and largest number of places per request.
DEFAULT_ROWS = 500
MOST_ROWS = 1000

EDGES = ("min_lng", "min_lat", "max_lng", "max_lat")
CELL = ("_grid", "_x", "_y")
# Column of published places with their place on the curve; a box is cut into so many cells a side.
CURVE = "cell_key"
RANGE_CELLS = 4
PAIR = ["viewport_id", *EDGES, "min_turnover", "wanted", "_inner", "place_key", "lng", "lat", "turnover_count"]
# A cover starts with at most FIRST_CELLS + 1 cells a side, cut in four COVER_DEPTH times.
FIRST_CELLS = 2
COVER_DEPTH = 2


def best_first() -> list[Column]:
    return [F.col("turnover_count").desc_nulls_last(), F.col("place_key").asc()]


def clamp_rows(max_rows: int) -> int:
    return min(max(max_rows, 1), MOST_ROWS)


def viewport_places(
    places: DataFrame,
    box: Sequence[float],
    min_turnover: int = 0,
    max_rows: int = DEFAULT_ROWS,
) -> DataFrame:
    """Places in one box, most changes first, at most ``max_rows`` of them.

    Published places know their place on a curve through the map. The box is then read
    as a few ranges of it, and files and row groups outside of them are not read.
    """
    min_lng, min_lat, max_lng, max_lat = box
    if CURVE in places.columns:
        ranges = [F.col(CURVE).between(*ends) for ends in geo.box_key_ranges(*box, cells=RANGE_CELLS)]
        places = places.filter(reduce(Column.__or__, ranges, F.lit(False))).drop(CURVE)
    return (
        places.filter(F.col("lng").between(min_lng, max_lng) & F.col("lat").between(min_lat, max_lat))
        .filter(F.col("turnover_count") >= min_turnover)
        .orderBy(*best_first())
        .limit(clamp_rows(max_rows))
    )


def viewport_regions(regions: DataFrame, level: str, box: Sequence[float]) -> DataFrame:
    """Regions of one level whose centre is in the box."""
    min_lng, min_lat, max_lng, max_lat = box
    return regions.filter(
        (F.col("region_level") == level)
        & F.col("center_lng").between(min_lng, max_lng)
        & F.col("center_lat").between(min_lat, max_lat)
    )


def _covering_cells(boxes: DataFrame) -> DataFrame:
    """One row per box and grid cell it touches, at the level fitting the box."""
    level = geo.box_grid_level(*[F.col(edge) for edge in EDGES])
    return _first_cells(boxes.withColumn("_grid", level))


def _first_cells(boxes: DataFrame) -> DataFrame:
    """The cells of level ``_grid`` that a box touches."""
    x, y = ([geo.cell(F.col(edge), F.col("_grid")) for edge in pair] for pair in (EDGES[::2], EDGES[1::2]))
    return boxes.withColumn("_x", F.explode(F.sequence(*x))).withColumn("_y", F.explode(F.sequence(*y)))


def _is_inner() -> Column:
    """Does a cell lie between the cells of the box's edges?

    Cell numbers never fall as a coordinate rises, so such a cell lies in the box.
    """
    west, south, east, north = (geo.cell(F.col(edge), F.col("_grid")) for edge in EDGES)
    return (F.col("_x") > west) & (F.col("_x") < east) & (F.col("_y") > south) & (F.col("_y") < north)


def _quarters(cells: DataFrame) -> DataFrame:
    """The four cells below each cell, as far as its box touches them."""
    half = F.array(F.lit(0), F.lit(1))
    west, south, east, north = (geo.cell(F.col(edge), F.col("_grid")) for edge in EDGES)
    below = cells.withColumns({"_grid": F.col("_grid") - 1, "_dx": F.explode(half)}).withColumn("_dy", F.explode(half))
    moved = below.withColumns({"_x": F.col("_x") * 2 + F.col("_dx"), "_y": F.col("_y") * 2 + F.col("_dy")}).drop("_dx", "_dy")
    return moved.filter(F.col("_x").between(west, east) & F.col("_y").between(south, north))


def box_cover(boxes: DataFrame) -> DataFrame:
    """Cells of several sizes that cover each box: large ones inside, small ones along its edges.

    Cells not inside are cut in four, ``COVER_DEPTH`` times; ``_inner`` marks those that
    lie in the box as a whole. A box has about a hundred cells, whatever its size.
    """
    cells = _first_cells(boxes.withColumn("_grid", geo.box_grid_level(*[F.col(edge) for edge in EDGES], cells=FIRST_CELLS)))
    done = None
    for _ in range(COVER_DEPTH):
        cells = cells.withColumn("_inner", _is_inner())
        stop = F.col("_inner") | (F.col("_grid") == 0)
        done = cells.filter(stop) if done is None else done.unionByName(cells.filter(stop))
        cells = _quarters(cells.filter(~stop).drop("_inner"))
    return done.unionByName(cells.withColumn("_inner", _is_inner()))


def _at_levels(points: DataFrame, cells: DataFrame, lng: str, lat: str) -> DataFrame:
    """Every point once per grid level of the cells."""
    used = cells.select("_grid").distinct()
    levels = F.array(*[F.lit(level) for level in range(geo.GRID_LEVELS)])
    return (
        points.withColumn("_grid", F.explode(levels))
        .join(F.broadcast(used), "_grid", "left_semi")  # at most geo.GRID_LEVELS rows
        .withColumn("_x", geo.cell(F.col(lng), F.col("_grid")))
        .withColumn("_y", geo.cell(F.col(lat), F.col("_grid")))
    )


def box_join(points: DataFrame, boxes: DataFrame, lng: str, lat: str, also: Sequence[str] = ()) -> DataFrame:
    """Every (point, box) pair with the point in the box, as an equi-join.

    Each box takes the grid level at which it covers a handful of cells, and
    each point takes its cell at every level that some box uses. The exact
    test follows the join. ``also`` names further columns both sides share.
    The side to broadcast, if any, is left to Spark's own size check; beyond
    it the adaptive skew join splits crowded cells.
    """
    inside = geo.contains(F.col(lng), F.col(lat), *[F.col(edge) for edge in EDGES])
    cells = _covering_cells(boxes)
    return _at_levels(points, cells, lng, lat).join(cells, [*also, *CELL]).filter(inside).drop(*CELL)


def valid_boxes(viewports: DataFrame) -> DataFrame:
    """Boxes that can contain anything: no reversed or missing edge."""
    return viewports.filter((F.col("min_lng") <= F.col("max_lng")) & (F.col("min_lat") <= F.col("max_lat")))


def _order_value() -> Column:
    """Ascending in the order of results: most changes first, then by key."""
    changes = F.col("turnover_count").cast("long")
    return F.struct(changes.isNull().alias("none"), (-changes).alias("minus"), F.col("place_key").alias("key"))


def _cell_lists(placed: DataFrame) -> DataFrame:
    """The best places of each cell, one more than any request may want, in blocks of doubling length."""
    in_cell = Window.partitionBy(*CELL).orderBy(*best_first())
    best = placed.withColumn("_rank", F.row_number().over(in_cell)).filter(F.col("_rank") <= MOST_ROWS + 1)
    return best.withColumn("_block", F.floor(F.log2("_rank")).cast("int"))


def _block_table(lists: DataFrame) -> DataFrame:
    """Size, first and last of each block, and whether its cell's list was cut off."""
    value = _order_value()
    return lists.groupBy(*CELL, "_block").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(value).alias("_best"),
        F.max(value).alias("_worst"),
        (F.max("_rank") > MOST_ROWS).alias("_cut"),
    )


def _offers(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that a box's cells have for it, as far as their best place changes often enough."""
    often = ~F.col("_best.none") & (-F.col("_best.minus") >= F.col("min_turnover"))
    return cells.join(blocks, list(CELL)).filter(often)


def _enough(offers: DataFrame) -> DataFrame:
    """Per box, a place such that its inner cells hold as many as wanted that are no worse.

    Blocks that lie in the box as a whole are added up by their last place, best first.
    """
    whole = offers.filter("_inner").filter(~F.col("_worst.none") & (-F.col("_worst.minus") >= F.col("min_turnover")))
    so_far = F.sum("_n").over(Window.partitionBy("viewport_id").orderBy("_worst"))
    reached = whole.select("viewport_id", "_worst", "wanted", so_far.alias("_so_far")).filter(F.col("_so_far") >= F.col("wanted"))
    return reached.groupBy("viewport_id").agg(F.min("_worst").alias("_enough"))


def viewport_pairs(places: DataFrame, viewports: DataFrame, folder: str | None = None) -> DataFrame:
    """The (box, place) pairs that ``viewport_places_batch`` tests and ranks.

    Cells carry ranked lists of their best places, cut into blocks of doubling length. From
    the blocks' ends alone follows a place that is good enough for each box, and only
    blocks that start no worse are joined. Lists hold one place more than a request may
    want: a cell along an edge whose whole list is good enough is cut in four, again and
    again, and a cell of the finest level is then joined as a whole. The pairs of a
    box therefore follow what it wants, not the number of places in it.
    """
    folder = folder or shared_folder(places.sparkSession)
    at_point = Window.partitionBy("lng", "lat").orderBy(*best_first())
    # A box holds all places of one point or none, so only the best of a point take part.
    candidates = places.select("place_key", "lng", "lat", "turnover_count").withColumn("_at_point", F.row_number().over(at_point))
    candidates = stage(candidates.filter(F.col("_at_point") <= MOST_ROWS).drop("_at_point"), folder, "candidates")
    wanted = F.least(F.greatest("max_rows", F.lit(1)), F.lit(MOST_ROWS))
    boxes = valid_boxes(viewports).select("viewport_id", *EDGES, "min_turnover", wanted.alias("wanted"))
    cells = stage(box_cover(boxes), folder, "cover")
    lists = stage(_cell_lists(_at_levels(candidates, cells, "lng", "lat")), folder, "lists")
    offers = _offers(cells, _block_table(lists))
    enough = stage(_enough(offers), folder, "enough")
    found, turn = None, 0
    while True:
        known = offers.join(enough, "viewport_id", "left")
        needed = stage(known.filter(F.col("_enough").isNull() | (F.col("_best") <= F.col("_enough"))), folder, f"needed{turn}")
        crowded = needed.filter(~F.col("_inner") & F.col("_cut")).select(*cells.columns).drop("_inner")
        crowded = stage(crowded, folder, f"crowded{turn}")
        kept = needed.join(crowded.select("viewport_id", *CELL), ["viewport_id", *CELL], "left_anti")
        pairs = kept.select("viewport_id", *EDGES, "min_turnover", "wanted", *CELL, "_block", "_inner").join(lists, [*CELL, "_block"])
        found = pairs.select(PAIR) if found is None else found.unionByName(pairs.select(PAIR))
        if crowded.isEmpty():
            return found
        finest = crowded.filter("_grid = 0").withColumn("_inner", F.lit(False))
        on_finest = candidates.withColumns({"_grid": F.lit(0), "_x": geo.cell(F.col("lng"), F.lit(0)), "_y": geo.cell(F.col("lat"), F.lit(0))})
        found = found.unionByName(finest.join(on_finest, list(CELL)).select(PAIR))
        turn += 1
        quarters = _quarters(crowded.filter("_grid > 0"))
        cells = stage(quarters.withColumn("_inner", _is_inner()).select(cells.columns), folder, f"cover{turn}")
        wanted_cells = cells.select(*CELL).distinct()
        below = _at_levels(candidates, cells, "lng", "lat").join(wanted_cells, list(CELL), "left_semi")
        lists = stage(_cell_lists(below), folder, f"lists{turn}")
        offers = _offers(cells, _block_table(lists))


def viewport_places_batch(places: DataFrame, viewports: DataFrame, folder: str | None = None) -> DataFrame:
    """``viewport_places`` for a table of requests.

    ``viewports`` holds viewport_id, the four edges, min_turnover and max_rows. Places are
    tested one by one only in the cells along the edges.
    """
    inside = geo.contains(F.col("lng"), F.col("lat"), *[F.col(edge) for edge in EDGES])
    per_view = Window.partitionBy("viewport_id").orderBy(*best_first())
    return (
        viewport_pairs(places, viewports, folder)
        .filter(F.col("_inner") | inside)
        .filter(F.col("turnover_count") >= F.col("min_turnover"))
        .withColumn("rank", F.row_number().over(per_view))
        .filter(F.col("rank") <= MOST_ROWS)
        .filter(F.col("rank") <= F.col("wanted"))
        .select("viewport_id", "rank", "place_key", "turnover_count")
    )


def viewport_regions_batch(regions: DataFrame, viewports: DataFrame) -> DataFrame:
    """Region markers for a table of requests, at the level fitting each width.

    Requests narrow enough to show single places get no markers.
    """
    level = geo.map_level(F.col("max_lng") - F.col("min_lng"))
    requests = (
        valid_boxes(viewports)
        .select("viewport_id", *EDGES, level.alias("region_level"))
        .filter(F.col("region_level").isin(*LEVELS))
    )
    return box_join(regions, requests, "center_lng", "center_lat", ["region_level"]).drop(*EDGES)


def viewport_requests(viewports: DataFrame) -> DataFrame:
    """Map level and request key per viewport."""
    edges = [F.col(edge) for edge in EDGES]
    return viewports.select(
        "viewport_id",
        geo.map_level(F.col("max_lng") - F.col("min_lng")).alias("map_level"),
        geo.box_key(*edges).alias("box_key"),
    )
