import math
import random

from helpers import tuples
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from occuspan.functions import geo
from occuspan.operators import viewport
from occuspan.operators.places import PLACE_COLUMNS
from occuspan.sinks import publish

PLACES = "place_key string, lng double, lat double, turnover_count int"
BOXES = "viewport_id int, min_lng double, min_lat double, max_lng double, max_lat double, min_turnover int, max_rows int"


def by_hand(places, boxes):
    out = []
    for vid, x0, y0, x1, y1, least, rows in boxes:
        inside = [p for p in places if x0 <= p[1] <= x1 and y0 <= p[2] <= y1 and p[3] >= least]
        best = sorted(inside, key=lambda p: (-p[3], p[0]))[: min(max(rows, 1), 1000)]
        out += [(vid, i + 1, p[0], p[3]) for i, p in enumerate(best)]
    return sorted(out, key=repr)


def run(spark, places, boxes):
    found = viewport.viewport_places_batch(spark.createDataFrame(places, PLACES), spark.createDataFrame(boxes, BOXES))
    return tuples(found, "viewport_id", "rank", "place_key", "turnover_count")


def test_batch_matches_brute_force_at_every_box_size(spark):
    rng = random.Random(4)
    places = [(f"p{i}", round(rng.uniform(-180, 180), 2), round(rng.uniform(-90, 90), 2), rng.randrange(6)) for i in range(300)]
    places += [(f"k{i}", 127 + rng.randrange(100) / 100, 37 + rng.randrange(100) / 100, rng.randrange(6)) for i in range(200)]
    boxes = []
    for i in range(60):
        _, x, y, _ = rng.choice(places)
        half = 10 ** rng.uniform(-3, 2.5)
        boxes.append((i, x, y - half, x + half, y + half / 3, rng.randrange(4), rng.choice([0, 1, 5, 5000])))
    boxes.append((100, -1e9, float("-inf"), float("inf"), 1e9, 0, 5000))
    assert run(spark, places, boxes) == by_hand(places, boxes)


def test_edges_are_inside_and_reversed_boxes_are_empty(spark):
    places = [("a", 127.0, 37.0, 1), ("b", 127.1, 37.1, 1), ("far", float("inf"), 37.0, 1)]
    boxes = [(1, 127.0, 37.0, 127.1, 37.1, 0, 10), (2, 127.1, 37.0, 127.0, 37.1, 0, 10), (3, 127.0, 37.0, 127.0, 37.0, 0, 10)]
    assert run(spark, places, boxes) == [(1, 1, "a", 1), (1, 2, "b", 1), (3, 1, "a", 1)]


def test_crowded_point_keeps_exactly_the_best(spark):
    places = [(f"p{i:04d}", 127.0, 37.0, i % 7) for i in range(2500)]
    boxes = [(1, 126.9, 36.9, 127.1, 37.1, 0, 5000), (2, 127.0, 37.0, 128.0, 38.0, 6, 1000)]
    found = run(spark, places, boxes)
    assert found == by_hand(places, boxes) and len(found) == 1000 + 357


def test_dense_edges_are_cut_finer_and_stay_exact(spark, monkeypatch):
    """Small lists: cells along the edges overflow and are cut down to single points."""
    monkeypatch.setattr(viewport, "MOST_ROWS", 20)
    rng = random.Random(6)
    places = [(f"p{i:05d}", 127 + rng.random() / 50, 37 + rng.random() / 50, rng.randrange(40)) for i in range(3000)]
    places += [(f"k{i:05d}", 127.01, 37.01, 90 + i % 3) for i in range(60)]  # the best ones share a point
    places += [(f"q{i:05d}", 127.01 + i * 1e-9, 37.012, 50) for i in range(60)]  # more than one list in a finest cell
    boxes = [(i, x, y, x + w, y + w, rng.choice([0, 30]), rng.choice([1, 7, 20])) for i in range(40) for x, y, w in [(127 + rng.random() / 60, 37 + rng.random() / 60, rng.choice([1e-5, 1e-3, 0.01]))]]
    boxes += [(90, 127.0, 37.0, 127.0099999, 37.02, 0, 20), (91, 127.01, 37.01, 127.02, 37.02, 0, 20), (92, 127.01 + 3e-9, 37.0, 127.01 + 50e-9, 37.02, 50, 20)]
    expected = [(v, r, p, t) for v, r, p, t in by_hand(places, boxes) if r <= 20]
    assert run(spark, places, boxes) == expected


def test_pairs_follow_what_is_wanted_not_the_number_of_places(spark):
    rng = random.Random(7)
    boxes = spark.createDataFrame([(i, 127 + x, 37 + y, 127 + x + w, 37 + y + w, 0, 10) for i in range(30) for x, y, w in [(rng.random() / 4, rng.random() / 4, 0.05 + rng.random() / 2)]], BOXES)
    wide = F.col("id")

    def pairs(n):
        hashed = [F.pmod(F.xxhash64(wide, F.lit(seed)), F.lit(10**6)) / 10**6 for seed in (1, 2, 3)]
        places = spark.range(n).select(wide.cast("string").alias("place_key"), (127 + hashed[0]).alias("lng"), (37 + hashed[1]).alias("lat"), (hashed[2] * 10**6).cast("int").alias("turnover_count"))
        assert viewport.viewport_places_batch(places, boxes).count() == 300
        return viewport.viewport_pairs(places, boxes).count()

    few, many = pairs(3_000), pairs(30_000)
    assert few <= 30 * 150 and many <= 1.5 * few


def test_single_box_and_limits(spark):
    places = [(f"p{i:04d}", 127.0, 37.0, i % 3) for i in range(1200)] + [("out", 128.0, 37.0, 9)]
    df = spark.createDataFrame(places, PLACES)
    box = (127.0, 37.0, 127.5, 37.5)
    assert viewport.viewport_places(df, box, max_rows=5000).count() == 1000
    assert viewport.viewport_places(df, box).count() == 500
    assert [r["place_key"] for r in viewport.viewport_places(df, box, max_rows=0).collect()] == ["p0002"]
    assert viewport.viewport_places(df, box, min_turnover=3).count() == 0
    plan = viewport.viewport_places(df, box)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def interleaved(x, y):
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(geo.KEY_BITS))


def test_curve_keys_interleave_cells_and_boxes_are_few_ranges(spark):
    rng = random.Random(8)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)]
    points += [(127 + rng.random() / 10, 37 + rng.random() / 10) for _ in range(200)] + [(float("inf"), -1e12), (-1000.0, 1000.0)]
    df = spark.createDataFrame([*points, (None, 1.0)], "lng double, lat double")
    keys = [r[0] for r in df.select(geo.curve_key(F.col("lng"), F.col("lat"))).collect()]
    offset = 1 << (geo.KEY_BITS - 1)
    cells = [[math.floor(max(min(v, 1000.0), -1000.0) / geo.FINEST_CELL) + offset for v in p] for p in points]
    assert keys == [*(interleaved(*c) for c in cells), None]
    for _ in range(300):
        (x, y), half = rng.choice(points[:-2]), 10 ** rng.uniform(-6, 2.5)
        box = (x - half * rng.random(), y - half, x + half, y + half * rng.random())
        ranges = geo.box_key_ranges(*box, cells=4)
        assert 1 <= len(ranges) <= 36 and ranges == sorted(ranges)
        for (px, py), key in zip(points, keys, strict=False):
            if box[0] <= px <= box[2] and box[1] <= py <= box[3]:
                assert any(a <= key <= b for a, b in ranges)
    assert geo.box_key_ranges(1.0, 1.0, 0.0, 2.0) == []


def test_a_box_skips_row_groups_of_published_files(spark, tmp_path):
    wide = F.col("id")
    hashed = [F.pmod(F.xxhash64(wide, F.lit(seed)), F.lit(10**6)) / 10**6 for seed in (1, 2)]
    places = spark.range(40_000).select(
        *[F.col("id").cast("string").alias(c) if c == "place_key" else (120 + 8 * hashed[0]).alias(c) if c == "lng" else (33 + 8 * hashed[1]).alias(c) if c == "lat"
          else (wide % 97).cast("int").alias(c) if c == "turnover_count" else F.lit(None).cast("string").alias(c) for c in PLACE_COLUMNS]
    )
    publish.stored_form("places", places).write.option("parquet.block.size", 64 * 1024).parquet(str(tmp_path / "map"))
    published = spark.read.parquet(str(tmp_path / "map"))
    box = (126.0, 37.0, 126.2, 37.3)
    found = viewport.viewport_places(published, box, max_rows=1000)
    assert found.columns == list(PLACE_COLUMNS)
    rows = found.collect()
    assert rows == viewport.viewport_places(places, box, max_rows=1000).collect() and 20 < len(rows) < 200
    read = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert 0 < read < 40_000 / 10


def test_regions_follow_the_map_level(spark):
    rows = [("dong", "d1", 127.0, 37.0), ("dong", "d2", 127.2, 37.0), ("sigungu", "g", 127.0, 37.0), ("sido", "s", 127.0, 37.0)]
    regions = spark.createDataFrame(rows, "region_level string, region_code string, center_lng double, center_lat double")
    one = viewport.viewport_regions(regions, "dong", (127.0, 37.0, 127.2, 37.1))
    assert tuples(one, "region_code") == [("d1",), ("d2",)]
    boxes = [
        (1, 127.0, 36.9, 127.05, 37.1, 0, 1), (2, 127.0, 36.9, 127.25, 37.1, 0, 1), (3, 126.9, 36.9, 127.4, 37.1, 0, 1),
        (4, 120.0, 30.0, 130.0, 40.0, 0, 1), (5, 127.05, 36.9, 127.3, 37.1, 0, 1),
    ]
    found = viewport.viewport_regions_batch(regions, spark.createDataFrame(boxes, BOXES))
    assert tuples(found, "viewport_id", "region_code") == [(2, "d1"), (2, "d2"), (3, "g"), (4, "s"), (5, "d2")]


def test_no_nested_loop_or_cartesian_join(spark):
    places = spark.createDataFrame([("a", 127.0, 37.0, 1)], PLACES)
    boxes = spark.createDataFrame([(1, 127.0, 37.0, 127.1, 37.1, 0, 10)], BOXES)
    plan = viewport.viewport_places_batch(places, boxes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("WindowGroupLimit") >= 2


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(-2000, 2000), st.floats(0, 3000)), min_size=1, max_size=40))
def test_boxes_cover_few_cells(spark, edges):
    df = spark.createDataFrame([(x, x + w) for x, w in edges], "a double, b double")
    level = geo.box_grid_level(F.col("a"), F.col("a"), F.col("b"), F.col("b"))
    cells = df.select((geo.cell(F.col("b"), level) - geo.cell(F.col("a"), level)).alias("n"))
    assert all(0 <= r["n"] <= geo.CELLS_PER_SIDE + 1 for r in cells.collect())
