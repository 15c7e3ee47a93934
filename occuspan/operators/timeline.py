"""Snapshots to intervals: spans per shop, occupants per place, turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how many missing periods an interval may bridge.
MAX_GAP = 1

RUNNING = (Window.unboundedPreceding, Window.currentRow)


def spans(stores: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Unbroken stays of a shop at a place, read off in one sorted pass.

    The last row of a stay is the stay: its period is the end, the latest
    opening row before it is the start, and its attributes are the latest ones.
    So no aggregation follows the windows. Besides the interval each row
    carries what a place profile needs: where the shop was last seen before
    the end, and the latest known region codes with their periods.
    """
    walk = Window.partitionBy("store_id", "place_key").orderBy("qord")
    so_far = walk.rowsBetween(*RUNNING)
    q = F.col("qord")

    def known(code: str) -> Column:
        seen = F.when(F.col(code).isNotNull(), F.struct(q.alias("q"), F.col(code).alias("code")))
        return F.last(seen, ignorenulls=True).over(so_far).alias(f"{code}_seen")

    stepped = stores.select(
        "*",
        F.lag("qord").over(walk).alias("seen_before"),
        F.lead("qord").over(walk).alias("seen_after"),
        known("sido_code"),
        known("sigungu_code"),
        known("dong_code"),
    )
    far = max_gap + 1
    reset = F.col("seen_before").isNull() | (q - F.col("seen_before") > far)
    last = F.col("seen_after").isNull() | (F.col("seen_after") - q > far)
    marked = stepped.select(
        "*",
        last.alias("is_last"),
        F.max(F.when(reset, q)).over(so_far).alias("start_q"),
        (F.count(F.when(reset, q)).over(so_far) - 1).cast("int").alias("island"),
    )
    return marked.filter("is_last").select(
        "store_id", "place_key", "island", "start_q", q.alias("end_q"), "name_norm", "cat_code", "cat_name",
        "seen_before", "building_id", "floor_label", "road_address", "lat", "lng",
        "sido_code_seen", "sigungu_code_seen", "dong_code_seen",
    )


def logical_stores(spans: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Stays at one place under one name, joined across re-issued shop ids.

    A stay continues the previous one, in order of start and end, when it
    starts at most ``max_gap`` missing periods after the previous one's end.
    Nameless stays are never joined; they get a private key instead.

    Equal intervals never break each other, so they are counted before the
    shuffle to the place and name. A group then has at most one row per
    interval and category, however many shops share the name.
    """
    nameless = F.col("name_norm") == ""
    packed = (
        spans.select(
            "place_key",
            "name_norm",
            F.when(nameless, F.col("store_id")).alias("own_store"),
            F.when(nameless, F.col("island")).alias("own_island"),
            "start_q",
            "end_q",
            "cat_code",
            "cat_name",
        )
        .groupBy("place_key", "name_norm", "own_store", "own_island", "start_q", "end_q", "cat_code", "cat_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    group = ["place_key", "name_norm", "own_store", "own_island"]
    walk = Window.partitionBy(*group).orderBy("start_q", "end_q", "cat_code", "cat_name")
    so_far = walk.rowsBetween(*RUNNING)
    previous_end = F.lag("end_q").over(walk)
    broken = previous_end.isNull() | (F.col("start_q") - previous_end > max_gap + 1)
    flagged = packed.withColumn("broken", broken)
    # Group numbers, starts and running counts never fall along the walk, so
    # running maxima give the values of the current group.
    numbered = flagged.select(
        "*",
        F.coalesce(F.lead("broken").over(walk), F.lit(True)).alias("is_last"),
        F.count_if("broken").over(so_far).alias("g"),
        F.max(F.when(F.col("broken"), F.col("start_q"))).over(so_far).alias("group_start"),
        F.sum("n").over(so_far).alias("n_so_far"),
    )
    latest = F.struct("g", "end_q", "start_q", "cat_code", "cat_name")
    collapsed = numbered.select(
        "*",
        F.max(latest).over(so_far).alias("latest"),
        F.max(F.when(F.col("broken"), F.col("n_so_far") - F.col("n"))).over(so_far).alias("n_before"),
    )
    return collapsed.filter("is_last").select(
        "place_key",
        "name_norm",
        F.col("group_start").alias("start_q"),
        F.col("latest.end_q").alias("end_q"),
        F.col("latest.cat_code").alias("cat_code"),
        F.col("latest.cat_name").alias("cat_name"),
        (F.col("n_so_far") - F.col("n_before")).alias("merged_spans"),
        "own_store",
        "own_island",
    )


def boundary_counts(logical: DataFrame, latest: int) -> DataFrame:
    """Occupants that ended at a period and that started right after it.

    Stays that reach the latest period are still open, and starts at ordinal 0
    are not observed starts; neither counts.
    """
    ended = F.struct(F.col("end_q").alias("boundary_q"), F.lit(1).alias("ended"), F.lit(0).alias("started"))
    started = F.struct((F.col("start_q") - 1).alias("boundary_q"), F.lit(0).alias("ended"), F.lit(1).alias("started"))
    events = F.array(F.when(F.col("end_q") < latest, ended), F.when(F.col("start_q") > 0, started))
    return (
        logical.select("place_key", F.inline(F.array_compact(events)))
        .groupBy("place_key", "boundary_q")
        .agg(F.sum("ended").alias("n_ended"), F.sum("started").alias("n_started"))
    )


def place_turnover(logical: DataFrame, latest: int) -> DataFrame:
    """Occupant changes per place: per boundary the smaller of ended and started.

    Only places with at least one matched boundary appear.
    """
    return (
        boundary_counts(logical, latest)
        .filter("n_ended > 0 and n_started > 0")
        .groupBy("place_key")
        .agg(F.sum(F.least("n_ended", "n_started")).cast("int").alias("turnover_count"))
    )


def merge_counts(logical: DataFrame) -> DataFrame:
    """Number of spans, of occupants after merging, and of merged-away spans."""
    totals = logical.agg(F.sum("merged_spans").alias("spans"), F.count(F.lit(1)).alias("logical_stores"))
    return totals.select(
        F.coalesce("spans", F.lit(0)).alias("spans"),
        "logical_stores",
        (F.coalesce("spans", F.lit(0)) - F.col("logical_stores")).alias("merged_away"),
    )
