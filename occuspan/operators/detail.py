"""Place documents and the texts of the detail view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occuspan.functions import labels
from occuspan.functions.periods import BASE_YEAR, to_label, to_ordinal
from occuspan.operators.places import HISTORY_COLUMNS, PLACE_COLUMNS
from occuspan.operators.regions import REGION_COLUMNS

PAGE_ENTRIES = 1000


def detail_header(places: DataFrame, regions: DataFrame) -> DataFrame:
    """Every place as one struct, with the statistics of its neighbourhood: place_key, place, dong.

    Regions meet the places before any chronology does, so only this slim side moves.
    """
    dong = regions.filter(F.col("region_level") == "dong").select(
        F.col("region_code").alias("dong_code"), F.struct(*REGION_COLUMNS).alias("dong")
    )
    return places.select("place_key", "dong_code", F.struct(*PLACE_COLUMNS).alias("place")).join(dong, "dong_code", "left").drop("dong_code")


def history_pages(history: DataFrame, newest_first: bool = False, page_entries: int = PAGE_ENTRIES) -> DataFrame:
    """Chronologies packed into pages of limited length: place_key, page, history.

    Pages are grouped by place and page, so a crowded place is packed by many tasks.
    """
    entry = F.struct("seq", *[c for c in HISTORY_COLUMNS if c != "seq"])
    listed = F.array_sort(F.collect_list(entry))
    if newest_first:
        lengths = history.groupBy("place_key").agg(F.count(F.lit(1)).alias("entries"))
        history = history.join(lengths, "place_key").withColumn("ahead", F.col("entries") - F.col("seq"))
    else:
        history = history.withColumn("ahead", F.col("seq") - 1)
    return history.groupBy("place_key", F.floor(F.col("ahead") / page_entries).cast("int").alias("page")).agg(
        (F.reverse(listed) if newest_first else listed).alias("history")
    )


def documents(header: DataFrame, pages: DataFrame) -> DataFrame:
    """Headers and pages of the same places as documents; both may be stored in buckets of place_key."""
    empty = F.array().cast(pages.schema["history"].dataType)
    return header.join(pages, "place_key", "left").select(
        "place_key", F.coalesce("page", F.lit(0)).alias("page"), "place", F.coalesce("history", empty).alias("history"), "dong"
    )


def place_detail(
    places: DataFrame,
    history: DataFrame,
    regions: DataFrame,
    keys: DataFrame | None = None,
    newest_first: bool = False,
    page_entries: int = PAGE_ENTRIES,
) -> DataFrame:
    """Nested documents: place, chronology and neighbourhood statistics.

    One document per place, for all places or for those in ``keys``
    (``place_key``); unknown keys give no document. A chronology longer than
    ``page_entries`` continues in further pages of the same place, so no row
    grows with the data and nothing is cut off. Pages are counted in the order
    asked for: with newest first, page 0 starts with the latest stay. A place without
    history has one page with an empty array, a place without neighbourhood a NULL one.
    """
    if keys is not None:
        wanted = keys.select("place_key").distinct()
        places = places.join(wanted, "place_key", "left_semi")
        history = history.join(wanted, "place_key", "left_semi")
    return documents(detail_header(places, regions), history_pages(history, newest_first, page_entries))


def detail_json(details: DataFrame) -> DataFrame:
    """The documents as JSON text, NULL members kept."""
    body = F.to_json(F.struct("place", "history", "dong"), {"ignoreNullFields": "false"})
    return details.select("place_key", "page", body.alias("document"))


def history_texts(history: DataFrame) -> DataFrame:
    """Chronology rows with category symbol, length and period texts."""
    return history.select(
        "place_key",
        "seq",
        labels.category_symbol(F.col("category_code")).alias("symbol"),
        labels.tenure_text(F.col("tenure_quarters")).alias("tenure_text"),
        labels.period_text(F.col("start_quarter"), F.col("end_quarter"), F.col("tenure_quarters")).alias("period_text"),
    )


def address_lines(places: DataFrame) -> DataFrame:
    line = labels.address_line(F.col("road_address"), F.col("floor_label"), F.col("avg_tenure_months"))
    return places.select("place_key", line.alias("address_line"))


def last_ends(history: DataFrame, base_year: int = BASE_YEAR) -> DataFrame:
    """Latest end label among the closed stays of each place."""
    last = F.max(to_ordinal(F.col("end_quarter"), base_year))
    return (
        history.groupBy("place_key")
        .agg(last.alias("q"))
        .select("place_key", to_label(F.col("q"), base_year=base_year).alias("last_end"))
    )


def headlines(places: DataFrame, history: DataFrame, base_year: int = BASE_YEAR) -> DataFrame:
    """Headline class and texts of every place."""
    line = labels.headline(
        F.col("is_occupied"),
        F.col("stores_current"),
        F.col("turnover_count"),
        F.col("avg_tenure_months"),
        F.col("first_quarter"),
        F.col("last_end"),
        base_year,
    )
    return places.join(last_ends(history, base_year), "place_key", "left").select("place_key", F.inline(F.array(line)))


def neighbourhood_comparison(places: DataFrame, regions: DataFrame) -> DataFrame:
    """Turnover of every place against the mean of its neighbourhood."""
    dong = regions.filter(F.col("region_level") == "dong").select(
        F.col("region_code").alias("dong_code"), F.col("turnover_avg").alias("dong_avg")
    )
    turnover, mean = F.col("turnover_count"), F.col("dong_avg")
    return places.join(dong, "dong_code", "left").select(
        "place_key",
        labels.neighbourhood_class(turnover, mean).alias("kind"),
        labels.neighbourhood_text(turnover, mean).alias("text"),
    )


def turnover_buckets(places: DataFrame) -> DataFrame:
    """Places per turnover bucket; the last bucket is open-ended."""
    bucket = labels.turnover_bucket(F.col("turnover_count")).alias("bucket")
    return places.groupBy(bucket).agg(F.count(F.lit(1)).alias("places"))


def category_groups(history: DataFrame) -> DataFrame:
    """Stays per category group symbol."""
    symbol = labels.category_symbol(F.col("category_code")).alias("symbol")
    return history.groupBy(symbol).agg(
        F.count(F.lit(1)).alias("stays"), F.sum("tenure_quarters").alias("tenure_quarters")
    )
