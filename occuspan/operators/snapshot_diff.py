"""Comparison of two snapshots, data health and search over the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occuspan.functions import periods, text
from occuspan.operators import normalize as raw_names
from occuspan.operators.numbering import number_rows
from occuspan.session import shared_folder, stage

# Verdicts on a place, in the order they are tried; label of a
# missing category in listings; search result caps and shortest term.
NEW_PLACE = "신규 자리"
GONE = "자리 소멸(공실 후보)"
UNDECIDABLE = "판정 곤란(상호 결측)"
ALL_REPLACED = "전원 교체"
PARTLY_REPLACED = "일부 교체"
KEPT = "유지"
TOTAL_LABEL = "(합계)"
NO_CATEGORY = "?"
SEARCH_ROWS = 300
BROWSE_ROWS = 200
SHORTEST_TERM = 2
# Asked-for pairs and terms are sent to every executor up to this many rows, which are counted.
FEW_ROWS = 100_000

LIST_ENTRIES = 1000
# Length of quantile sketches, and the share of the rows their ranks may be off.
SKETCH_K = 400
RANK_ERROR = 0.01
SHOWN_QUANTILES = (0.5, 0.95)


def snapshot_rows(raw: DataFrame) -> DataFrame:
    """Rows of one snapshot as the comparison reads them.

    Unlike the timeline this keeps blank building ids and repeated shops; only
    a NULL building is left out.
    """
    shown = text.display_name(F.col(raw_names.NAME), F.col(raw_names.BRANCH))
    category = F.coalesce(F.col(raw_names.CATEGORY_NAME), F.lit(NO_CATEGORY))
    return raw.filter(F.col(raw_names.BUILDING).isNotNull()).select(
        text.place_key(F.col(raw_names.BUILDING), F.col(raw_names.FLOOR)).alias("place_key"),
        text.normalized_name(F.col(raw_names.NAME), F.col(raw_names.BRANCH)).alias("name_norm"),
        F.concat(shown, F.lit(" · "), category).alias("display"),
        F.col(raw_names.ROAD_ADDRESS).alias("road_address"),
        F.col(raw_names.SIGUNGU_NAME).alias("sigungu"),
        F.col(raw_names.DONG_NAME).alias("dong"),
        text.floor_label(F.col(raw_names.FLOOR)).alias("floor_label"),
    )


def _both(rows_a: DataFrame, rows_b: DataFrame) -> DataFrame:
    in_a = rows_a.withColumn("a", F.lit(1)).withColumn("b", F.lit(0))
    return in_a.unionByName(rows_b.withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))


def snapshot_diff(rows_a: DataFrame, rows_b: DataFrame) -> DataFrame:
    """Which places kept, lost or replaced their occupants, by name survival.

    Names are counted per (place, name) first and per place afterwards, so a
    crowded place is reduced in the map tasks and its names are never listed
    in one row. One pass over both sides takes the place of an outer join.
    """
    described = ["road_address", "sigungu", "dong", "floor_label"]
    a, b = F.col("a") == 1, F.col("b") == 1
    lowest = [F.min(F.when(a, F.col(c))).alias(f"{c}_a") for c in described]
    lowest += [F.min(F.when(b, F.col(c))).alias(f"{c}_b") for c in described]
    per_name = _both(rows_a, rows_b).groupBy("place_key", "name_norm").agg(
        F.sum("a").alias("rows_a"), F.sum("b").alias("rows_b"), *lowest
    )
    named = F.col("name_norm") != ""
    has_a, has_b = F.col("rows_a") > 0, F.col("rows_b") > 0
    per_place = per_name.groupBy("place_key").agg(
        F.sum("rows_a").alias("n_a"),
        F.sum("rows_b").alias("n_b"),
        F.count_if(named & has_a).alias("names_a"),
        F.count_if(named & has_b).alias("names_b"),
        F.count_if(named & has_a & has_b).alias("names_both"),
        *[F.coalesce(F.min(f"{c}_a"), F.min(f"{c}_b")).alias(c) for c in described],
    )
    survived = F.when((F.col("names_a") > 0) & (F.col("names_b") > 0), F.col("names_both"))
    verdict = (
        F.when(F.col("n_a") == 0, NEW_PLACE)
        .when(F.col("n_b") == 0, GONE)
        .when((F.col("names_a") == 0) | (F.col("names_b") == 0), UNDECIDABLE)
        .when(F.col("names_both") == 0, ALL_REPLACED)
        .when(F.col("names_both") < F.col("names_a"), PARTLY_REPLACED)
        .otherwise(KEPT)
    )
    return per_place.select(
        "place_key",
        *described,
        F.nullif("n_a", F.lit(0)).alias("n_a"),
        F.nullif("n_b", F.lit(0)).alias("n_b"),
        survived.alias("survived"),
        verdict.alias("verdict"),
    )


def distinct_displays(rows_a: DataFrame, rows_b: DataFrame) -> DataFrame:
    """Distinct shop listings per place, with the sides they occur on."""
    return (
        _both(rows_a, rows_b)
        .groupBy("place_key", "display")
        .agg((F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b"))
    )


def display_lists(rows_a: DataFrame, rows_b: DataFrame, list_entries: int = LIST_ENTRIES) -> DataFrame:
    """Sorted listings of both sides per place, as arrays of limited length.

    Places with more than ``list_entries`` listings continue in further chunks, in
    the order of the listings, so no row collects a whole crowded place.
    """
    shown = distinct_displays(rows_a, rows_b).withColumn("_text", F.coalesce("display", F.lit("")))
    shown = number_rows(shown, "place_key", ["_text"], "_at")
    chunk = F.floor((F.col("_at") - 1) / list_entries).cast("int")
    listed = F.array_sort(F.collect_list(F.when(F.col("in_a"), F.col("display"))))
    listed_b = F.array_sort(F.collect_list(F.when(F.col("in_b"), F.col("display"))))
    return (
        shown.groupBy("place_key", chunk.alias("chunk"))
        .agg(listed.alias("display_a"), listed_b.alias("display_b"))
    )


def diff_listing(rows_a: DataFrame, rows_b: DataFrame, list_entries: int = LIST_ENTRIES) -> DataFrame:
    """The comparison with its listings; one row per place unless it is crowded.

    Counts are NULL in the further chunks of a place, so their sums are right over
    all rows; rows of chunk 0 are the places.
    """
    listed = snapshot_diff(rows_a, rows_b).join(display_lists(rows_a, rows_b, list_entries), "place_key")
    return listed.withColumns({c: F.when(F.col("chunk") == 0, F.col(c)) for c in ("n_a", "n_b", "survived")})


def diff_export(listing: DataFrame) -> DataFrame:
    """Flat form for text files: listings joined into one string."""
    return listing.select(
        "sigungu",
        "road_address",
        "floor_label",
        "place_key",
        "chunk",
        "dong",
        F.when(F.col("chunk") == 0, F.coalesce("n_a", F.lit(0))).alias("n_a"),
        F.when(F.col("chunk") == 0, F.coalesce("n_b", F.lit(0))).alias("n_b"),
        F.array_join("display_a", " / ").alias("display_a"),
        F.array_join("display_b", " / ").alias("display_b"),
        "survived",
        "verdict",
    )


def verdict_distribution(diff: DataFrame) -> DataFrame:
    """Places and share per verdict, and a total row."""
    counted = diff.rollup("verdict").agg(
        F.count(F.lit(1)).alias("places"),
        F.when(F.grouping("verdict") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col("verdict")).alias("label"),
    )
    # At most seven rows are left here, the total being the largest count.
    total = F.max("places").over(Window.partitionBy(F.lit(1)))
    share = text.round_half_up(F.col("places") * F.lit(100.0) / total, 1)
    return counted.select(F.col("label").alias("verdict"), "places", share.alias("pct"))


def verdicts_by_count(diff: DataFrame) -> DataFrame:
    """Places per verdict, the most frequent first, with their position; at most six rows."""
    counted = diff.groupBy("verdict").agg(F.count(F.lit(1)).alias("places"))
    most_first = [F.col("places").desc(), F.col("verdict")]
    return counted.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*most_first))).orderBy("position")


def missing_profile(raw: DataFrame, base_year: int = periods.BASE_YEAR) -> DataFrame:
    """Rows and shares of missing or unusable values, per period and metric."""
    month = periods.last_month(F.col(raw_names.PERIOD), base_year)
    tests = {
        "no_building": text.is_blank(F.col(raw_names.BUILDING)),
        "no_floor": text.is_blank(F.col(raw_names.FLOOR)),
        "no_unit": text.is_blank(F.col(raw_names.UNIT)),
        "late_id": raw_names.id_date_is_late(F.col(raw_names.STORE_ID), month),
        "bad_coordinates": ~F.coalesce(raw_names.coordinates_usable(), F.lit(False)),
    }
    counted = raw.groupBy(raw_names.PERIOD).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(test).alias(name) for name, test in tests.items()]
    )
    metrics = F.array(
        *[F.struct(F.lit(name).alias("metric"), F.col(name).alias("rows")) for name in ("total", *tests)]
    )
    share = text.round_half_up(F.col("rows") * F.lit(100.0) / F.col("total"), 1)
    return counted.select(raw_names.PERIOD, "total", F.inline(metrics)).select(
        raw_names.PERIOD, "metric", "rows", share.alias("pct")
    )


def place_size_quantiles(raw: DataFrame) -> DataFrame:
    """Median, 95th percentile and maximum of shops per place, per period.

    Places are first reduced to a histogram of sizes, which the exact
    percentile reads with frequencies.
    """
    histogram = _place_sizes(raw).groupBy(raw_names.PERIOD, "shops").agg(F.count(F.lit(1)).alias("places"))

    def quantile(at: float) -> Column:
        return F.percentile("shops", F.lit(at), F.col("places"))

    return histogram.groupBy(raw_names.PERIOD).agg(
        quantile(0.5).alias("median"), quantile(0.95).alias("p95"), F.max("shops").alias("largest")
    )


def _place_sizes(raw: DataFrame) -> DataFrame:
    key = text.place_key(F.col(raw_names.BUILDING), F.col(raw_names.FLOOR))
    return (
        raw.filter(F.col(raw_names.BUILDING).isNotNull())
        .groupBy(raw_names.PERIOD, key.alias("place_key"))
        .agg(F.count(F.lit(1)).alias("shops"))
    )


def place_size_sketches(raw: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """Shops per place of each period as a quantile sketch of a few kilobytes, which can be merged."""
    return _place_sizes(raw).groupBy(raw_names.PERIOD).agg(F.kll_sketch_agg_bigint("shops", F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, span: Column, name: str) -> DataFrame:
    """Median and 95th percentile over spans of periods, from their sketches alone.

    Values are approximate: with ``SKETCH_K`` their rank is off by less than ``RANK_ERROR``
    of the places, with a probability of 99 in 100. The number of places is exact.
    """
    merged = sketches.groupBy(span.alias(name)).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    at = {f"p{round(q * 100)}": F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)) for q in SHOWN_QUANTILES}
    return merged.select(name, F.kll_sketch_get_n_bigint("sketch").alias("places"), *[value.alias(c) for c, value in at.items()])


def quantile_ranks(raw: DataFrame, quantiles: DataFrame, span: Column, name: str) -> DataFrame:
    """Are approximate quantiles within ``RANK_ERROR`` of the exact ranks? One column each."""
    sizes = _place_sizes(raw).groupBy(span.alias(name), "shops").agg(F.count(F.lit(1)).alias("n"))
    joined = sizes.join(quantiles, name)
    tests = []
    for q in SHOWN_QUANTILES:
        value = F.col(f"p{round(q * 100)}")
        below, upto = (F.sum(F.when(test, F.col("n")).otherwise(0)) / F.sum("n") for test in (F.col("shops") < value, F.col("shops") <= value))
        tests.append(((below - RANK_ERROR <= q) & (upto + RANK_ERROR >= q)).alias(f"p{round(q * 100)}_close"))
    return joined.groupBy(name, "places").agg(*tests)


def char_pairs(body: Column) -> Column:
    """The distinct pairs of neighbouring characters of a text."""
    starts = F.when(F.length(body) >= SHORTEST_TERM, F.sequence(F.lit(1), F.length(body) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: body.substr(at, F.lit(2))))


def search_texts(diff: DataFrame, displays: DataFrame) -> DataFrame:
    """What a search looks at: addresses and listings with their place, and what results are ordered by."""
    place = diff.select("place_key", "road_address", "floor_label")
    # Files of listings are many times smaller than their rows, so sizes of files must not choose a broadcast.
    bodies = place.withColumn("body", F.col("road_address")).unionByName(
        displays.select("place_key", F.col("display").alias("body")).join(place.hint("merge"), "place_key")
    )
    named = bodies.filter(F.col("body").isNotNull())
    return named.withColumn("text_id", F.xxhash64("place_key", "body"))


def search_index(texts: DataFrame) -> DataFrame:
    """Inverted index: the texts every pair of characters occurs in, as (pair, text_id)."""
    return texts.select("text_id", F.explode(char_pairs(F.col("body"))).alias("pair"))


def _asked_for(rows: DataFrame) -> DataFrame:
    """The side of a join that the terms decide: broadcast if its counted rows are few, else both sides move.

    Spark takes the exploded index to be as small as the file it comes from, and would broadcast it.
    """
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows.hint("merge")


def rarest_pairs(terms: DataFrame, index: DataFrame) -> DataFrame:
    """For each term the pair of its characters that the fewest texts hold; no row if one is in no text."""
    pairs = terms.withColumn("pairs", char_pairs(F.col("term"))).select("term", F.size("pairs").alias("n"), F.explode("pairs").alias("pair"))
    sizes = index.join(_asked_for(pairs.select("pair").distinct()), "pair", "left_semi").groupBy("pair").agg(F.count(F.lit(1)).alias("texts"))
    chosen = pairs.join(sizes, "pair").groupBy("term", "n").agg(F.count(F.lit(1)).alias("met"), F.min_by("pair", F.struct("texts", "pair")).alias("pair"))
    return chosen.filter(F.col("met") == F.col("n")).select("term", "pair")


def term_candidates(terms: DataFrame, index: DataFrame, folder: str | None = None) -> DataFrame:
    """The texts that hold the rarest pair of a term, as (term, text_id); the index stays where it is read."""
    folder = folder or shared_folder(index.sparkSession)
    rarest = stage(rarest_pairs(terms, index), folder, "rarest")
    return index.join(_asked_for(rarest), "pair").select("term", "text_id")


def search_terms(terms: DataFrame | Sequence[str], spark: SparkSession) -> DataFrame:
    """Distinct trimmed terms that are long enough to find anything."""
    if not isinstance(terms, DataFrame):
        terms = spark.createDataFrame([(term,) for term in terms], "term string")
    trimmed = terms.select(F.regexp_replace("term", r"(?U)^\s+|\s+$", "").alias("term")).distinct()
    return trimmed.filter(F.length("term") >= SHORTEST_TERM)


def place_search(diff: DataFrame, displays: DataFrame, terms: DataFrame | Sequence[str], top: int = SEARCH_ROWS) -> DataFrame:
    """Places whose address or listings contain a term, the first ``top`` each.

    Results are ordered by address, floor and key and carry the full number of
    matches. Terms, any number of them, are trimmed; below two characters they find
    nothing. A term is looked up by the rarest of its pairs of characters, and only the
    texts that hold this pair are tested; matches are ranked before they meet ``diff``.
    """
    folder = shared_folder(diff.sparkSession)
    diff = stage(diff, folder, "compared")
    texts = stage(search_texts(diff, displays), folder, "texts")
    candidates = term_candidates(search_terms(terms, diff.sparkSession), search_index(texts), folder)
    tested = candidates.join(texts.hint("merge"), "text_id").filter(F.contains("body", "term"))
    found = stage(tested.select("term", "place_key", "road_address", "floor_label").distinct(), folder, "found")
    per_term = Window.partitionBy("term").orderBy(
        F.col("road_address").asc_nulls_last(), F.col("floor_label").asc_nulls_last(), F.col("place_key")
    )
    first = found.withColumn("rank", F.row_number().over(per_term)).filter(F.col("rank") <= top)
    totals = found.groupBy("term").agg(F.count(F.lit(1)).alias("matches"))
    verdicts = first.join(totals, "term").join(diff.select("place_key", "verdict").hint("merge"), "place_key")
    return verdicts.select("term", "rank", "matches", "place_key", "road_address", "floor_label", "verdict")


def browse(diff: DataFrame, top: int = BROWSE_ROWS) -> DataFrame:
    """The first places in address order, shown while nothing is searched."""
    return diff.orderBy(
        F.col("road_address").asc_nulls_last(), F.col("floor_label").asc_nulls_last(), F.col("place_key")
    ).limit(top)
