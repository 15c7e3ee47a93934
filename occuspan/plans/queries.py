"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.functions import geo, periods, text
from occuspan.operators import (
    detail,
    metadata,
    normalize,
    places,
    quality,
    regions,
    snapshot_diff,
    timeline,
    viewport,
)
from occuspan.plans import period_store
from occuspan.plans.inputs import BASE_YEAR, SEARCH_TERMS, Tables, raw_snapshots, read_table
from occuspan.session import bucketed_stage, stage
from occuspan.sinks import publish
from occuspan.sources import snapshots

# Thresholds that fit the given tables.
PLACE_COUNT_RANGE = (10, 10_000_000)
TENURE_RANGE = (3.0, 84.0)
ONE_BOX = (126.6, 37.2, 126.9, 37.8)
# Page and chunk length of the queries that show how long rows continue.
SHORT_PAGE = 3

Query = Callable[[Tables], DataFrame]


def _name_norm(t: Tables) -> DataFrame:
    name, branch = F.col(normalize.NAME), F.col(normalize.BRANCH)
    named = t.raw.select(
        name.alias("name"),
        branch.alias("branch"),
        text.normalized_name(name, branch).alias("name_norm"),
        text.display_name(name, branch).alias("display"),
    )
    return named.groupBy("name", "branch", "name_norm", "display").agg(F.count(F.lit(1)).alias("rows"))


def _period_labels(t: Tables) -> DataFrame:
    q = F.col(normalize.PERIOD)
    label = periods.to_label(q, t.latest, BASE_YEAR)
    month = periods.last_month(q, BASE_YEAR)
    year, month_no = F.substring(month, 1, 4), F.substring(month, 5, 2).cast("int")
    counted = t.raw.groupBy(normalize.PERIOD).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(
        q.alias("qord"),
        label.alias("label"),
        periods.to_ordinal(label, BASE_YEAR).alias("ordinal"),
        month.alias("last_month"),
        periods.month_to_label(year, month_no).alias("month_label"),
        periods.short_display(label).alias("short_text"),
        periods.long_display(label).alias("long_text"),
        "rows",
    )


def _spans(t: Tables) -> DataFrame:
    return t.spans.select(
        "store_id", "place_key", "island", "start_q", "end_q", "name_norm", "cat_code", "cat_name"
    )


def _logical(t: Tables) -> DataFrame:
    return t.logical.drop("own_store", "own_island")


def _region_rows(stats: DataFrame) -> DataFrame:
    """Centres to six digits: the last bits of a mean depend on the order of its sum."""
    return stats.withColumns({c: F.round(c, 6) for c in ("center_lat", "center_lng")})


def _with_point(t: Tables) -> DataFrame:
    """Places per point and grid cell, read back from the point column."""
    pointed = places.with_point(t.places)
    return pointed.groupBy("geom.lng", "geom.lat", "cell_key").agg(
        F.count(F.lit(1)).alias("places"), F.sum("turnover_count").alias("turnover_sum")
    )


def _shown_documents(docs: DataFrame) -> DataFrame:
    entries = F.col("history")
    return docs.select(
        "place_key",
        "page",
        F.size(entries).alias("entries"),
        F.array_join(F.transform(entries, lambda e: e["category_code"]), ",").alias("codes"),
        F.array_join(F.transform(entries, lambda e: F.coalesce(e["end_quarter"], F.lit("-"))), ",").alias("ends"),
        F.col("place.turnover_count").alias("turnover_count"),
        F.col("dong.region_name").alias("dong_name"),
        F.col("dong.turnover_avg").alias("dong_turnover_avg"),
    )


def _place_detail(t: Tables, page_entries: int = detail.PAGE_ENTRIES) -> DataFrame:
    return _shown_documents(detail.place_detail(t.built_places, t.built_history, t.regions, page_entries=page_entries))


def _place_detail_stored(t: Tables) -> DataFrame:
    """Documents from headers and pages that are stored in buckets of the place."""
    header = bucketed_stage(detail.detail_header(t.built_places, t.regions), t.folder, "detail_header", "place_key")
    pages = bucketed_stage(detail.history_pages(t.built_history), t.folder, "history_pages", "place_key")
    return _shown_documents(detail.documents(header, pages))


def _place_size_sketches(t: Tables) -> DataFrame:
    """Sketches per quarter, merged into years, and whether their quantiles are as close as promised."""
    year = (F.floor(F.col(normalize.PERIOD) / 4) + BASE_YEAR).cast("int")
    sketches = stage(snapshot_diff.place_size_sketches(t.raw), t.folder, "sketches")
    return snapshot_diff.quantile_ranks(t.raw, snapshot_diff.merged_quantiles(sketches, year, "year"), year, "year")


def _appended_spans(t: Tables) -> DataFrame:
    """All periods but the latest at once, one of them incomplete; then that one again, then the latest."""
    root, again = f"{t.folder}/store", t.latest // 2
    early = t.raw.filter((F.col(normalize.PERIOD) < t.latest) & ((F.col(normalize.PERIOD) != again) | (F.col(normalize.SIDO_CODE) == "0")))
    period_store.append_period(t.spark, root, early)
    for period in (again, t.latest):  # only the rows of one period are read for its delivery
        period_store.append_period(t.spark, root, raw_snapshots(t.spark, t.sf_dir, period))
    return period_store.current_spans(t.spark, root).select(
        "store_id", "place_key", "island", "start_q", "end_q", "name_norm", "cat_code", "cat_name"
    )


def _place_documents(t: Tables, page_entries: int = detail.PAGE_ENTRIES) -> DataFrame:
    """Documents of the asked-for keys, newest stay first, as JSON and read back."""
    docs = detail.place_detail(t.built_places, t.built_history, t.regions, t.gate_keys, True, page_entries)
    body = F.col("document")
    return detail.detail_json(docs).select(
        "place_key",
        "page",
        F.get_json_object(body, "$.place.floor_label").alias("floor_label"),
        F.get_json_object(body, "$.history[0].category_code").alias("newest_code"),
        F.json_array_length(F.get_json_object(body, "$.history")).alias("entries"),
        F.get_json_object(body, "$.dong.region_code").alias("dong_code"),
    )


def _snapshot_diff(t: Tables, list_entries: int = snapshot_diff.LIST_ENTRIES) -> DataFrame:
    return snapshot_diff.diff_export(snapshot_diff.diff_listing(t.first_rows, t.latest_rows, list_entries))


def _place_search(t: Tables) -> DataFrame:
    shown = snapshot_diff.distinct_displays(t.first_rows, t.latest_rows)
    return snapshot_diff.place_search(t.diff, shown, SEARCH_TERMS)


def _verdicts(t: Tables) -> DataFrame:
    return snapshot_diff.verdict_distribution(t.diff)


def _viewport_one(t: Tables) -> DataFrame:
    """One box, answered from published files."""
    root = f"{t.folder}/published_map"
    publish.publish(t.spark, root, t.published, "first")
    return viewport.viewport_places(publish.current_map(t.spark, root), ONE_BOX, min_turnover=2, max_rows=5000)


def _viewport_regions_one(t: Tables) -> DataFrame:
    return viewport.viewport_regions(_region_rows(t.regions), "dong", ONE_BOX)


def _viewport_regions(t: Tables) -> DataFrame:
    markers = viewport.viewport_regions_batch(_region_rows(t.regions), t.viewports)
    return markers.select("viewport_id", "region_level", "region_code", "region_name", "place_count", "turnover_avg")


def _quality(t: Tables) -> DataFrame:
    return quality.quality_checks(
        t.built_places, t.built_history, t.built_regions, t.gate_keys, PLACE_COUNT_RANGE, TENURE_RANGE
    )


def _orphans(t: Tables) -> DataFrame:
    """Chronology rows left without a place once vacant places are removed."""
    return quality.orphan_history(t.built_history, t.built_places.filter("stores_current > 0"))


def _kept_history(t: Tables) -> DataFrame:
    """Chronology after the cascade of the same removal, per place."""
    kept = quality.drop_orphans(t.built_history, t.built_places.filter("stores_current > 0"))
    return kept.groupBy("place_key").agg(F.count(F.lit(1)).alias("stays"), F.max("seq").alias("last_seq"))


def _constraints(t: Tables) -> DataFrame:
    return quality.constraint_violations(t.built_places, t.built_history, t.built_regions)


def _stamps(t: Tables) -> DataFrame:
    """One build stamp per period and province found in the snapshots."""
    first_day = F.concat(periods.last_month(F.col(normalize.PERIOD), BASE_YEAR), F.lit("01"))
    seen = t.raw.groupBy(normalize.PERIOD, normalize.SIDO_NAME).agg(F.count(F.lit(1)).alias("rows"))
    return seen.select(
        periods.to_label(F.col(normalize.PERIOD), t.latest, BASE_YEAR).alias("latest_quarter"),
        F.col(normalize.SIDO_NAME).alias("coverage"),
        F.to_timestamp(first_day, "yyyyMMdd").alias("built_at"),
    )


def _upserted(rows: DataFrame) -> DataFrame:
    """The rows of a middle period and before, updated by the later ones."""
    half = F.to_timestamp(F.lit(f"{BASE_YEAR + 3}-07-01"))
    return metadata.upsert_metadata(rows.filter(F.col("updated_at") < half), rows.filter(F.col("updated_at") >= half))


def _meta_upsert(t: Tables) -> DataFrame:
    rows = _stamps(t).select(
        F.concat("coverage", F.lit("/latest_quarter")).alias("key"),
        F.col("latest_quarter").alias("value"),
        F.col("built_at").alias("updated_at"),
    )
    return _upserted(rows).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))


def _meta_record(t: Tables) -> DataFrame:
    stamps = _stamps(t).withColumn("coverage", F.lit(snapshots.ALL_COVERAGE))
    return metadata.metadata_record(_upserted(metadata.build_metadata(stamps)))


def _publish_roundtrip(t: Tables) -> DataFrame:
    """Publish, publish again, and read the newest version back."""
    root = f"{t.folder}/published"
    publish.publish(t.spark, root, t.published, "first")
    checks = _quality(t)
    publish.publish(t.spark, root, t.published, "second", checks, ("no_orphan_history", "no_inverted_interval"))
    read_back = publish.current(t.spark, root, "place_history")
    return read_back.join(publish.current(t.spark, root, "places").select("place_key"), "place_key")


def _size_report(t: Tables) -> DataFrame:
    folder = f"{t.folder}/sized"
    publish.export_tables(t.published, folder, "csv")
    sizes = publish.size_report(t.spark, folder)
    counted = [
        t.spark.read.option("header", "true").csv(f"{folder}/{name}").agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        for name in t.published
    ]
    found = sizes.join(reduce(DataFrame.unionByName, counted), "table")
    return found.select("table", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"), "rows")


def _csv_quarantine(t: Tables) -> DataFrame:
    """Snapshots with quoted line breaks, and lines that do not fit, read and accounted for."""
    root = f"{t.folder}/csv_quarantine"
    label = periods.to_label(F.col(normalize.PERIOD), base_year=BASE_YEAR).alias("period")
    raw = stage(t.raw, t.folder, "raw")  # read three times, once to sample the ranges
    columns = [c for c in raw.columns if c != normalize.PERIOD]
    broken = raw.withColumn(normalize.NAME, F.concat_ws("\n", normalize.NAME, F.lit("2")))
    filed = broken.select(label, *columns).repartitionByRange("period", normalize.STORE_ID)
    options = {"header": "true", "quote": '"', "escape": '"'}
    filed.write.mode("append").partitionBy("period").options(**options).csv(root)
    # One line too long and one too short per period and province.
    odd = raw.select(label, normalize.SIDO_CODE).distinct()
    long_line = F.array_join(F.array_repeat(F.col(normalize.SIDO_CODE), len(columns) + 2), ",")
    lines = odd.select("period", F.explode(F.array(long_line, F.lit("x,y"))).alias("line"))
    whole = lines.groupBy("period").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    text = whole.select("period", F.concat(F.lit(",".join(columns) + "\n"), "lines").alias("value"))
    text.write.mode("append").partitionBy("period").text(root)
    files = snapshots.available(t.spark, root, keyword="part-")
    texts = snapshots.available(t.spark, root, keyword="part-", pattern="*.txt")
    merged = {key: files.get(key, []) + texts.get(key, []) for key in {**files, **texts}}
    return snapshots.read_report(snapshots.read_snapshots(t.spark, merged, BASE_YEAR, multi_line=True))


def _csv_by_name(t: Tables) -> DataFrame:
    """Snapshots written as CSV with two column orders, read back by name."""
    root = f"{t.folder}/csv"
    label = periods.to_label(F.col(normalize.PERIOD), base_year=BASE_YEAR).alias("period")
    columns = [c for c in t.raw.columns if c != normalize.PERIOD]
    even = F.col(normalize.SIDO_CODE).cast("int") % 2 == 0
    rows = t.raw.select(label, *columns)
    for part, order in ((rows.filter(even), columns), (rows.filter(~even), columns[::-1])):
        filed = part.select("period", *order).repartitionByRange("period", normalize.STORE_ID)
        writer = filed.write.mode("append").partitionBy("period")
        writer.options(header="true", quote='"', escape='"').csv(root)
    files = snapshots.available(t.spark, root, keyword="part-")
    read_back = snapshots.well_formed(snapshots.read_snapshots(t.spark, files, BASE_YEAR))
    return normalize.stores(read_back)


def _file_by_province(t: Tables, root: str) -> None:
    """Snapshots as they are delivered: one folder a period, in it a file for each province."""
    label = periods.to_label(F.col(normalize.PERIOD), base_year=BASE_YEAR).alias("period")
    columns = [c for c in t.raw.columns if c != normalize.PERIOD]
    rows = t.raw.select(label, F.col(normalize.SIDO_NAME).alias("province"), *columns)
    parts = rows.repartition("period", "province").write.partitionBy("period", "province")
    parts.options(header="true", quote='"', escape='"').csv(f"{root}_parts")
    jvm, conf = t.spark.sparkContext._jvm, t.spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(conf)
    for found in files.globStatus(path(f"{root}_parts/period=*/province=*/*.csv")):
        province, period = (found.getPath().getParent().getName(), found.getPath().getParent().getParent().getName())
        folder = path(f"{root}/{period.removeprefix('period=')}")
        files.mkdirs(folder)
        month = int(period[-1]) * 3
        named = f"{snapshots.FILE_KEYWORD}_{province.removeprefix('province=')}_{period.removeprefix('period=')[:4]}{month:02d}.csv"
        files.rename(found.getPath(), path(folder, named))


def _csv_one_province(t: Tables) -> DataFrame:
    """One province of snapshots filed by province: other files are not opened."""
    root = f"{t.folder}/csv_by_province"
    _file_by_province(t, root)
    files = snapshots.available(t.spark, root, "ASIA")
    return normalize.stores(snapshots.well_formed(snapshots.read_snapshots(t.spark, files, BASE_YEAR)))


def _label_check(t: Tables) -> DataFrame:
    """Shipments filed under the quarter of their order, one file per month.

    All dates are moved by twenty years, because file names carry ``20YYMM``.
    """
    lines = read_table(t.spark, t.sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = read_table(t.spark, t.sf_dir, "orders").select("o_orderkey", "o_orderdate")
    filed = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    label = periods.month_to_label(F.year("o_orderdate") + 20, F.month("o_orderdate"))
    month = F.concat((F.year("l_shipdate") + 20).cast("string"), F.date_format("l_shipdate", "MM"))
    path = F.concat(F.lit("/raw/"), label, F.lit(f"/{snapshots.FILE_KEYWORD}_"), month, F.lit(".csv"))
    return snapshots.check_labels(filed.select(path.alias("path")).distinct())


def _district_export(t: Tables) -> DataFrame:
    """The comparison written per district and read back."""
    root = f"{t.folder}/districts"
    flat = snapshot_diff.diff_export(snapshot_diff.diff_listing(t.first_rows, t.latest_rows))
    publish.export_districts(flat, root)
    schema = flat.schema
    return t.spark.read.schema(schema).json(root).select(
        "sigungu", "place_key", "chunk", "road_address", "floor_label", "n_a", "n_b", "display_a", "display_b", "verdict"
    )


def _diff_csv(t: Tables) -> DataFrame:
    """The comparison written as CSV and read back, counted per verdict."""
    root = f"{t.folder}/diff_csv"
    flat = stage(snapshot_diff.diff_export(snapshot_diff.diff_listing(t.first_rows, t.latest_rows)), t.folder, "diff")
    publish.export_diff(flat, root)
    read_back = t.spark.read.options(header="true", quote='"', escape='"').schema(flat.schema).csv(root)
    firsts = read_back.filter("chunk = 0")
    return firsts.groupBy("verdict").agg(F.count(F.lit(1)).alias("places"), F.sum("n_a").alias("n_a"))


def _browse(t: Tables) -> DataFrame:
    return snapshot_diff.browse(t.diff).select("place_key", "road_address", "floor_label", "verdict")


def _covered(t: Tables) -> DataFrame:
    """Drop report of one province."""
    return normalize.drop_report(snapshots.covered(t.raw, normalize.SIDO_NAME, "ASIA"))


QUERIES: dict[str, Query] = {
    "name_norm": _name_norm,
    "normalized_snapshot": lambda t: t.stores,
    "drop_report": lambda t: normalize.drop_report(t.raw),
    "drop_report_one_province": _covered,
    "period_labels": _period_labels,
    "id_date_contamination": lambda t: normalize.id_contamination(t.raw, BASE_YEAR),
    "spans": _spans,
    "logical_stores": _logical,
    "boundary_counts": lambda t: timeline.boundary_counts(t.logical, t.latest),
    "place_turnover": lambda t: timeline.place_turnover(t.logical, t.latest),
    "merge_counts": lambda t: timeline.merge_counts(t.logical),
    "place_profile": lambda t: places.place_profile(t.spans, t.latest),
    "place_tenure": lambda t: places.place_tenure(t.logical, t.latest),
    "current_category": lambda t: places.current_category(t.logical, t.latest),
    "places": lambda t: t.places,
    "place_points": _with_point,
    "place_history": lambda t: t.history,
    "top_turnover": lambda t: places.top_turnover(t.places),
    "region_names": lambda t: regions.region_names(t.stores),
    "region_stats": lambda t: _region_rows(t.regions),
    "viewport_places_one": _viewport_one,
    "viewport_places_batch": lambda t: viewport.viewport_places_batch(t.built_places, t.viewports),
    "viewport_regions_one": _viewport_regions_one,
    "viewport_regions": _viewport_regions,
    "map_level": lambda t: viewport.viewport_requests(t.viewports),
    "place_detail": _place_detail,
    "place_documents": _place_documents,
    "place_detail_pages": lambda t: _place_detail(t, SHORT_PAGE),
    "place_detail_stored": _place_detail_stored,
    "place_documents_pages": lambda t: _place_documents(t, SHORT_PAGE),
    "period_text": lambda t: detail.history_texts(t.history),
    "address_line": lambda t: detail.address_lines(t.places),
    "headline": lambda t: detail.headlines(t.built_places, t.built_history, BASE_YEAR),
    "dong_comparison": lambda t: detail.neighbourhood_comparison(t.built_places, t.regions),
    "category_group": lambda t: detail.category_groups(t.history),
    "turnover_buckets": lambda t: detail.turnover_buckets(t.places),
    "snapshot_diff": _snapshot_diff,
    "snapshot_diff_pages": lambda t: _snapshot_diff(t, SHORT_PAGE),
    "verdict_distribution": _verdicts,
    "verdicts_by_count": lambda t: snapshot_diff.verdicts_by_count(t.diff),
    "missing_profile": lambda t: snapshot_diff.missing_profile(t.raw, BASE_YEAR),
    "place_size_quantiles": lambda t: snapshot_diff.place_size_quantiles(t.raw),
    "place_size_sketches": _place_size_sketches,
    "place_search": _place_search,
    "place_browse": _browse,
    "diff_csv": _diff_csv,
    "district_export": _district_export,
    "quality_checks": _quality,
    "orphan_history": _orphans,
    "history_cascade": _kept_history,
    "gate_lookup": lambda t: quality.gate_lookup(t.places, t.gate_keys),
    "turnover_histogram": lambda t: quality.turnover_histogram(t.places),
    "constraint_violations": _constraints,
    "appended_spans": _appended_spans,
    "publish_roundtrip": _publish_roundtrip,
    "meta_upsert": _meta_upsert,
    "meta_record": _meta_record,
    "size_report": _size_report,
    "csv_quarantine": _csv_quarantine,
    "csv_union_by_name": _csv_by_name,
    "csv_one_province": _csv_one_province,
    "label_check": _label_check,
}


# Only their spans read the snapshot rows, so writing these and reading them back would serve nothing.
ROWS_READ_ONCE = ("place_history", "turnover_histogram")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query, stage_stores: bool) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Tables(spark, sf_dir, stage_stores))

    return {name: bind(query, name not in ROWS_READ_ONCE) for name, query in QUERIES.items()}
