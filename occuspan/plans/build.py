"""The whole build: snapshots in, checked and published tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.functions.periods import BASE_YEAR, label_of, ordinal_of
from occuspan.operators import metadata, normalize, places, quality, regions, timeline
from occuspan.session import measured_stage, shared_folder, stage, tune
from occuspan.sinks import publish
from occuspan.sources import snapshots


@dataclass(frozen=True)
class Built:
    """Tables of one build, all read from stage files."""

    stores: DataFrame
    spans: DataFrame
    logical: DataFrame
    places: DataFrame
    history: DataFrame
    regions: DataFrame
    # Per table what its write counted: rows, violations of rules, numbers that checks compare.
    measured: Mapping[str, Mapping[str, object]] = field(default_factory=dict)

    @property
    def tables_measured(self) -> dict[str, Mapping[str, object]]:
        """The measures of the published tables."""
        return {name: values for name, values in self.measured.items() if name in quality.TABLE_KEYS}

    @property
    def published(self) -> dict[str, DataFrame]:
        return {"places": self.places, "place_history": self.history, "region_stats": self.regions}


def build_tables(raw: DataFrame, latest: int, folder: str, base_year: int = BASE_YEAR) -> Built:
    """Run the stages one after the other; each is computed once, and measured while it is written."""
    counted, measured = {"rows": F.count(F.lit(1))}, {}
    stores = stage(normalize.stores(raw), folder, "stores")
    spans, measured["spans"] = measured_stage(timeline.spans(stores), folder, "spans", counted)
    logical, measured["logical_stores"] = measured_stage(timeline.logical_stores(spans), folder, "logical_stores", counted)
    place_rows, measured["places"] = checked_stage("places", places.places(spans, logical, latest, base_year), folder)
    history, measured["place_history"] = checked_stage("place_history", places.place_history(logical, latest, base_year), folder)
    stats = regions.region_stats(place_rows, regions.region_names(stores))
    region_rows, measured["region_stats"] = checked_stage("region_stats", stats, folder)
    return Built(stores, spans, logical, place_rows, history, region_rows, measured)


def checked_stage(name: str, df: DataFrame, folder: str) -> tuple[DataFrame, dict]:
    """A published table as a stage; its rules are checked by the write."""
    kept, found = measured_stage(quality.marked_repeats(name, df), folder, name, quality.table_measures(name))
    return kept.drop(quality.REPEATED), found


def run(
    spark: SparkSession,
    snapshot_root: str,
    publish_root: str,
    coverage: str = snapshots.ALL_COVERAGE,
    keyword: str = snapshots.FILE_KEYWORD,
    base_year: int = BASE_YEAR,
    gate_keys: DataFrame | None = None,
    place_count_range: tuple[int, int] = quality.PLACE_COUNT_RANGE,
    tenure_range: tuple[float, float] = quality.TENURE_RANGE,
    blocking: Sequence[str] | None = None,
    multi_line: bool = True,
    most_malformed: float = snapshots.MOST_MALFORMED,
) -> int:
    """Read all snapshots, build, check and publish; returns the version.

    The latest period comes from the folder names, not from the data. Lines that do
    not fit their header are kept in the version's ``quarantine`` table, counted in
    its ``drop_report``, and stop the publication beyond a share of all lines, as do
    file names that belong to another period. With ``multi_line`` quoted line breaks
    are read, and a file is read by one task; province files are small enough. Rules of
    the published tables (values that must be there or are allowed, unique keys) are checked
    by the writes themselves and stop the publication as well.
    """
    tune(spark)
    files = snapshots.available(spark, snapshot_root, coverage, keyword)
    if not files:
        raise ValueError(f"no snapshots below {snapshot_root}")
    latest = max(ordinal_of(label, base_year) for label in files)
    folder = shared_folder(spark)
    read = stage(snapshots.read_snapshots(spark, files, base_year, multi_line), folder, "read")
    raw, report = snapshots.well_formed(read), stage(snapshots.read_report(read), folder, "drop_report")
    built = build_tables(raw, latest, folder, base_year)
    checks = quality.quality_checks(
        built.places, built.history, built.regions, gate_keys, place_count_range, tenure_range, built.tables_measured
    )
    names = spark.createDataFrame([(path,) for paths in files.values() for path in paths], "path string")
    checks = checks.unionByName(snapshots.read_checks(report, names, most_malformed))
    stamp = spark.range(1).select(
        F.lit(label_of(latest, base_year)).alias("latest_quarter"),
        F.lit(coverage).alias("coverage"),
        F.current_timestamp().alias("built_at"),
    )
    meta, meta_measured = checked_stage("app_meta", metadata.build_metadata(stamp), folder)
    rules = quality.constraint_checks({**built.tables_measured, "app_meta": meta_measured})
    checks = checks.unionByName(spark.createDataFrame(rules, "check string, ok boolean, detail string"))
    data_version = metadata.metadata_record(meta).first()["data_version"]  # one row by construction
    counts = [(name, int(values["rows"])) for name, values in built.measured.items() if "rows" in values]
    merged = spark.createDataFrame(counts, "table string, rows long")
    extra = {"app_meta": meta, "merge_counts": merged, "drop_report": report, "quarantine": snapshots.malformed(read)}
    return publish.publish(spark, publish_root, built.published, data_version, checks, blocking, extra)
