"""Writing results: versioned tables with one switch, and flat exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.functions import geo
from occuspan.operators.places import HISTORY_COLUMNS, PLACE_COLUMNS
from occuspan.operators.quality import drop_orphans
from occuspan.operators.regions import REGION_COLUMNS
from occuspan.operators.viewport import CURVE
from occuspan.session import shared_folder, stage

# Columns and sort keys of the published tables. No shop name is among them.
TABLES: dict[str, tuple[Sequence[str], Sequence[str]]] = {
    "places": (PLACE_COLUMNS, ("place_key",)),
    "place_history": (HISTORY_COLUMNS, ("place_key", "seq")),
    "region_stats": (REGION_COLUMNS, ("region_level", "region_code")),
}
PRIVATE_COLUMNS = {"name_norm", "display", "store_id", "own_store"}
# Published files of places follow a curve through the map instead of their key, so that
# a box of the map lies in few row groups; the place on the curve is one more column.
LAYOUT = {"places": (CURVE, "place_key")}
MANIFEST = "manifest"
MANIFEST_SCHEMA = "version long, data_version string, published_at timestamp, folder string"


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Globally sorted rows in evenly filled partitions, NULLs last."""
    last = [F.col(key).asc_nulls_last() for key in keys]
    return df.repartitionByRange(*last).sortWithinPartitions(*last)


def published_columns(name: str) -> list[Column]:
    """The fixed columns of a table; private columns can never be among them."""
    columns, _ = TABLES[name]
    leaked = PRIVATE_COLUMNS.intersection(columns)
    if leaked:
        raise ValueError(f"{name}: private columns {sorted(leaked)}")
    return [F.col(column) for column in columns]


def published_form(name: str, df: DataFrame) -> DataFrame:
    """A table as it is exported: fixed columns, fixed order."""
    return ordered(df.select(*published_columns(name)), TABLES[name][1])


def stored_form(name: str, df: DataFrame) -> DataFrame:
    """A table as it is published: laid out along the map where it has coordinates."""
    if name not in LAYOUT:
        return published_form(name, df)
    keyed = df.select(*published_columns(name), geo.curve_key(F.col("lng"), F.col("lat")).alias(CURVE))
    return ordered(keyed, LAYOUT[name])


def export_tables(tables: Mapping[str, DataFrame], folder: str, file_format: str = "parquet") -> None:
    """Write the published tables below a folder, as Parquet or as CSV with header."""
    for name, df in tables.items():
        writer = published_form(name, df).write.mode("errorifexists")
        if file_format == "csv":
            writer = writer.option("header", "true")
        writer.format(file_format).save(f"{folder}/{name}")


def _path(spark: SparkSession, name: str):
    """A path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/{MANIFEST}")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Published versions, none if nothing was published yet."""
    path, files = _path(spark, f"{root}/{MANIFEST}")
    if not files.exists(path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return _manifest(spark, root)


def _create(spark: SparkSession, name: str, text: str) -> bool:
    """Write a small file, unless there is one of that name."""
    path, files = _path(spark, name)
    try:
        stream = files.create(path, False)
    except Exception:  # the gateway wraps what differs from one file system to the next
        if files.exists(path):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def write_version(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], extra: Mapping[str, DataFrame] | None = None) -> str:
    """Write all tables into a folder of their own, which nobody reads yet, and return it."""
    missing = set(TABLES) - set(tables)
    if missing:
        raise ValueError(f"tables missing: {sorted(missing)}")
    folder = f"{root}/versions/{uuid.uuid4().hex}"
    for name, df in (extra or {}).items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    # Sorting by ranges reads its input twice; a stage keeps the joins before it from running twice.
    history = stage(drop_orphans(tables["place_history"], tables["places"]), shared_folder(spark), "kept_history")
    for name, df in {**tables, "place_history": history}.items():
        stored_form(name, df).write.mode("errorifexists").parquet(f"{folder}/{name}")
    return folder


def commit_version(spark: SparkSession, root: str, folder: str, data_version: str) -> int:
    """Make a written folder the newest version and return its number.

    A number belongs to whoever creates its claim first; the others try the next one.
    The manifest row then appears as a whole, by renaming a finished file. A
    publisher that dies in between leaves a number unused and the old version current.
    """
    newest = versions(spark, root).agg(F.max("version")).first()[0]
    version = 1 if newest is None else newest + 1
    while not _create(spark, f"{root}/claims/{version:08d}", folder):
        version += 1
    row = {"version": version, "data_version": data_version, "published_at": datetime.now(timezone.utc).isoformat(), "folder": folder}
    hidden, shown = f"{root}/{MANIFEST}/.{version:08d}", f"{root}/{MANIFEST}/{version:08d}.json"
    _create(spark, hidden, json.dumps(row) + "\n")
    source, files = _path(spark, hidden)
    if not files.rename(source, _path(spark, shown)[0]):
        raise RuntimeError(f"version {version} could not be made visible")
    return version


def publish(
    spark: SparkSession,
    root: str,
    tables: Mapping[str, DataFrame],
    data_version: str,
    checks: DataFrame | None = None,
    blocking: Sequence[str] | None = None,
    extra: Mapping[str, DataFrame] | None = None,
) -> int:
    """Publish all tables as one new version and return its number.

    ``extra`` tables (metadata, rows set aside) become visible with the version, too.

    Tables are written into a folder of their own first; the version becomes
    visible by one manifest file. Readers therefore see either the old tables
    or the new ones, a crash in between leaves the old version in place, and of several
    publishers at a time each gets a version. Failed checks (all, or those
    named in ``blocking``) stop the publication before anything is written.
    """
    missing = set(TABLES) - set(tables)
    if missing:
        raise ValueError(f"tables missing: {sorted(missing)}")
    if checks is not None:
        failed = checks.filter(~F.col("ok"))
        if blocking is not None:
            failed = failed.filter(F.col("check").isin(*blocking))
        names = [row["check"] for row in failed.select("check").collect()]  # one row per check
        if names:
            raise RuntimeError(f"not published, failed checks: {', '.join(sorted(names))}")
    return commit_version(spark, root, write_version(spark, root, tables, extra), data_version)


def version_folder(spark: SparkSession, root: str, version: int | None = None) -> str:
    """Folder of a published version, by default of the newest."""
    rows = _manifest(spark, root)
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    return rows.orderBy(F.col("version").desc()).select("folder").first()["folder"]


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest published version, with its fixed columns."""
    table = spark.read.parquet(f"{version_folder(spark, root)}/{name}")
    return table.select(*TABLES[name][0]) if name in TABLES else table


def current_map(spark: SparkSession, root: str) -> DataFrame:
    """Places of the newest version with their place on the curve, for requests by box."""
    return spark.read.parquet(f"{version_folder(spark, root)}/places")


def size_report(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes per table below a version folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    table = F.regexp_extract("path", r"/([^/]+)/[^/]+\z", 1)
    return files.groupBy(table.alias("table")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def export_diff(flat: DataFrame, path: str) -> None:
    """The flat comparison as CSV with header, in address order."""
    keys = ("sigungu", "road_address", "floor_label", "place_key", "chunk")
    ordered(flat, keys).write.mode("errorifexists").option("header", "true").csv(path)


def export_districts(flat: DataFrame, path: str) -> None:
    """One folder of JSON lines per district, each in address order.

    Ranges, not districts, are spread over the tasks, so a large district is
    written by several of them. Rows without a district are left out.
    """
    keys = ("sigungu", "road_address", "floor_label", "place_key", "chunk")
    known = flat.filter(F.col("sigungu").isNotNull())
    known = stage(known, shared_folder(flat.sparkSession), "districts")  # read twice, to sample ranges and to sort
    ordered(known, keys).write.mode("errorifexists").partitionBy("sigungu").json(path)


def load_over_jdbc(tables: Mapping[str, DataFrame], url: str, properties: Mapping[str, str]) -> None:
    """Refresh database tables in place; means are narrowed to single precision."""
    narrow = {"avg_tenure_months", "turnover_avg"}
    for name, df in tables.items():
        columns, _ = TABLES[name]
        casted = [F.col(c).cast("float").alias(c) if c in narrow else F.col(c) for c in columns]
        df.select(*casted).write.option("truncate", "true").mode("overwrite").jdbc(url, name, properties=dict(properties))
