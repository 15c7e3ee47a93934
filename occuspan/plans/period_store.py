"""A store that grows by periods: normalized rows by period, and the stays that follow from them.

Below its root lie ``stores``, partitioned by period, and ``spans``, in versions. A
delivery normalizes its own rows only and replaces the partitions of its periods. Stays
are computed anew for the (shop, place) keys that the delivery touches, from these keys'
rows of all periods; all other stays are taken over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.operators import normalize, timeline
from occuspan.session import shared_folder, stage
from occuspan.sinks import publish

KEY = ["store_id", "place_key"]
FILES_PER_PERIOD = 16


def stored_rows(spark: SparkSession, root: str) -> DataFrame:
    """Normalized rows of all periods."""
    rows = spark.read.parquet(f"{root}/stores")
    return rows.select(*[F.col(c).cast("int") if c == normalize.PERIOD else F.col(c) for c in normalize.STORE_COLUMNS])


def current_spans(spark: SparkSession, root: str) -> DataFrame | None:
    """Stays of the newest version; None before the first delivery."""
    if publish.versions(spark, f"{root}/spans").isEmpty():
        return None
    return spark.read.parquet(publish.version_folder(spark, f"{root}/spans"))


def touched_keys(rows: DataFrame, spans: DataFrame | None) -> DataFrame:
    """Keys whose stays a delivery may change: those in it, and those that were present in its periods.

    The second kind is read off the stays, not off the replaced partitions: a delivery
    that was broken off after replacing them can be repeated.
    """
    keys = rows.select(*KEY)
    if spans is None:
        return keys.distinct()
    periods = rows.select(normalize.PERIOD).distinct()
    present = spans.select(*KEY, F.explode(F.sequence("start_q", "end_q")).alias(normalize.PERIOD))
    return keys.unionByName(present.join(periods, normalize.PERIOD, "left_semi").select(*KEY)).distinct()


def append_period(spark: SparkSession, root: str, raw: DataFrame) -> int:
    """Add or replace the periods that ``raw`` holds rows of; returns the version of the stays.

    A period without usable rows stays as it is. Deliveries to one root follow each other;
    readers of the stays see a delivery when all of it is written.
    """
    folder = shared_folder(spark)
    rows = stage(normalize.stores(raw), folder, "delivered")
    before = current_spans(spark, root)
    keys = stage(touched_keys(rows, before), folder, "touched")
    by_period = rows.repartition(normalize.PERIOD, F.pmod(F.xxhash64(*KEY), F.lit(FILES_PER_PERIOD)))
    by_period.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(normalize.PERIOD).parquet(f"{root}/stores")
    spans = timeline.spans(stored_rows(spark, root).join(keys, KEY, "left_semi"))
    if before is not None:
        spans = spans.unionByName(before.join(keys, KEY, "left_anti"))
    written = f"{root}/spans/versions/{uuid.uuid4().hex}"
    spans.write.mode("errorifexists").parquet(written)
    newest = rows.agg(F.max(normalize.PERIOD)).first()[0]
    return publish.commit_version(spark, f"{root}/spans", written, str(newest))
