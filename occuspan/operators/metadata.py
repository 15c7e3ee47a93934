"""Key/value metadata about a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The keys a reader looks for.
META_KEYS = ("latest_quarter", "coverage", "data_version")


def build_metadata(stamps: DataFrame) -> DataFrame:
    """Metadata rows of builds.

    ``stamps`` has latest_quarter, coverage and built_at (timestamp); the data
    version joins the quarter and the build date.
    """
    version = F.concat("latest_quarter", F.lit("+"), F.date_format("built_at", "yyyy-MM-dd"))
    pairs = F.array(
        F.struct(F.lit("latest_quarter").alias("key"), F.col("latest_quarter").alias("value")),
        F.struct(F.lit("coverage").alias("key"), F.col("coverage").alias("value")),
        F.struct(F.lit("data_version").alias("key"), version.alias("value")),
    )
    return stamps.select(F.inline(pairs), F.col("built_at").alias("updated_at"))


def upsert_metadata(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest value per key; on equal times the incoming row wins."""
    newest = Window.partitionBy("key").orderBy(
        F.col("updated_at").desc_nulls_last(), F.col("is_new").desc(), F.col("value")
    )
    rows = current.withColumn("is_new", F.lit(0)).unionByName(incoming.withColumn("is_new", F.lit(1)))
    return rows.withColumn("rank", F.row_number().over(newest)).filter("rank = 1").select("key", "value", "updated_at")


def metadata_record(meta: DataFrame) -> DataFrame:
    """The metadata rows as one row with a column per known key."""
    return meta.agg(*[F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in META_KEYS])
