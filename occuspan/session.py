"""Session settings the jobs count on, and the shared folder for stages."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Long generated methods are not compiled by the JVM and run many times slower;
# beyond this size Spark should generate one method per operator instead.
COMPILED_METHOD_BYTES = "8000"
DEFAULT_METHOD_BYTES = "65535"


def tune(spark: SparkSession) -> SparkSession:
    """Adaptive execution with skew handling, and compilable generated code."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", DEFAULT_METHOD_BYTES) == DEFAULT_METHOD_BYTES:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD_BYTES)
    return spark


def local_session(app: str, cores: str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores.

    A large input already has more splits and is returned as it is. Hashing
    whole rows, unlike dealing them out in turn, needs no sort to be repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *df.columns)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for stage tables, below the cluster's shared folder.

    Only a local session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return f"{root.rstrip('/')}/occuspan-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="occuspan-")


def stage(df: DataFrame, folder: str, name: str, codec: str | None = None) -> DataFrame:
    """Write a table several consumers read, and read it back.

    The rows are then fixed on shared storage: a lost executor costs a file
    read, not the plan behind it.
    """
    path = f"{folder}/{name}"
    df.write.mode("errorifexists").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_stage(df: DataFrame, folder: str, name: str, measures: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """A stage, and aggregates over its rows that the write itself collects.

    The rows are neither scanned nor shuffled for them. Over no rows a measure is missing
    or what its aggregate gives for none.
    """
    if not measures:
        return stage(df, folder, name), {}
    seen = Observation()
    columns = df.columns
    kept = stage(df.observe(seen, *[value.alias(measure) for measure, value in measures.items()]).select(*columns), folder, name)
    return kept, dict(seen.get)


def bucketed_stage(df: DataFrame, folder: str, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """A stage in buckets of a key, sorted inside; tables alike in both join on it without a shuffle.

    All rows of a key are in one bucket: use it where their number is bounded. The table
    is known to this session's catalog by a name of its own, its files lie in the folder.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(count, key).write.format("parquet").bucketBy(count, key).sortBy(key)
    writer.option("path", f"{folder}/{name}").saveAsTable(table)
    return spark.table(table)
