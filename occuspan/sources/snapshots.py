"""Snapshot CSV files: discovery, header-wise reading, label checks."""

from __future__ import annotations

import csv
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occuspan.functions.periods import BASE_YEAR, month_to_label, ordinal_of, to_ordinal
from occuspan.operators.normalize import OPTIONAL, PERIOD, REQUIRED, drop_report

# What data files are called, the keyword for full coverage, the
# prefix of files that are not data, and the dialect.
FILE_KEYWORD = "상가(상권)정보"
ALL_COVERAGE = "전국"
HIDDEN_PREFIX = "._"
DIALECT = {"header": "true", "sep": ",", "quote": '"', "escape": '"', "encoding": "UTF-8"}

CORRUPT = "_corrupt_record"
DIRECTORY = r"/(?:[^/=]+=)?(\d{4}Q[1-4])/[^/]*\z"
# A file is one split, and a split of its own, where only its first line is read.
WHOLE_FILE_BYTES = str(1 << 50)
# Lines set aside stop a build beyond this share of all lines.
MOST_MALFORMED = 0.01


def file_names(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Path and size of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(root).select("path", "length")


def directory_label(path: Column) -> Column:
    """Period label of the folder a file lies in, with or without ``name=``."""
    return F.nullif(F.regexp_extract(path, DIRECTORY, 1), F.lit(""))


def _named(name: Column, part: str) -> Column:
    """Does a file name hold a text? Some file systems return Hangul decomposed."""
    forms = sorted({unicodedata.normalize(form, part) for form in ("NFC", "NFD")})
    return reduce(Column.__or__, [name.contains(form) for form in forms])


def data_files(
    spark: SparkSession,
    root: str,
    coverage: str = ALL_COVERAGE,
    keyword: str = FILE_KEYWORD,
    pattern: str = "*.csv",
) -> DataFrame:
    """Data files of a coverage: path, length and period label; direct children of the period folders.

    Names are compared where they are listed; files of other provinces go no further.
    """
    listed = file_names(spark, root, pattern).withColumn("label", directory_label(F.col("path")))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    below = F.substring("path", len(top) + 1, 1 << 20)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    data = F.col("path").startswith(top) & below.rlike(r"^/[^/]+/[^/]+\z") & F.col("label").isNotNull()
    data &= ~name.startswith(HIDDEN_PREFIX) & _named(name, keyword)
    return listed.filter(data if coverage == ALL_COVERAGE else data & _named(name, coverage))


def available(
    spark: SparkSession,
    root: str,
    coverage: str = ALL_COVERAGE,
    keyword: str = FILE_KEYWORD,
    pattern: str = "*.csv",
) -> dict[str, list[str]]:
    """The data files of a coverage per period label, in period order: what a scan will be told to read."""
    found: dict[str, list[str]] = {}
    for row in data_files(spark, root, coverage, keyword, pattern).select("label", "path").orderBy("path").collect():
        found.setdefault(row["label"], []).append(row["path"])
    return dict(sorted(found.items(), key=lambda item: ordinal_of(item[0])))


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a partition; the rest of it is not read."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path as a scan writes it, first line) of every file that has one, by one job.

    Every file is a task, which stops after its first line. The job runs in a session of
    its own, so that the caller's settings stay as they are.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", WHOLE_FILE_BYTES)
    own.conf.set("spark.sql.files.openCostInBytes", WHOLE_FILE_BYTES)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    lines = own.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.mapInArrow(_first_line, "path string, value string")


def file_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Header of every file; an empty file has none."""
    to_path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def same(uri: str) -> str:
        """An empty authority is written with three slashes or with one."""
        return re.sub(r"^([^:/]+):///", r"\1:/", uri)

    lines = {same(row["path"]): row["value"] for row in first_lines(spark, paths).collect()}
    found = {}
    for path in paths:
        whole = to_path(path).getFileSystem(conf).makeQualified(to_path(path))
        line = lines.get(same(whole.toUri().toString()), "").removeprefix("\ufeff")
        names = next(csv.reader([line], delimiter=DIALECT["sep"], quotechar=DIALECT["quote"]), [])
        found[path] = tuple(name or f"_c{i}" for i, name in enumerate(names))
    return found


def require_columns(
    files: Mapping[str, Sequence[str]], headers: Mapping[str, Sequence[str]], required: Sequence[str] = REQUIRED
) -> None:
    """Stop when a period lacks a required column in all of its files."""
    for label, paths in files.items():
        present = {column for path in paths for column in headers[path]}
        missing = [column for column in required if column not in present]
        if missing:
            raise ValueError(f"{label}: required columns missing: {', '.join(missing)}")


def read_snapshots(
    spark: SparkSession,
    files: Mapping[str, Sequence[str]],
    base_year: int = BASE_YEAR,
    multi_line: bool = False,
) -> DataFrame:
    """All snapshot files as text columns, with the period ordinal of their folder.

    A single CSV read binds columns by position of the first header, so files
    are read once per distinct header and joined by column name. Lines that do
    not fit their header are kept apart in ``_corrupt_record``.
    """
    paths = [path for group in files.values() for path in group]
    if not paths:
        raise ValueError("no snapshot files")
    headers = file_headers(spark, paths)
    require_columns(files, headers)
    alike: dict[tuple[str, ...], list[str]] = {}
    for path, header in headers.items():
        alike.setdefault(header, []).append(path)
    wanted = (*REQUIRED, *OPTIONAL)
    # The file paths of a scan are URL-encoded.
    label = directory_label(F.url_decode(F.col("_metadata.file_path")))
    parts = []
    for header, members in alike.items():
        fields = [T.StructField(column, T.StringType()) for column in (*header, CORRUPT)]
        # With pruned columns Spark would judge a line by the columns asked for.
        options = {**DIALECT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"}
        options["multiLine"] = str(multi_line)
        rows = spark.read.options(**options).schema(T.StructType(fields)).csv(members)
        kept = [F.col(column) for column in wanted if column in header]
        parts.append(rows.select(to_ordinal(label, base_year).alias(PERIOD), *kept, CORRUPT))
    joined = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)
    absent = [F.lit(None).cast("string").alias(column) for column in wanted if column not in joined.columns]
    return joined.select("*", *absent)


def well_formed(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed(snapshots: DataFrame) -> DataFrame:
    """Lines set aside while reading, with their period.

    Spark refuses to read the corrupt-record column alone, hence the test on a
    second column, which always holds.
    """
    other = F.length(F.coalesce(F.col(REQUIRED[0]), F.lit(""))) >= 0
    return snapshots.filter(F.col(CORRUPT).isNotNull() & other).select(PERIOD, CORRUPT)


def read_report(snapshots: DataFrame) -> DataFrame:
    """Lines read, set aside as malformed, dropped as unusable and rows kept, per period."""
    bad = malformed(snapshots).groupBy(PERIOD).agg(F.count(F.lit(1)).alias("bad"))
    joined = drop_report(well_formed(snapshots)).join(bad, PERIOD, "full")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("total", "dropped", "kept", "bad")}
    return joined.select(PERIOD, (n["total"] + n["bad"]).alias("total"), n["bad"].alias("malformed"), n["dropped"].alias("dropped"), n["kept"].alias("kept"))


def read_checks(report: DataFrame, paths: DataFrame, most_malformed: float = MOST_MALFORMED) -> DataFrame:
    """check, ok, detail: the share of lines set aside, and file names against their folders."""
    sums = report.agg(F.coalesce(F.sum("malformed"), F.lit(0)).alias("bad"), F.coalesce(F.sum("total"), F.lit(0)).alias("n"))
    share = sums.select(
        F.lit("malformed_lines").alias("check"),
        (F.col("bad") <= F.col("n") * most_malformed).alias("ok"),
        F.concat_ws("/", "bad", "n").alias("detail"),
    )
    wrong = check_labels(paths).agg(F.count_if(~F.coalesce("ok", F.lit(True))).alias("wrong"))
    labels = wrong.select(F.lit("file_labels").alias("check"), (F.col("wrong") == 0).alias("ok"), F.col("wrong").cast("string").alias("detail"))
    return share.unionByName(labels)


def covered(rows: DataFrame, name_column: str, coverage: str = ALL_COVERAGE) -> DataFrame:
    """Rows of one province, or all rows."""
    return rows if coverage == ALL_COVERAGE else rows.filter(F.col(name_column).contains(coverage))


def check_labels(paths: DataFrame) -> DataFrame:
    """Compare the month in each file name with the period of its folder.

    Takes a column ``path``; ``ok`` is NULL when the name carries no month.
    """
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    year, month = F.regexp_extract(name, r"(20\d{2})(\d{2})", 1), F.regexp_extract(name, r"(20\d{2})(\d{2})", 2)
    content = month_to_label(year, month.try_cast("int"))
    return paths.select("path", directory_label(F.col("path")).alias("label"), content.alias("content_label")).select(
        "*", (F.col("label") == F.col("content_label")).alias("ok")
    )
