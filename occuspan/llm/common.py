"""Helpers the operators of this subpackage share.

Words are runs of bytes outside space and 0x09-0x0D; bytes.split() cuts exactly
there and bytes.lower() lowers A-Z alone, so texts go to Python as binary.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occuspan import session
from occuspan.session import shared_folder

__all__ = ["BLOCK_KIND", "SPACE", "add_text_columns", "ascii_lower", "block_batch", "give_back", "id_remainder", "quoted", "shared_folder", "sheltered", "stage", "sum_blocks", "table"]

SPACE = r"[\x20\x09-\x0D]+"
TEXT = "__text_bytes"
# Rows whose texts and results a Python worker holds together.
ROWS_AT_ONCE = 1000
ARROW = {
    "long": (T.LongType(), pa.int64()),
    "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()),
    "array<int>": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "array<long>": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "array<binary>": (T.ArrayType(T.BinaryType()), pa.list_(pa.binary())),
}


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A written table that is read back; hashes and word lists stay for long, so they are packed well."""
    return session.stage(df, folder, name, "zstd")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def add_text_columns(
    docs: DataFrame,
    make: Callable[[], Callable[[list[bytes]], list]],
    fields: list[tuple[str, str]],
    keep: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """The kept columns of each row and what a function makes of its text.

    make() runs once a task and returns the function, which gets a batch of texts
    (null as empty) and returns one list per field. All columns are kept by
    default; a kept column with the name of a new field gives way to it.
    """
    new = {name.lower() for name, _ in fields}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    # Names with dots don't pass through Arrow functions.
    own = [f"__c{i}" for i in range(len(keep))]
    kept = [T.StructField(o, docs.schema[c].dataType) for o, c in zip(own, keep, strict=True)]
    schema = T.StructType(kept + [T.StructField(n, ARROW[t][0]) for n, t in fields])
    names, types = schema.names, [ARROW[t][1] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for start in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                texts = [t or b"" for t in batch.column(len(keep)).to_pylist()]
                made = [pa.array(v, t) for v, t in zip(work(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)
        give_back()

    given = docs.select(*(quoted(c).alias(o) for c, o in zip(keep, own, strict=True)), quoted(text).cast("binary").alias(TEXT))
    return given.mapInArrow(run, schema).select(*(F.col(o).alias(c) for c, o in zip(keep, own, strict=True)), *(n for n, _ in fields))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def sheltered(
    docs: DataFrame, needed: dict[str, str], results: list[str], run: Callable[[DataFrame], DataFrame], keep: list[str] | None = None
) -> DataFrame:
    """What run makes of docs, safe from the names of the caller's columns.

    run gets the needed columns under the names it knows them by, all others under
    private ones, and must hand the private ones on. They get their own names back, in
    their order, before the results; kept columns named like a result give way.
    """
    taken = {r.lower() for r in results}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    known = {own: name for name, own in needed.items()}
    private = {c: known.get(c, f"__u{i}") for i, c in enumerate(kept)}
    columns = {name: own for name, own in needed.items()} | {name: c for c, name in private.items()}
    found = run(docs.select(*(quoted(c).alias(name) for name, c in columns.items())))
    return found.select(*(F.col(name).alias(c) for c, name in private.items()), *results)


def give_back() -> None:
    """Return memory that a task has freed: its Python worker lives on, idle or in the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's allocator can
        ctypes.CDLL(None).malloc_trim(0)


BLOCK_KIND = "block int, data binary"


def zlib_pack(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def block_batch(block: int, data: np.ndarray, pack: Callable[[bytes], bytes] = zlib_pack) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block], pa.int32()), pa.array([pack(data.tobytes())], pa.binary())], names=["block", "data"])


def sum_blocks(parts: DataFrame, dtype: str, pack: Callable[[bytes], bytes] = zlib_pack, unpack: Callable[[bytes], bytes] = zlib.decompress) -> DataFrame:
    """Adds up what tasks counted per block of an array; one block is held at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(unpack(packed), dtype)
                if block == at:
                    total = total + data
                    continue
                if at is not None:
                    yield block_batch(at, total, pack)
                at, total = block, data
        if at is not None:
            yield block_batch(at, total, pack)
        give_back()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, BLOCK_KIND)
