"""Repeated lines: two Bloom filters pick suspects, only those are counted exactly.

A line's key is the line without blanks at both ends, A-Z lowered. Every task notes
the keys of its documents in a filter of keys seen once and, when a key comes again,
in a filter of keys seen twice. Merging two tasks' filters makes the bits both have
in "once" part of "twice". Only keys that the merged second filter knows are
shuffled, counted by document exactly, and dropped if enough documents hold them.

The filters have a fixed size. A fuller filter only sends more lines to the exact
count; no line is missed. Tasks send compressed segments, and their number is
bounded, so that the traffic of filters is bounded too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occuspan.llm.common import add_text_columns, shared_folder, sheltered, stage

BLANKS = b" \t\n\x0b\x0c\r"
FILTER_BITS = 1 << 26
FILTER_TASKS = 4096
PROBES = 3
SEGMENT_BYTES = 1 << 17
# Up to so many repeated keys go to every task as 32-byte digests; more are joined.
BROADCAST_KEYS = 1 << 20
COUNTED_AT_ONCE = 200_000


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(BLANKS).lower() for line in text.split(b"\n")]


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def long_enough(key: bytes, least: int) -> bool:
    """At least so many code points: bytes that don't continue a code point."""
    return len(key) >= least and (least <= 1 or sum((b & 0xC0) != 0x80 for b in key) >= least)


class Filters:
    """Keys seen once and keys seen twice, as bits."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) % np.uint64(self.bits) for i in range(PROBES)])

    def known(self, bits: np.ndarray, places: np.ndarray) -> np.ndarray:
        return ((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    def mark(self, bits: np.ndarray, places: np.ndarray) -> None:
        flat = places.ravel()
        np.bitwise_or.at(bits, flat >> np.uint64(3), np.uint8(1) << (flat & np.uint64(7)).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        """A batch of keys, each once per document."""
        found, times = np.unique(hashes, return_counts=True)
        places = self.places(found)
        again = (times > 1) | self.known(self.once, places)
        self.mark(self.twice, places[:, again])
        self.mark(self.once, places)


def hashes_of(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def seen_twice(docs: DataFrame, least: int, bits: int, text: str) -> bytes:
    """The merged filter of keys seen twice; its size is the parameter's."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(bits)
        for batch in batches:
            keys = [k for t in batch.column(0).to_pylist() for k in set(line_keys(t or b"")) if long_enough(k, least)]
            own.add(hashes_of(keys))
        for number in range(0, bits // 8 // SEGMENT_BYTES or 1):
            part = slice(number * SEGMENT_BYTES, (number + 1) * SEGMENT_BYTES)
            if own.once[part].any():
                packed = [[zlib.compress(x[part].tobytes(), 1)] for x in (own.once, own.twice)]
                yield pa.record_batch([pa.array([number], pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments come sorted; one is held at a time."""
        at, once, twice = None, None, None

        def done():
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["segment", "twice"])

        for batch in batches:
            for number, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if number != at:
                    if at is not None:
                        yield done()
                    at, once, twice = number, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if at is not None:
            yield done()

    parts = docs.select(F.col(text).cast("binary")).coalesce(FILTER_TASKS).mapInArrow(fill, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row.twice), np.uint8)
        whole[row.segment * SEGMENT_BYTES : row.segment * SEGMENT_BYTES + len(part)] = part
    return whole.tobytes()


def suspects(keys: list[bytes], least: int, bits: int, twice: np.ndarray) -> list[bytes]:
    """Of distinct keys, those the filter knows."""
    keys = [k for k in keys if long_enough(k, least)]
    if not keys:
        return keys
    test = Filters.__new__(Filters)
    test.bits = bits
    return [k for k, hit in zip(keys, test.known(twice, test.places(hashes_of(keys))), strict=True) if hit]


def repeated_keys(docs: DataFrame, least: int, min_docs: int, bits: int, text: str, doc_id: str) -> DataFrame:
    """Keys that at least min_docs documents hold: digest, n_docs, first_doc."""
    sent = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, least, bits, text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, n, first = np.frombuffer(sent.value, np.uint8), Counter(), {}

        def out():
            keys = list(n)
            return pa.record_batch([pa.array(keys, pa.binary()), pa.array([n[k] for k in keys], pa.int64()), pa.array([first.get(k) for k in keys], pa.int64())], names=["key", "n", "first_doc"])

        for batch in batches:
            for at, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in suspects(list(set(line_keys(t or b""))), least, bits, twice):
                    n[k] += 1
                    if at is not None and at < first.get(k, at + 1):
                        first[k] = at
            if len(n) > COUNTED_AT_ONCE:
                yield out()
                n, first = Counter(), {}
        if n:
            yield out()

    slim = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
    counted = slim.mapInArrow(count, "key binary, n long, first_doc long").groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first_doc").alias("first_doc"))
    found = counted.filter(F.col("n_docs") >= min_docs)
    return found.select(F.unhex(F.sha2("key", 256)).alias("digest"), "n_docs", "first_doc")


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    filter_bits: int = FILTER_BITS,
    broadcast_keys: int = BROADCAST_KEYS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The documents without lines whose key at least min_docs documents hold.

    Adds n_lines (before) and n_dropped; all other columns stay, but columns of these
    two names give way. keep="first" leaves the first line of a key in the document
    with the smallest id; where no document has an id, each keeps it. A key counts once per row, however often the row repeats
    it; repeated rows count as documents of their own. A null or empty text is one
    empty line, which is never dropped as its key is shorter than one code point;
    a null text comes out empty. An empty table gives an empty table.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep: none or first, not {keep}")
    least = max(1, min_chars)

    def run(inner: DataFrame) -> DataFrame:
        return without_repeats(inner, min_docs, least, keep, filter_bits, broadcast_keys, "text", "doc_id")

    return sheltered(docs, {"text": text, "doc_id": doc_id}, ["n_lines", "n_dropped"], run)


def without_repeats(docs, min_docs, least, keep, filter_bits, broadcast_keys, text, doc_id) -> DataFrame:
    """dedup_lines over columns whose names clash with none in here."""
    folder = shared_folder(docs.sparkSession)
    repeated = stage(repeated_keys(docs, least, min_docs, filter_bits, text, doc_id), folder, "repeated")
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    if repeated.count() <= broadcast_keys:
        firsts = {bytes(r.digest): r.first_doc for r in repeated.collect()}
        return drop_known(docs, docs.sparkSession.sparkContext.broadcast(firsts), least, keep, rest, text, doc_id)
    return drop_joined(docs, repeated, folder, least, keep, rest, text, doc_id)


def cut(data: bytes, gone: set[int]) -> tuple[str, int, int]:
    lines = data.split(b"\n")
    kept = data if not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone)
    return kept.decode("utf-8", "replace"), len(lines), len(gone)


def drop_known(docs, sent, least, keep, rest, text, doc_id) -> DataFrame:
    """Every task knows the digests of all repeated keys."""

    def make():
        firsts = sent.value

        def work(packed: list[bytes]) -> list:
            made = []
            for data in packed:
                mark, _, data = data.partition(b":")
                gone, seen = set(), set()
                for i, k in enumerate(line_keys(data)):
                    if long_enough(k, least) and (d := digest(k)) in firsts:
                        if keep == "first" and (int(mark) if mark else None) == firsts[d] and d not in seen:
                            seen.add(d)
                        else:
                            gone.add(i)
                made.append(cut(data, gone))
            return [list(x) for x in zip(*made, strict=True)] if made else [[], [], []]

        return work

    # The id rides ahead of the text, so that one function serves both ways of keeping.
    source = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    marked = docs.withColumn("__marked", source)
    fields = [(text, "string"), ("n_lines", "long"), ("n_dropped", "long")]
    return add_text_columns(marked, make, fields, [c for c in rest if c != text], "__marked").select(*rest, "n_lines", "n_dropped")


def drop_joined(docs, repeated, folder, least, keep, rest, text, doc_id) -> DataFrame:
    """Too many repeated keys for every task: lines meet them in a join, rows keep a fixed number."""
    numbered = stage(docs.select(*rest).withColumn("__row", F.monotonically_increasing_id()), folder, "numbered")

    def make():
        def work(texts: list[bytes]) -> list:
            return [[[digest(k) if long_enough(k, least) else None for k in line_keys(t)] for t in texts]]

        return work

    lines = add_text_columns(numbered, make, [("__digests", "array<binary>")], ["__row", doc_id], text)
    lines = lines.select("__row", F.col(doc_id).alias("__doc"), F.posexplode("__digests").alias("__line", "digest"))
    gone = lines.join(repeated, "digest")
    if keep == "first":
        gone = gone.withColumn("__first", F.min("__line").over(Window.partitionBy("__row", "digest")))
        gone = gone.filter(~(F.col("__doc").eqNullSafe(F.col("first_doc")) & (F.col("__line") == F.col("__first"))))
    gone = gone.groupBy("__row").agg(F.collect_set("__line").alias("__gone"))
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    kept = F.filter(F.col("__parts"), lambda _, i: ~F.array_contains(F.col("__list"), i))
    whole = numbered.join(gone, "__row", "left").withColumn("__parts", parts).withColumn("__list", F.coalesce("__gone", F.array().cast("array<int>")))
    made = whole.withColumn(text, F.array_join(kept, "\n")).withColumn("n_lines", F.size("__parts").cast("long")).withColumn("n_dropped", F.size("__list").cast("long"))
    return made.select(*rest, "n_lines", "n_dropped")

