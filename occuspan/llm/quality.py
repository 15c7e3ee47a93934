"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Features of a text are its words, pairs of words, pairs and triples of word shapes
(letters, digits and symbols only), and a few words about the whole text (length,
share of different words, share of words equal to their predecessor), all hashed
into one table of weights. Training follows the regularised leader coordinate by
coordinate over a bounded sample of labelled texts. Scoring is one sparse dot
product per text with a weight table of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occuspan.llm.common import add_text_columns, id_remainder

TABLE_BITS = 20
# At most so many labelled texts are used for training, chosen by a hash of their id.
TRAINING_ROWS = 8000
PASSES = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.0
ACCEPTED = 0.3
SHAPES = bytes(
    ord("a") if chr(i).islower() or i >= 0x80 else ord("A") if chr(i).isupper() else ord("0") if chr(i).isdigit() else i for i in range(256)
)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def features(data: bytes, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table and their values, of unit length together."""
    words = data.lower().split()
    n = len(words)
    shift = np.uint64(64 - bits)
    h, s = hashed(words), hashed(data.translate(SHAPES).split())
    same = int((h[1:] == h[:-1]).sum()) if n else 0
    about = [b"size %d" % n.bit_length(), b"different %d" % (10 * len(set(words)) // max(n, 1)), b"same %d" % (20 * same // max(n, 1)), b"bias"]
    parts = [
        h * ODD[0],
        (h[:-1] * ODD[1] + h[1:]) * ODD[0],
        (s[:-1] * ODD[2] + s[1:]) * ODD[1],
        ((s[:-2] * ODD[1] + s[1:-1]) * ODD[2] + s[2:]) * ODD[0],
    ]
    where, times = np.unique(np.concatenate(parts) >> shift, return_counts=True)
    value = np.log1p(times)
    value = value / (np.sqrt((value**2).sum()) or 1.0)
    where = np.concatenate([where, hashed(about) * ODD[2] >> shift]).astype(np.int64)
    return where, np.concatenate([value, np.full(len(about), 0.5)])


def probability(weights: np.ndarray, where: np.ndarray, value: np.ndarray) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(float(weights[where] @ value), -35, 35)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = TABLE_BITS, passes: int = PASSES) -> np.ndarray:
    """FTRL-proximal; without rows all weights are 0 and every score is a half."""
    z, squares = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights_at(where):
        part = z[where]
        full = -(part - np.sign(part) * L1) / ((BETA + np.sqrt(squares[where])) / ALPHA + L2)
        return np.where(np.abs(part) <= L1, 0.0, full)

    for _ in range(passes):
        for label, where, value in rows:
            w = weights_at(where)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
            slope = (p - label) * value
            more = squares[where] + slope**2
            z[where] += slope - (np.sqrt(more) - np.sqrt(squares[where])) / ALPHA * w
            squares[where] = more
    return weights_at(np.arange(1 << bits)).astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, bits: int) -> DataFrame:
    """The features of at most `most` labelled texts of docs: turn (a hash of the id), label, at, value."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # Labels of other documents take none of the `most` places.
    held = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = known.join(held, "doc_id", "left_semi").withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(most)
    # Bounded by `most`; copies of an id meet before they count.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label", "turn").agg(F.min("text").cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, classes, data = (batch.column(i) for i in range(3))
            made = [features(t, bits) for t in data.to_pylist()]
            where, value = ([x[i].astype(t).tobytes() for x in made] for i, t in ((0, np.int32), (1, np.float32)))
            yield pa.RecordBatch.from_arrays([turns, classes, pa.array(where, pa.binary()), pa.array(value, pa.binary())], names=["turn", "label", "at", "value"])

    return texts.select("turn", "label", "text").mapInArrow(pack, "turn long, label int, at binary, value binary")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS, bits: int = TABLE_BITS) -> np.ndarray:
    """Weights from the documents whose id's remainder by 5 is not 0.

    One task learns from the bounded rows, in the order of their ids' hashes; only the
    weights, 4 bytes for each of 2**bits places, come to the driver.
    """
    learnt = docs.filter(id_remainder(F.col("doc_id"), 5) != 0)
    rows = training_rows(learnt, labels, label, most, bits).repartition(1).sortWithinPartitions("turn", "at")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [
            (label, np.frombuffer(at, np.int32), np.frombuffer(value, np.float32))
            for batch in batches
            for label, at, value in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
        ]
        yield pa.record_batch([pa.array([train(seen, bits).tobytes()], pa.binary())], names=["weights"])

    learned = rows.mapInArrow(learn, "weights binary").first()
    return train([], bits) if learned is None else np.frombuffer(bytes(learned.weights), np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, accepted: float = ACCEPTED, keep: list[str] | None = None) -> DataFrame:
    """Every document with score (0 to 1) and predicted (1 from `accepted` on).

    Scores come from the text alone. A null or empty text is scored by what the model
    learnt of texts without words. Repeated rows score alike; extra columns stay, ones
    named like a result give way. An empty table gives an empty table; without usable
    labels every score is a half.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    bits = len(weights).bit_length() - 1

    def make():
        known = sent.value

        def work(texts: list[bytes]) -> list:
            scores = [probability(known, *features(t, bits)) for t in texts]
            return [scores, [int(s >= accepted) for s in scores]]

        return work

    return add_text_columns(docs, make, [("score", "double"), ("predicted", "int")], keep)
