"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample of the vectors is cut into balanced parts: a
tree of median splits, then moves towards the neighbours' parts while sizes stay
balanced. A small network with one hidden layer learns to tell a vector's part and
its neighbours' parts. It places every vector into its most probable part, and sends
each query to several parts, whose vectors are compared exactly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occuspan.llm.common import shared_folder, stage

SAMPLE = 10_000
PARTS = 64
# Vectors without clusters need most parts: on such data 46 of 64 find 94 in 100 neighbours, 16 find 61.
PROBED = 46
GRAPH_NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 25
UNEVENNESS = 1.05
BLOCK = 4096
LEAST_PART = 50


def usable(values: list | None, width: int | None = None) -> np.ndarray | None:
    if not values or any(v is None for v in values) or (width is not None and len(values) != width):
        return None
    vector = np.array(values, np.float64)
    return vector if np.isfinite(vector).all() and vector.any() else None


def nearest_in_sample(points: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each point, in blocks."""
    squares, found = (points**2).sum(1), []
    for at in range(0, len(points), 500):
        d = squares - 2 * points[at : at + 500] @ points.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        found.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(found)


def balanced_parts(points: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each point of the graph; no part has more than its even share times UNEVENNESS."""
    part = np.zeros(len(points), np.int64)
    todo = [(np.arange(len(points)), 0, parts)]
    while todo:
        own, first, n = todo.pop()
        if n == 1:
            part[own] = first
            continue
        centred = points[own] - points[own].mean(0)
        axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
        order = own[np.argsort(centred @ axis, kind="stable")]
        half = n // 2
        cut = len(own) * half // n
        todo += [(order[:cut], first, half), (order[cut:], first + half, n - half)]
    most = int(np.ceil(UNEVENNESS * len(points) / parts))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(points), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(points)), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        gain = votes.max(1) - votes[np.arange(len(points)), part]
        wish = votes.argmax(1)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[wish[i]] < most:
                sizes[part[i]] -= 1
                sizes[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(points: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """One hidden layer, trained on each point's own part and its neighbours' parts."""
    rng = np.random.default_rng(7)
    goal = np.zeros((len(points), parts))
    np.add.at(goal, (np.arange(len(points)), part), graph.shape[1])
    np.add.at(goal, (np.repeat(np.arange(len(points)), graph.shape[1]), part[graph].ravel()), 1)
    goal /= goal.sum(1, keepdims=True)
    mean, scale = points.mean(0), points.std(0) + 1e-9
    x = (points - mean) / scale
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            own = order[at : at + 128]
            hidden = np.maximum(x[own] @ layers[0] + layers[1], 0)
            logits = hidden @ layers[2] + layers[3]
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - goal[own]) / len(own)
            back = error @ layers[2].T * (hidden > 0)
            slopes = [x[own].T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            for w, m, v, g in zip(layers, first, second, slopes):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.002 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return mean, scale, *layers


def route(router: tuple[np.ndarray, ...], points: np.ndarray) -> np.ndarray:
    """Logits of the parts."""
    mean, scale, a, b, c, d = router
    return np.maximum((points - mean) / scale @ a + b, 0) @ c + d


def fit_sample(lists: list[list | None], parts: int) -> tuple | None:
    found = [v for x in lists if (v := usable(x)) is not None]
    if not found:
        return None
    lengths = [len(v) for v in found]
    width = max(sorted(set(lengths)), key=lengths.count)
    points = np.stack([v for v in found if len(v) == width])
    parts = max(1, min(parts, len(points) // LEAST_PART))
    if parts == 1:
        zero = np.zeros
        return (zero(width), np.ones(width), zero((width, 1)), zero(1), zero((1, 1)), zero(1)), 1, width
    graph = nearest_in_sample(points.astype(np.float32), GRAPH_NEIGHBOURS)
    return fit_router(points, graph, balanced_parts(points, graph, parts), parts), parts, width


def fit(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS) -> tuple | None:
    """(router, number of parts, width), from at most `sample` vectors chosen by a hash; None without a usable vector.

    The width is the most frequent length in the sample, the smaller one on a tie.
    One task holds the sample and learns; only the model, whose size is the parameters', reaches the driver.
    """
    chosen = vectors.filter(F.size("embedding") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_sample([x for batch in batches for x in batch.column(0).to_pylist()], parts)
        if model is not None:
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    learnt = chosen.coalesce(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(learnt[0].model) if learnt else None


def place(vectors: DataFrame, model: tuple, is_query: F.Column) -> DataFrame:
    """Usable vectors with their part; queries also with all parts, most probable first."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    source = vectors.select("vec_id", F.monotonically_increasing_id().alias("row"), F.coalesce(is_query, F.lit(False)).alias("q"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, _, width = sent.value
        for batch in batches:
            ids, rows, asks, lists = (c.to_pylist() for c in batch.columns)
            kept = [(i, r, q, v) for i, r, q, x in zip(ids, rows, asks, lists) if (v := usable(x, width)) is not None]
            if not kept:
                continue
            ids, rows, asks, found = zip(*kept)
            order = np.argsort(-route(router, np.stack(found)), axis=1, kind="stable").astype(np.int32)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(order[:, 0]), pa.array([o if q else None for o, q in zip(order, asks)], pa.list_(pa.int32())), pa.array([v.tobytes() for v in found], pa.binary())],
                names=["vec_id", "row", "part", "parts", "vector"],
            )

    return source.mapInArrow(run, "vec_id long, row long, part int, parts array<int>, vector binary")


def nearest_of_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k nearest candidates of this block for each query, by exact distance."""
    out = {"query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []}
    if queries.num_rows and candidates.num_rows:
        ids, rows = (np.array(candidates[c].to_pylist(), object if candidates[c].null_count else np.int64) for c in ("vec_id", "row"))
        points = np.frombuffer(b"".join(candidates["vector"].to_pylist())).reshape(len(rows), -1)
        tie = candidates["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        for q, at, vector in zip(*(queries[c].to_pylist() for c in ("vec_id", "row", "vector"))):
            distance = np.sqrt(((points - np.frombuffer(vector)) ** 2).sum(1))
            distance[rows == at] = np.inf
            near = np.flatnonzero(distance <= np.partition(distance, min(k, len(distance)) - 1)[min(k, len(distance)) - 1])
            near = near[np.isfinite(distance[near])]
            near = near[np.lexsort((rows[near], tie[near], distance[near]))[:k]]
            out["query_row"] += [at] * len(near)
            out["query_id"] += [q] * len(near)
            out["vec_id"] += ids[near].tolist()
            out["row"] += rows[near].tolist()
            out["score"] += distance[near].tolist()
    types = {"score": pa.float64()}
    return pa.table({n: pa.array(v, types.get(n, pa.int64())) for n, v in out.items()})


def search(vectors: DataFrame, is_query: F.Column, k: int = 10, probed: int = PROBED, sample: int = SAMPLE, parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows.

    Takes vec_id and embedding; other columns are not read. Vectors that are null,
    zero, of another length than most, or hold null or non-finite components take no
    part. Equal distances go by the smaller vec_id (null last), then by row. A row is
    never its own neighbour, a copy of it is. A query is sent to further parts while
    those it has hold too few vectors, so k are found wherever there are k. An empty
    table, or one without usable vectors, gives an empty table.
    """
    spark = vectors.sparkSession
    model = fit(vectors.select("vec_id", "embedding"), sample, parts)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    folder = shared_folder(spark)
    index = stage(place(vectors, model, is_query), folder, "index")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    asked = index.filter(F.col("parts").isNotNull())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for order in batch.column(2).to_pylist():
                held, n = 0, 0
                while n < len(order) and (n < probed or held < k + 1):
                    held += sizes.get(order[n], 0)
                    n += 1
                made.append(order[:n])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.list_(pa.int32())), batch.column(3)], names=["vec_id", "row", "parts", "vector"])

    kind = "vec_id long, row long, parts array<int>, vector binary"
    queries = asked.select("vec_id", "row", "parts", "vector").mapInArrow(choose, kind)
    queries = stage(queries.select("vec_id", "row", F.explode("parts").alias("part"), "vector"), folder, "queries")
    asks = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    # Large parts are dealt over blocks on both sides; every query block meets every candidate block.
    pieces = [F.lit(x) for p in range(model[1]) for x in (p, F.struct(F.lit(-(-sizes.get(p, 0) // BLOCK) or 1).alias("c"), F.lit(-(-asks.get(p, 0) // BLOCK) or 1).alias("q")))]
    blocks = F.create_map(*pieces)[F.col("part")]

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("row"), blocks[own])
        return rows.withColumn(f"{own}_block", mine.cast("int")).withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), blocks[other] - 1)))

    keys = ["part", "c_block", "q_block"]
    left = dealt(queries, "q", "c").select(*keys, "vec_id", "row", "vector").groupBy(*keys)
    right = dealt(index.join(F.broadcast(queries.select("part").distinct()), "part", "left_semi"), "c", "q").select(*keys, "vec_id", "row", "vector").groupBy(*keys)
    near = left.cogroup(right).applyInArrow(lambda a, b: nearest_of_block(a, b, k), "query_row long, query_id long, vec_id long, row long, score double")
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
