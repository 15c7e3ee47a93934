"""Mixing sources to target weights by drawing fixed-length blocks of tokens.

The documents of a source, end to end, are cut into blocks of a fixed number of
words. Output slots draw a source each from the target shares, which gives every
output shard multinomial source counts; slots a source got beyond its quota go to
sources below theirs. The k-th slot of a source, counted over the shards, takes the
block at place k of a pseudorandom permutation of the source's blocks, and blocks are
joined by their index. A block is therefore taken again only after all others of its
source, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.llm.common import SPACE, quoted, shared_folder, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
SLICES = 1024
LEAST_CELLS = 4096
ROUNDS = 6
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running(rows: DataFrame, group: str, slice_: str, order: list[str], weight: str, name: str) -> DataFrame:
    """Adds the group's weight ahead of each row: sums per slice, then rows inside a slice."""
    ahead = Window.partitionBy(group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(group, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    slices = rows.groupBy(group, slice_).agg(F.sum(weight).alias("__sum"))
    slices = slices.select(group, slice_, F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    local = rows.withColumn("__local", F.sum(weight).over(inside) - F.col(weight))
    return local.join(slices, [group, slice_]).withColumn(name, F.col("__ahead") + F.col("__local")).drop("__ahead", "__local")


def source_ranks(sizes: DataFrame, folder: str) -> DataFrame:
    """Sources by code point, null last, numbered from 0: numbers inside ranges, then the ranges' offsets."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = max(1, sizes.sparkSession.sparkContext.defaultParallelism)
    ranged = stage(sizes.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), folder, "ranges")
    inside = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    counts, offset = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}, 0
    starts = []
    for part in sorted(counts):
        starts += [F.lit(part), F.lit(offset)]
        offset += counts[part]
    first = F.create_map(*starts)[F.col("__part")] if starts else F.lit(0)
    return inside.withColumn("rank", (first + F.col("__in")).cast("long")).drop("__part", "__in")


def with_targets(ranked: DataFrame, folder: str, share: float, repeats: float, weights: tuple) -> DataFrame:
    """Adds each source's target: by weight, no more than `repeats` of its size, the excess dealt again.

    A source is full when its weight's part of what is left exceeds its bound; the
    parts only grow, so filling goes on until nobody is new. Only sums reach the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    table = stage(ranked.withColumn("weight", weight).withColumn("bound", F.col("source_size") * float(repeats)), folder, "weighed")
    want = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        free = F.col("bound") > F.col("weight") * level
        w, held = table.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, F.col("bound")))).first()
        new = (want - (held or 0.0)) / w if w else level
        if not w or new <= level:
            break
        level = new
    return table.withColumn("target", F.least(F.col("bound"), F.col("weight") * level))


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1, row by row: Feistel rounds over the next power of four, walked until inside."""
    half = np.ones(len(size), np.uint64)
    while (short := (np.uint64(1) << (half * np.uint64(2))) < size).any():
        half[short] += np.uint64(1)
    mask, value, todo = (np.uint64(1) << half) - np.uint64(1), index.copy(), np.arange(len(index))
    while len(todo):
        h, m, s = half[todo], mask[todo], seed[todo]
        left, right = value[todo] >> h, value[todo] & m
        for r in range(ROUNDS):
            mixed = (right + s + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & m)
        value[todo] = left << h | right
        todo = todo[value[todo] >= size[todo]]
    return value


def permute_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank, turn, blocks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in range(3))
        seed = (rank + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + turn // np.maximum(blocks, np.uint64(1))
        at = permuted(turn % np.maximum(blocks, np.uint64(1)), np.maximum(blocks, np.uint64(1)), seed)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(at.astype(np.int64))], names=["rank", "shard", "block"])


def draw_slots(spark, sources: DataFrame, folder: str, shard_slots: int) -> DataFrame:
    """rank, shard and turn of every slot; a source's turns count 0..quota-1 over the shards."""
    quotas = sources.filter("quota > 0").select("rank", "quota", (F.col("rank") % 64).alias("__slice")).withColumn("__all", F.lit(0))
    edges = stage(running(quotas, "__all", "__slice", ["rank"], "quota", "start"), folder, "edges")
    total = edges.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    # Each source owns an interval of the draws 0..total-1, met through equal cells of that range.
    # There are a few cells a source, so cells and their sources grow with the number of sources, not with the slots.
    cell = max(1, total // max(LEAST_CELLS, 4 * edges.count()))
    owned = edges.withColumn("end", F.col("start") + F.col("quota")).withColumn(
        "__cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)))
    )
    # Written, so that a broadcast is decided by what it holds and not by what it was made from.
    owned = stage(owned, folder, "owned")
    slots = spark.range(total).withColumn("shard", F.floor(F.col("id") / shard_slots))
    slots = slots.withColumn("draw", F.pmod(F.xxhash64(F.lit("slot"), "id"), F.lit(max(total, 1)))).withColumn("__cell", F.floor(F.col("draw") / cell))
    inside = (F.col("draw") >= F.col("start")) & (F.col("draw") < F.col("end"))
    drawn = slots.join(owned, "__cell").filter(inside).select("id", "shard", "rank", "quota")
    drawn = stage(running(drawn.withColumn("__one", F.lit(1).cast("long")), "rank", "shard", ["id"], "__one", "turn"), folder, "drawn")
    within = drawn.filter("turn < quota").select("rank", "shard", "turn")
    # Surplus slots and missing turns are equally many; both are numbered and meet by number.
    got = drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("got"))
    short = edges.select("rank", "quota").join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
    missing = short.select("rank", F.explode(F.sequence("got", F.col("quota") - 1)).alias("turn"))
    missing = missing.withColumn("__slice", F.pmod(F.xxhash64("rank", "turn"), F.lit(SLICES)))
    surplus = drawn.filter("turn >= quota").select("id", "shard").withColumn("__slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)))

    def number(rows, order):
        return running(rows.withColumn("__one", F.lit(1).cast("long")).withColumn("__all", F.lit(0)), "__all", "__slice", order, "__one", "number")

    again = number(surplus, ["id"]).select("number", "shard").join(number(missing, ["rank", "turn"]).select("number", "rank", "turn"), "number")
    return within.unionByName(again.select("rank", "shard", "turn"))


def mix_sources(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    counted: str | None = None,
) -> dict[str, DataFrame]:
    """The mix as tables: rows, sources, pieces, takes.

    rows: the input with __row, size (words) and source_rank; sources: rank, source,
    source_size, target, blocks, quota (slots); pieces: the part of each document in
    each block (__row, rank, block, from_word, words); takes: how often an output
    shard takes a block (rank, block, shard, times).

    Null sources form one source, ranked last. Texts without words (null, empty)
    have size 0, no piece, and are never taken; a source of such texts has target 0.
    Repeated rows are documents of their own. An empty table gives empty tables.
    Input columns named size or source_rank give way. Words are counted in text,
    unless `counted` names a column that holds their number already.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    names = [c for c in docs.columns if c.lower() not in ("size", "source_rank", "__row", "text") and c != counted]
    # All but the source have private names until the rows are returned.
    own = {c: "source" if c == "source" else f"__u{i}" for i, c in enumerate(names)}
    size = n_words(F.col("text")) if counted is None else quoted(counted)
    rows = docs.select(*(quoted(c).alias(u) for c, u in own.items()), size.alias("size"))
    rows = stage(rows.withColumn("__row", F.monotonically_increasing_id()), folder, "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = with_targets(source_ranks(sizes, folder), folder, share, repeats, weights)
    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    sources = stage(sources.withColumn("blocks", blocks).withColumn("quota", F.least(quota, F.col("blocks") * repeats)), folder, "sources")
    placed = rows.join(sources.select("source", "rank"), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = placed.withColumnRenamed("rank", "source_rank")
    sized = placed.filter("size > 0").select("__row", "rank", "size").withColumn("__slice", F.pmod(F.xxhash64("__row"), F.lit(SLICES)))
    laid = running(sized, "rank", "__slice", ["__row"], "size", "start").withColumn("end", F.col("start") + F.col("size"))
    pieces = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))))
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    last = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    pieces = pieces.select("__row", "rank", "block", (first - F.col("start")).alias("from_word"), (last - first).alias("words"))
    slots = draw_slots(spark, sources, folder, shard_slots).join(sources.select("rank", "blocks"), "rank")
    taken = slots.select("rank", "turn", "blocks", F.col("shard").cast("long")).mapInArrow(permute_blocks, "rank long, shard long, block long")
    takes = taken.groupBy("rank", "block", "shard").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.select(*(F.col(u).alias(c) for c, u in own.items()), "__row", "size", "source_rank")
    return {"rows": rows, "sources": sources, "pieces": pieces, "takes": takes}


def taken_words(mix: dict[str, DataFrame]) -> DataFrame:
    """Words the mix takes of each row, repeats counted: __row, taken."""
    times = mix["takes"].groupBy("rank", "block").agg(F.sum("times").alias("times"))
    joined = mix["pieces"].join(times, ["rank", "block"])
    return joined.groupBy("__row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix holds, with the columns of the input.

    A row comes once for the parts of it taken at least once, and once more for the
    parts taken at least twice, and so on; text is then those words, joined by single
    spaces where parts are missing, and the very text where all parts are there.
    """
    folder = shared_folder(docs.sparkSession)
    own = {c: c if c in ("source", "text") else f"__u{i}" for i, c in enumerate(docs.columns)}
    private = docs.select(*(quoted(c).alias(u) for c, u in own.items()), F.monotonically_increasing_id().alias("__own"))
    docs = stage(private, folder, "documents")
    slim = docs.select("__own", "source", n_words(F.col("text")).alias("__size"))
    mix = mix_sources(slim, counted="__size", **options)
    times = mix["takes"].groupBy("rank", "block").agg(F.sum("times").alias("times"))
    parts = mix["pieces"].join(times, ["rank", "block"]).select("__row", "from_word", "words", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    parts = parts.groupBy("__row", "copy").agg(F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("__parts"), F.sum("words").alias("__got"))
    chosen = parts.join(mix["rows"].select("__row", "__own", F.col("size").alias("__size")), "__row").select("__own", "__size", "__parts", "__got")
    rows = docs.join(chosen, "__own")
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice("__words", (p["from_word"] + 1).cast("int"), p["words"].cast("int")))), " ")
    # Inlined, a text is split once; as a projection it would be split again for each of its parts.
    split = F.struct(F.when(F.col("__got") < F.col("__size"), words).alias("__words"))
    partial = rows.select("*", F.inline(F.array(split)))
    text = F.when(F.col("__got") == F.col("__size"), F.col("text")).otherwise(cut)
    return partial.withColumn("text", text).select(*(F.col(u).alias(c) for c, u in own.items()))
