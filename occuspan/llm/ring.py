"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A ring of cells carries the virtual nodes of every shard. A row's hash names its
cell, and going clockwise from there the shards in the order they are met. In each
round, rows without a shard ask the next shard on their list; a shard takes rows in
the order of their hash until its bound is reached and is full from then on. With
bounds that add up to all rows, every row has a shard after as many rounds as there
are shards.

All steps are DataFrame operators. Running totals are two-level: sums per slice of
the hash range first, then rows inside a slice, so no window holds a shard's rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.llm.common import shared_folder, sheltered, stage

CELLS = 4096
VIRTUAL_NODES = 64
# Rows of one shard in one slice are ordered together: n rows / (shards * slices).
SLICES = 4096


def node_cell(shard: int, node: int, cells: int) -> int:
    """The cell of a virtual node; it depends on its own name alone."""
    return zlib.crc32(f"shard {shard} node {node}".encode()) * cells >> 32


def clockwise(shards: int, nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[list[int]]:
    """For every cell of the ring, the shards in the order met clockwise."""
    ring = sorted((node_cell(s, v, cells), zlib.crc32(f"{v}/{s}".encode()), s) for s in range(shards) for v in range(nodes))
    starts = [cell for cell, _, _ in ring]
    orders = []
    for cell in range(cells):
        at, met = bisect_left(starts, cell), []
        for i in range(len(ring)):
            s = ring[(at + i) % len(ring)][2]
            if s not in met:
                met.append(s)
                if len(met) == shards:
                    break
        orders.append(met)
    return orders


def order_table(spark, orders: list[list[int]]) -> DataFrame:
    """Cells and their shards, as a literal; its size is set by parameters alone."""
    literal = ", ".join(f"array({', '.join(map(str, o))})" for o in orders)
    return spark.sql(f"SELECT posexplode(array({literal})) AS (__cell, __order)")


def before(rows: DataFrame, group: str, order: list[str], weight: Column, name: str) -> DataFrame:
    """Adds the group's total weight of rows ahead in (slice, order)."""
    inside = Window.partitionBy(group, "__slice").orderBy(*order)
    ahead = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(group, "__slice").agg(F.sum(weight).alias("__sum"))
    slices = slices.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    local = rows.withColumn("__local", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - weight)
    joined = local.join(slices, [group, "__slice"])
    return joined.withColumn(name, F.col("__ahead") + F.col("__local")).drop("__ahead", "__local")


def assign_shards(
    docs: DataFrame,
    shards: int = 8,
    slack: float = 0.0,
    weight: str | None = None,
    key: str = "doc_id",
    nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """Every row with its shard and its slot there, counted from 0 without gaps.

    Without a weight column loads are rows: with slack 0 the bounds add up to the
    number of rows and shards differ by one row at most; with slack e no shard has
    more than ceil((1 + e) * n / shards) rows and fewer rows leave the shard that the
    ring gives them first. With a weight column (long, not negative; null as 0) a
    shard takes rows while its load is below (1 + slack) times the mean load; a row
    without load stays with the shard it asks first.

    Rows are told apart by key and all other columns given; equal rows are
    interchangeable, and a part of their place is dealt from their position in the
    written stage, so copies of one row spread over slices. A null key hashes like
    empty text. An empty table gives an empty table. Input columns named shard or
    slot give way.
    """
    needed = {"__key": key} | ({} if weight is None else {"__weight": weight})
    return sheltered(docs, needed, ["shard", "slot"], lambda inner: placed_rows(inner, shards, slack, weight and "__weight", nodes), docs.columns)


def placed_rows(docs: DataFrame, shards: int, slack: float, weight: str | None, nodes: int) -> DataFrame:
    """assign_shards over the columns __key, __weight and others with private names."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    names = docs.columns
    hashed = F.xxhash64(F.coalesce(F.col("__key").cast("string"), F.lit("")))
    rows = docs.select(*names, hashed.alias("__hash")).withColumn("__n", F.monotonically_increasing_id())
    # The cell comes from the key; the slice mixes the row's number in, for repeated keys.
    rows = rows.withColumn("__cell", F.shiftrightunsigned("__hash", 64 - (CELLS.bit_length() - 1)).cast("int"))
    rows = rows.withColumn("__mixed", F.xxhash64("__hash", "__n"))
    rows = rows.withColumn("__slice", F.pmod(F.col("__mixed"), F.lit(SLICES)).cast("int"))
    rows = stage(rows, folder, "rows")
    load = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight).cast("long"), F.lit(0))
    total, n = rows.agg(F.coalesce(F.sum(load), F.lit(0)), F.count(F.lit(1))).first()
    orders = order_table(spark, clockwise(shards, nodes))
    open_rows = rows.join(F.broadcast(orders), "__cell").select("__n", "__slice", "__mixed", load.alias("__load"), "__order")
    room = bounds(shards, n if weight is None else total, slack, weight is None)
    taken = None
    for turn in range(shards):
        asking = open_rows.withColumn("shard", F.element_at("__order", turn + 1))
        asking = before(asking, "shard", ["__mixed", "__n"], F.col("__load"), "__before")
        limit = F.element_at(F.array(*(F.lit(r).cast("double") for r in room)), F.col("shard") + 1)
        asked = stage(asking.withColumn("__taken", (F.col("__before") < limit) | (F.col("__load") == 0)), folder, f"turn{turn}")
        won = asked.filter("__taken").select("__n", "__slice", "__mixed", "shard", "__load")
        taken = won if taken is None else taken.unionByName(won)
        open_rows = asked.filter(~F.col("__taken")).select("__n", "__slice", "__mixed", "__load", "__order")
        used = {r["shard"]: (r["w"], r["open"]) for r in asked.groupBy("shard").agg(F.sum(F.when(F.col("__taken"), F.col("__load"))).alias("w"), F.count_if(~F.col("__taken")).alias("open")).collect()}
        for s, (w, left) in used.items():
            room[s] = 0 if left else room[s] - (w or 0)
        if not any(left for _, left in used.values()):
            break
    slots = before(taken, "shard", ["__mixed", "__n"], F.lit(1).cast("long"), "slot").select("__n", "shard", "slot")
    return rows.join(slots, "__n").select(*names, "shard", "slot")


def bounds(shards: int, total: int, slack: float, rows: bool) -> list[float]:
    if not rows:
        return [(1 + slack) * total / shards or 1] * shards
    if slack == 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-(-int((1 + slack) * total + 0.999999) // shards)] * shards
