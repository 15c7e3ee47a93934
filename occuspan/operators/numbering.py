"""Row numbers and running sums inside groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.session import shared_folder, stage

# monotonically_increasing_id keeps the partition above this many bits.
POSITION_BITS = 33


def number_rows(
    df: DataFrame,
    group: str | Sequence[str],
    order: Sequence[str],
    output: str,
    sums: Mapping[str, Column] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """``row_number() over (partition by group order by order)`` for groups of any size.

    The rows are range-partitioned by group, order and their place in the input, by
    splitters that Spark samples, sorted, and written with the partition they fell
    into. A group may therefore cover many partitions, and equal rows may too. Only
    the first and the last group of a partition can go on in another one; their counts
    per partition, two rows a partition, tell how many rows of the group lie ahead.
    Rows are then numbered inside (partition, group), so no task holds more of a group
    than one partition does.

    ``sums`` names further columns, each the sum of an expression over the rows ahead
    of a row in its group. NULL is a group like any other and comes first in an order;
    rows that are equal in ``order`` are numbered in an arbitrary, fixed order. ``df`` is
    evaluated twice, once to sample the splitters: hand in a staged table if it is dear.
    """
    groups = [group] if isinstance(group, str) else list(group)
    sums = dict(sums or {})
    names = [*df.columns, output, *sums]
    sort = [*[F.col(f"`{c}`") for c in (*groups, *order)], F.col("_input")]
    placed = (
        df.withColumn("_input", F.monotonically_increasing_id())
        .repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_input")
    )
    rows = stage(placed, folder or shared_folder(df.sparkSession), f"placed_{output}").withColumns(
        {
            "_part": F.shiftright("_place", POSITION_BITS),
            "_key": F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(groups)]),
        }
    )
    ends = rows.groupBy("_part").agg(F.min_by("_key", "_place").alias("a"), F.max_by("_key", "_place").alias("b"))
    open_groups = ends.select("_part", F.explode(F.array("a", "b")).alias("_key")).distinct()
    totals = {"_rows": F.count(F.lit(1))} | {f"_sum_{c}": F.coalesce(F.sum(value), F.lit(0)) for c, value in sums.items()}
    counted = (
        rows.join(F.broadcast(open_groups), ["_part", "_key"])  # two rows a partition
        .groupBy("_part", "_key")
        .agg(*[value.alias(name) for name, value in totals.items()])
    )
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.select("_part", "_key", *[F.sum(c).over(before).alias(c) for c in totals])
    inside = Window.partitionBy("_part", "_key").orderBy("_place")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_at", F.row_number().over(inside)).withColumns(
        {f"_local_{c}": F.coalesce(F.sum(value).over(earlier), F.lit(0)) for c, value in sums.items()}
    )
    numbered = local.join(F.broadcast(ahead), ["_part", "_key"], "left")  # as many rows
    return numbered.withColumns(
        {output: (F.col("_at") + F.coalesce("_rows", F.lit(0))).cast("long")}
        | {c: F.col(f"_local_{c}") + F.coalesce(f"_sum_{c}", F.lit(0)) for c in sums}
    ).select(*[F.col(f"`{c}`") for c in names])
