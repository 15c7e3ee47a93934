"""Checks over the published tables; each result is plain rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occuspan.functions.text import UNKNOWN_FLOOR, fixed_digits
from occuspan.operators.regions import LEVELS

# Accepted range of the place count and of the mean stay in months.
PLACE_COUNT_RANGE = (100_000, 2_000_000)
TENURE_RANGE = (3.0, 42.0)
# Fixed value: turnover counts shown with the check of their distribution.
SHOWN_BUCKETS = 6


def turnover_histogram(places: DataFrame) -> DataFrame:
    """Places per turnover count, the most frequent counts flagged."""
    counted = places.groupBy("turnover_count").agg(F.count(F.lit(1)).alias("places"))
    most = counted.agg(F.max("places").alias("places")).withColumn("top", F.lit(True))
    marked = counted.join(most, "places", "left")
    return marked.select("turnover_count", "places", F.coalesce("top", F.lit(False)).alias("is_mode"))


def orphan_history(history: DataFrame, places: DataFrame) -> DataFrame:
    """Place keys with chronology rows but no place, with their row counts."""
    counted = history.groupBy("place_key").agg(F.count(F.lit(1)).alias("history_rows"))
    return counted.join(places.select("place_key"), "place_key", "left_anti")


def drop_orphans(history: DataFrame, places: DataFrame) -> DataFrame:
    """Chronology rows of existing places only."""
    return history.join(orphan_history(history, places).select("place_key"), "place_key", "left_anti")


def gate_lookup(places: DataFrame, keys: DataFrame) -> DataFrame:
    """How many of the listed place keys exist."""
    listed = keys.select("place_key").distinct()
    marked = listed.join(places.select("place_key", F.lit(1).alias("hit")), "place_key", "left")
    return marked.agg(F.count(F.lit(1)).alias("listed"), F.count("hit").alias("found")).select(
        "listed", "found", (F.col("listed") == F.col("found")).alias("ok")
    )


def _metrics(df: DataFrame, **values: Column) -> DataFrame:
    """One aggregation over a table, as rows (metric, value)."""
    totals = df.agg(*[value.cast("double").alias(name) for name, value in values.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in values])
    return totals.select(F.inline(rows))


def place_numbers() -> dict[str, Column]:
    """What the checks compare of places."""
    tenure = F.col("avg_tenure_months")
    return {
        "places": F.count(F.lit(1)),
        "low": F.count_if(F.col("confidence") == "low"),
        "unknown_floor": F.count_if(F.col("floor_label") == UNKNOWN_FLOOR),
        "tenure_min": F.min(tenure),
        "tenure_max": F.max(tenure),
        "tenure_bad": F.count_if(tenure <= 0),
    }


def history_numbers() -> dict[str, Column]:
    """What the checks compare of chronologies."""
    return {"inverted": F.count_if(F.col("end_quarter").isNotNull() & (F.col("start_quarter") > F.col("end_quarter")))}


def region_numbers() -> dict[str, Column]:
    """What the checks compare of regions."""
    lowest = F.when(F.col("region_level") == LEVELS[-1], F.col("place_count"))
    return {"dong_places": F.coalesce(F.sum(lowest), F.lit(0))}


def quality_checks(
    places: DataFrame,
    history: DataFrame,
    regions: DataFrame,
    gate_keys: DataFrame | None = None,
    place_count_range: tuple[int, int] = PLACE_COUNT_RANGE,
    tenure_range: tuple[float, float] = TENURE_RANGE,
    measured: Mapping[str, Mapping[str, object]] | None = None,
) -> DataFrame:
    """Rows (check, ok, detail), one per check.

    Every table is reduced to a few numbers by one aggregation; the numbers
    are brought together as rows and turned into verdicts at the end. Numbers
    ``measured`` while the tables were written, by ``table_measures``, save the scans for them.
    """
    histogram = turnover_histogram(places)
    at_zero = F.max(F.when((F.col("turnover_count") == 0) & F.col("is_mode"), 1).otherwise(0))
    parts = [
        _metrics(histogram, zero_is_mode=at_zero, lowest=F.min("turnover_count")),
        _metrics(orphan_history(history, places), orphans=F.coalesce(F.sum("history_rows"), F.lit(0))),
    ]
    if measured is None:
        parts += [_metrics(places, **place_numbers()), _metrics(history, **history_numbers()), _metrics(regions, **region_numbers())]
    else:
        known = [(metric, value) for values in measured.values() for metric, value in values.items() if not metric.startswith(RULE)]
        parts.append(places.sparkSession.createDataFrame(known, "metric string, value double"))
    if gate_keys is not None:
        gate = gate_lookup(places, gate_keys)
        parts.append(_metrics(gate, listed=F.max("listed"), found=F.max("found")))
    numbers = reduce(DataFrame.unionByName, parts).withColumn("text", F.lit(None).cast("string"))
    lowest = histogram.orderBy("turnover_count").limit(SHOWN_BUCKETS).agg(F.collect_list(F.struct("turnover_count", "places")).alias("b"))
    shown = F.transform(F.array_sort("b"), lambda x: F.concat_ws(":", x["turnover_count"], x["places"]))
    numbers = numbers.unionByName(lowest.select(F.lit("buckets").alias("metric"), F.lit(None).cast("double").alias("value"), F.array_join(shown, ", ").alias("text")))

    def value(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("value")))

    def count_text(metric: str) -> Column:
        return F.coalesce(value(metric).cast("bigint").cast("string"), F.lit("none"))

    def months(metric: str) -> Column:
        return F.coalesce(fixed_digits(value(metric), 1), F.lit("none"))

    def share(metric: str) -> Column:
        return F.floor(value(metric) * 1000.0 / value("places") + 0.5) / F.lit(10.0)

    few, many = place_count_range
    shortest, longest = tenure_range
    checks = [
        ("place_count", value("places").between(few, many), count_text("places")),
        ("zero_turnover_is_mode", (value("zero_is_mode") == 1) & (value("lowest") == 0), F.max("text")),
        ("no_orphan_history", value("orphans") == 0, count_text("orphans")),
        ("no_inverted_interval", value("inverted") == 0, count_text("inverted")),
        (
            "low_confidence_is_unknown_floor",
            F.abs(share("low") - share("unknown_floor")) < 0.1,
            F.concat(count_text("low"), F.lit("/"), count_text("unknown_floor")),
        ),
        (
            "dong_places_add_up",
            value("dong_places") == value("places"),
            F.concat(count_text("dong_places"), F.lit("/"), count_text("places")),
        ),
        (
            "tenure_range",
            (value("tenure_bad") == 0) & (value("tenure_min") >= shortest) & (value("tenure_max") <= longest),
            F.concat(months("tenure_min"), F.lit("~"), months("tenure_max")),
        ),
    ]
    if gate_keys is not None:
        checks.append(
            (
                "gate_places_found",
                value("found") == value("listed"),
                F.concat(count_text("found"), F.lit("/"), count_text("listed")),
            )
        )
    verdicts = numbers.agg(
        F.array(
            *[
                F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))
                for name, ok, detail in checks
            ]
        ).alias("checks")
    )
    return verdicts.select(F.inline("checks"))


def _nulls(*columns: str) -> dict[str, Column]:
    return {f"{c} not null": F.col(c).isNull() for c in columns}


def table_rules(name: str) -> dict[str, Column]:
    """What breaks a declared rule of a published table, row by row; keys and references apart."""
    if name == "places":
        filled = _nulls(
            "place_key", "building_id", "floor_label", "road_address", "sido_code", "sigungu_code", "dong_code", "lat",
            "lng", "turnover_count", "confidence", "stores_current", "is_occupied", "first_quarter", "last_quarter",
        )
        return filled | {"confidence allowed": ~F.col("confidence").isin("high", "low")}
    if name == "place_history":
        return _nulls("place_key", "seq", "start_quarter", "category_code", "category_name")
    if name == "region_stats":
        filled = _nulls(
            "region_level", "region_code", "region_name", "center_lat", "center_lng", "place_count", "turnover_sum",
            "turnover_avg", "hot_place_count",
        )
        return filled | {"region_level allowed": ~F.col("region_level").isin(*LEVELS)}
    if name == "app_meta":
        return _nulls("key", "value", "updated_at")
    raise ValueError(f"no rules for {name}")


# Columns that identify a row of a published table.
TABLE_KEYS = {
    "places": ["place_key"],
    "place_history": ["place_key", "seq"],
    "region_stats": ["region_level", "region_code"],
    "app_meta": ["key"],
}
RULE = "rule: "
REPEATED = "_repeated"


def key_rule(name: str) -> str:
    return f"{','.join(TABLE_KEYS[name])} unique"


def marked_repeats(name: str, df: DataFrame) -> DataFrame:
    """Rows with a mark on the second row of every key; no shuffle where rows come grouped by the key."""
    same = Window.partitionBy(*TABLE_KEYS[name]).orderBy(*TABLE_KEYS[name])
    return df.withColumn(REPEATED, F.row_number().over(same) == 2)


def table_measures(name: str) -> dict[str, Column]:
    """Aggregates over the rows of a table, marked by ``marked_repeats``: violations of its rules and
    the numbers that ``quality_checks`` compares."""
    rules = table_rules(name) | {key_rule(name): F.col(REPEATED)}
    measures = {RULE + rule: F.count_if(broken) for rule, broken in rules.items()}
    numbers = {"places": place_numbers, "place_history": history_numbers, "region_stats": region_numbers}
    return measures | {c: value.cast("double") for c, value in numbers.get(name, dict)().items()}


def constraint_checks(measured: Mapping[str, Mapping[str, object]]) -> list[tuple[str, bool, str]]:
    """A check (name, ok, detail) for each measured table: no rule is broken; the broken ones are listed."""
    checks = []
    for name, values in measured.items():
        broken = {k.removeprefix(RULE): v for k, v in values.items() if k.startswith(RULE) and v}
        checks.append((f"constraints_{name}", not broken, ", ".join(f"{rule}: {n}" for rule, n in sorted(broken.items()))))
    return checks


def constraint_violations(places: DataFrame, history: DataFrame, regions: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Violations of the declared table rules: rows (table, rule, violations)."""

    def report(name: str, df: DataFrame) -> DataFrame:
        key = TABLE_KEYS[name]
        broken = [F.struct(F.lit(rule).alias("rule"), F.count_if(test).alias("violations")) for rule, test in table_rules(name).items()]
        checked = df.agg(F.array(*broken).alias("r")).select(F.inline("r"))
        repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(
            F.lit(key_rule(name)).alias("rule"), F.count_if(F.col("n") > 1).alias("violations")
        )
        return checked.unionByName(repeated).select(F.lit(name).alias("table"), "rule", "violations")

    orphans = orphan_history(history, places).agg(
        F.lit("place_history").alias("table"),
        F.lit("place_key references places").alias("rule"),
        F.coalesce(F.sum("history_rows"), F.lit(0)).alias("violations"),
    )
    found = [report("places", places), report("place_history", history), orphans, report("region_stats", regions)]
    if meta is not None:
        found.append(report("app_meta", meta))
    return reduce(DataFrame.unionByName, found)
