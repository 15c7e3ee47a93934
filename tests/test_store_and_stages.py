"""Stages that measure or bucket what they write, the store by period, quantile sketches."""

import random

import pytest
from helpers import RAW_DEFAULT, raw, store, stores, tuples
from pyspark.sql import functions as F

from occuspan.operators import detail, places, quality, regions, snapshot_diff, timeline
from occuspan.operators import normalize as n
from occuspan.plans import build, period_store
from occuspan.session import bucketed_stage, measured_stage
from occuspan.sinks import publish

SPAN = ("store_id", "place_key", "island", "start_q", "end_q", "name_norm", "cat_code")


def delivery(spark, rows):
    return raw(spark, [{n.PERIOD: q, n.STORE_ID: s, n.BUILDING: b, n.NAME: name} for q, s, b, name in rows])


def whole_spans(spark, rows):
    return tuples(timeline.spans(n.stores(delivery(spark, rows))), *SPAN)


def test_appending_periods_equals_the_full_build(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path / "store")
    periods = {q: [(q, f"s{rng.randrange(25)}", f"B{rng.randrange(4)}", rng.choice("가나")) for _ in range(30)] for q in range(9)}
    assert period_store.append_period(spark, root, delivery(spark, [r for q in (0, 1, 2, 4) for r in periods[q]])) == 1
    have = {q: periods[q] for q in (0, 1, 2, 4)}
    for version, q in enumerate((5, 3, 8, 7, 2), 2):  # in order, between others, after a gap, and once more
        if q == 2:
            periods[2] = periods[2][:10] + [(2, "new", "B9", "다")]  # shops are gone from the new delivery
        assert period_store.append_period(spark, root, delivery(spark, periods[q])) == version
        have[q] = periods[q]
        assert tuples(period_store.current_spans(spark, root), *SPAN) == whole_spans(spark, [r for rows in have.values() for r in rows])
    assert tuples(period_store.stored_rows(spark, root).groupBy("qord").count(), "qord") == [(q,) for q in (0, 1, 2, 3, 4, 5, 7, 8)]


def test_a_broken_delivery_can_be_repeated(spark, tmp_path, monkeypatch):
    root, commit = str(tmp_path / "store"), publish.commit_version
    first = [(0, "a", "B", "x"), (1, "a", "B", "x"), (1, "b", "B", "x")]
    period_store.append_period(spark, root, delivery(spark, first))
    again = [(1, "b", "B", "x"), (1, "c", "B", "x")]  # shop a is no longer in period 1

    def broken(*args):
        raise OSError("lost")

    monkeypatch.setattr(publish, "commit_version", broken)
    with pytest.raises(OSError):
        period_store.append_period(spark, root, delivery(spark, again))
    assert tuples(period_store.current_spans(spark, root), *SPAN) == whole_spans(spark, first)
    monkeypatch.setattr(publish, "commit_version", commit)
    period_store.append_period(spark, root, delivery(spark, again))
    assert tuples(period_store.current_spans(spark, root), *SPAN) == whole_spans(spark, [first[0], *again])


def test_a_new_period_leaves_other_files_alone(spark, tmp_path):
    root = str(tmp_path / "store")
    period_store.append_period(spark, root, delivery(spark, [(0, "a", "B", "x"), (1, "a", "B", "x")]))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "stores").glob("qord=[01]/*.parquet")}
    period_store.append_period(spark, root, delivery(spark, [(2, "a", "B", "x")]))
    assert before and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "stores").glob("qord=[01]/*.parquet")}


def test_measures_come_from_the_write(spark, tmp_path):
    df = spark.range(100).repartition(4)
    kept, found = measured_stage(df.withColumn("x", F.col("id") % 7), str(tmp_path), "t", {"rows": F.count(F.lit(1)), "odd": F.count_if(F.col("id") % 2 == 1)})
    assert found == {"rows": 100, "odd": 50} and kept.columns == ["id", "x"] and kept.count() == 100
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "CollectMetrics" not in plan
    _, none = measured_stage(df.limit(0), str(tmp_path), "none", {"rows": F.count(F.lit(1))})
    assert not none.get("rows")


def small_build(spark):
    rows = stores(spark, [store(q, "a", "p#1") for q in range(4)] + [store(q, f"n{q}", "p#1", f"name{q}") for q in range(4, 13)] + [store(q, "b", "q#1") for q in range(13)])
    spans = timeline.spans(rows)
    joined = timeline.logical_stores(spans)
    place_rows = places.places(spans, joined, 12)
    return place_rows, places.place_history(joined, 12), regions.region_stats(place_rows, regions.region_names(rows))


def test_rules_are_counted_while_writing(spark, tmp_path):
    place_rows, history, stats = small_build(spark)
    twice = place_rows.unionByName(place_rows.filter("place_key = 'p#1'").withColumns({"confidence": F.lit("odd"), "lat": F.lit(None).cast("double")}))
    measured = {}
    for name, df in (("places", twice), ("place_history", history.withColumn("seq", F.lit(1))), ("region_stats", stats)):
        kept, measured[name] = build.checked_stage(name, df, str(tmp_path))
        assert kept.columns == df.columns
    found = {name: (ok, text) for name, ok, text in quality.constraint_checks(measured)}
    assert found["constraints_places"] == (False, "confidence allowed: 1, lat not null: 1, place_key unique: 1")
    assert found["constraints_place_history"] == (False, "place_key,seq unique: 1") and found["constraints_region_stats"] == (True, "")


def test_measured_numbers_give_the_same_checks(spark, tmp_path):
    tables = dict(zip(("places", "place_history", "region_stats"), small_build(spark), strict=True))
    measured = {name: build.checked_stage(name, df, str(tmp_path))[1] for name, df in tables.items()}
    plain, known = (quality.quality_checks(*tables.values(), place_count_range=(1, 5), measured=m) for m in (None, measured))
    assert tuples(plain, "check", "ok", "detail") == tuples(known, "check", "ok", "detail")


def test_broken_rules_stop_a_build(spark, tmp_path, monkeypatch):
    header = [c for c in RAW_DEFAULT if c != n.PERIOD]
    folder = tmp_path / "raw" / "2023Q1"
    folder.mkdir(parents=True)
    lines = [",".join(header), *(",".join(str({**RAW_DEFAULT, n.STORE_ID: f"k{i}", n.BUILDING: f"B{i}", n.DONG_CODE: "" if i == 2 else "1"}[c] or "") for c in header) for i in range(3))]
    (folder / "상가(상권)정보_서울_202303.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    run = lambda: build.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"), place_count_range=(1, 9), blocking=["constraints_places", "constraints_app_meta"])
    with pytest.raises(RuntimeError, match="constraints_places"):
        run()
    assert publish.versions(spark, str(tmp_path / "out")).count() == 0
    lines = [line.replace(",,", ",1,") for line in lines]
    (folder / "상가(상권)정보_서울_202303.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    made = build.metadata.build_metadata
    monkeypatch.setattr(build.metadata, "build_metadata", lambda stamp: made(stamp).unionByName(made(stamp).withColumn("value", F.lit(None).cast("string"))))
    with pytest.raises(RuntimeError, match="constraints_app_meta"):
        run()
    monkeypatch.setattr(build.metadata, "build_metadata", made)
    assert run() == 1
    folder = publish.version_folder(spark, str(tmp_path / "out"))
    assert tuples(spark.read.parquet(f"{folder}/merge_counts"), "table", "rows") == [("logical_stores", 3), ("spans", 3)]


def test_documents_join_their_buckets_without_a_shuffle(spark, tmp_path):
    place_rows, history, stats = small_build(spark)
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(broadcast)
    header = bucketed_stage(detail.detail_header(place_rows, stats), str(tmp_path), "header", "place_key", 4)
    pages = bucketed_stage(detail.history_pages(history, page_entries=3), str(tmp_path), "pages", "place_key", 4)
    spark.conf.set(broadcast, "-1")
    try:
        joined = detail.documents(header, pages)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
    finally:
        spark.conf.set(broadcast, kept)
    assert sorted(map(str, joined.collect())) == sorted(map(str, detail.place_detail(place_rows, history, stats, page_entries=3).collect()))


def test_merged_sketches_stay_within_their_error(spark):
    rng = random.Random(5)
    rows = [{n.PERIOD: q, n.STORE_ID: f"{q}-{i}-{k}", n.BUILDING: f"B{i}"} for q in range(3) for i in range(700) for k in range(rng.choice([1, 1, 2, 3, 9]))]
    df = raw(spark, rows)
    sketches = snapshot_diff.place_size_sketches(df)
    every = F.lit("all")
    found = snapshot_diff.merged_quantiles(sketches, every, "span").collect()
    assert [(r["span"], r["places"]) for r in found] == [("all", 2100)]
    close = snapshot_diff.quantile_ranks(df, snapshot_diff.merged_quantiles(sketches, every, "span"), every, "span")
    assert tuples(close, "p50_close", "p95_close") == [(True, True)]
    wrong = snapshot_diff.merged_quantiles(sketches, every, "span").withColumn("p50", F.lit(9))
    assert tuples(snapshot_diff.quantile_ranks(df, wrong, every, "span"), "p50_close", "p95_close") == [(False, True)]
