import unicodedata
from types import SimpleNamespace
from urllib.parse import unquote

import pytest
from helpers import RAW_DEFAULT, tuples
from pyspark.sql import functions as F

from occuspan.operators import normalize as n
from occuspan.operators import places
from occuspan.plans import build
from occuspan.session import shared_folder
from occuspan.sinks import publish
from occuspan.sources import snapshots

HEADER = [c for c in RAW_DEFAULT if c != n.PERIOD]


def line(header, **values):
    row = {**RAW_DEFAULT, **values}
    return ",".join("" if row.get(c) is None else f'"{row[c]}"' for c in header)


def write_csv(folder, name, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    text = "\n".join([",".join(header), *rows]) + "\n"
    (folder / name).write_text(text, encoding="utf-8")


def file_name(region, month):
    return f"상가(상권)정보_{region}_{month}.csv"


@pytest.fixture
def root(tmp_path):
    write_csv(tmp_path / "2024Q1", unicodedata.normalize("NFD", file_name("서울", "202403")), HEADER, [
        line(HEADER, **{n.STORE_ID: "s1"}), line(HEADER, **{n.STORE_ID: "s2", n.FLOOR: None}),
    ])
    turned = [*HEADER[::-1], "새열"]
    write_csv(tmp_path / "2024Q1", file_name("부산", "202403"), turned, [line(turned, **{n.STORE_ID: "b1", "새열": "z"})])
    write_csv(tmp_path / "2023Q1", file_name("서울", "202303"), HEADER, [line(HEADER, **{n.STORE_ID: "s1"})])
    write_csv(tmp_path / "2024Q1", "._" + file_name("서울", "202403"), HEADER, ["junk"])
    write_csv(tmp_path / "2024Q1", "[필독]안내.csv", ["안내"], ["글"])
    write_csv(tmp_path / "notes", file_name("서울", "202403"), HEADER, [line(HEADER)])
    return tmp_path


def test_discovery(spark, root):
    found = snapshots.available(spark, str(root))
    assert list(found) == ["2023Q1", "2024Q1"] and [len(p) for p in found.values()] == [1, 2]
    seoul = snapshots.available(spark, str(root), "서울")
    assert [len(p) for p in seoul.values()] == [1, 1]
    assert snapshots.available(spark, str(root), "제주") == {}


def test_a_province_opens_its_own_files_only(spark, root):
    rows = snapshots.read_snapshots(spark, snapshots.available(spark, str(root), "부산"))
    assert [unquote(f).rsplit("/", 1)[-1] for f in rows.inputFiles()] == [file_name("부산", "202403")]
    assert tuples(snapshots.data_files(spark, str(root), "서울"), "label") == [("2023Q1",), ("2024Q1",)]


def test_headers_take_one_line_of_each_file(spark, tmp_path):
    for i in range(5):
        text = ["a,\"b, c\",,d"] * (i % 2 == 0) + ["x"] * (300_000 if i == 4 else 3)
        write_csv(tmp_path / "2024Q1", f"f {i}+가.csv", text, [])
    (tmp_path / "2024Q1" / "empty.csv").write_text("")
    (tmp_path / "2024Q1" / "bom.csv").write_text("\ufeffa,b\n1,2\n", encoding="utf-8")
    paths = [str(p) for p in sorted((tmp_path / "2024Q1").iterdir())]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    headers = {p.rsplit("/", 1)[-1]: h for p, h in snapshots.file_headers(spark, paths).items()}
    assert headers["empty.csv"] == () and headers["bom.csv"] == ("a", "b") and len(headers) == 7
    assert headers["f 0+가.csv"][:4] == ("a", "b, c", "_c2", "d") and headers["f 1+가.csv"] == ("x", "x", "x")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert snapshots.first_lines(spark, paths).rdd.getNumPartitions() == 6  # one split a file that holds anything


def test_columns_are_bound_by_name(spark, root):
    rows = snapshots.well_formed(snapshots.read_snapshots(spark, snapshots.available(spark, str(root))))
    assert tuples(rows, n.PERIOD, n.STORE_ID, n.NAME, n.LNG, n.FLOOR) == [
        (0, "s1", "가게", "127.0", "1"), (4, "b1", "가게", "127.0", "1"), (4, "s1", "가게", "127.0", "1"), (4, "s2", "가게", "127.0", None),
    ]
    assert "새열" not in rows.columns
    assert tuples(snapshots.covered(rows, n.SIDO_NAME, "서울"), n.STORE_ID) == tuples(rows, n.STORE_ID)
    assert snapshots.covered(rows, n.SIDO_NAME, "부산").count() == 0


def test_missing_required_column_stops(spark, root):
    short = [c for c in HEADER if c != n.BUILDING]
    write_csv(root / "2024Q2", file_name("서울", "202406"), short, [line(short)])
    with pytest.raises(ValueError, match=f"2024Q2.*{n.BUILDING}"):
        snapshots.read_snapshots(spark, snapshots.available(spark, str(root)))


def test_missing_optional_column_is_null(spark, tmp_path):
    short = [c for c in HEADER if c not in (n.BRANCH, n.UNIT)]
    write_csv(tmp_path / "2023Q2", file_name("서울", "202306"), short, [line(short)])
    rows = snapshots.read_snapshots(spark, snapshots.available(spark, str(tmp_path)))
    assert tuples(rows, n.PERIOD, n.BRANCH, n.NAME) == [(1, None, "가게")]


def test_broken_lines_are_set_aside(spark, tmp_path):
    good = line(HEADER, **{n.NAME: 'bad "x" y'})
    write_csv(tmp_path / "2023Q1", file_name("서울", "202303"), HEADER, [good, "a,b,c", line(HEADER) + ",too,many"])
    rows = snapshots.read_snapshots(spark, snapshots.available(spark, str(tmp_path)))
    kept = snapshots.well_formed(rows)
    assert [r["name_norm"] for r in n.stores(kept).select("name_norm").collect()] == ["badxy"]
    assert snapshots.malformed(rows).count() == 2


def test_label_check(spark):
    paths = [("/d/2024Q1/x_202403.csv",), ("/d/2024Q1/x_202404.csv",), ("/d/period=2025Q4/y_20251030.csv",), ("/d/2024Q1/x.csv",)]
    found = snapshots.check_labels(spark.createDataFrame(paths, "path string"))
    assert [r["ok"] for r in found.collect()] == [True, False, True, None]
    assert [r["content_label"] for r in found.collect()] == ["2024Q1", "2024Q2", "2025Q4", None]


def published_tables(spark, places_n=2):
    spec = "place_key string, building_id string, floor_label string, road_address string, sido_code string, " \
           "sigungu_code string, dong_code string, lat double, lng double, turnover_count int, avg_tenure_months double, " \
           "confidence string, stores_current bigint, is_occupied boolean, current_category_code string, " \
           "current_category_name string, first_quarter string, last_quarter string"  # fmt: skip
    row = ("b", "1", "r", "1", "11", "111", 37.0, 127.0, 0, None, "high", 1, True, "c", "n", "2023Q1", "2026Q1")
    place_rows = spark.createDataFrame([(f"p{i}", *row) for i in range(places_n)], spec).withColumn("name_norm", F.lit("secret"))
    history = spark.range(places_n + 1).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("place_key"), F.lit(1).alias("seq"),
        F.lit("2023Q1").alias("start_quarter"), F.lit(None).cast("string").alias("end_quarter"),
        F.lit("c").alias("category_code"), F.lit("n").alias("category_name"), F.lit(1).alias("tenure_quarters"),
    )
    regions = spark.range(1).select(
        F.lit("dong").alias("region_level"), F.lit("111").alias("region_code"), F.lit("D").alias("region_name"),
        F.lit(37.0).alias("center_lat"), F.lit(127.0).alias("center_lng"), F.lit(2).alias("place_count"),
        F.lit(0).alias("turnover_sum"), F.lit(0.0).alias("turnover_avg"), F.lit(0).alias("hot_place_count"),
        F.lit(None).cast("double").alias("avg_tenure_months"),
    )
    return {"places": place_rows, "place_history": history, "region_stats": regions}


def test_publishing_switches_versions_at_once(spark, tmp_path):
    root = str(tmp_path / "out")
    assert publish.versions(spark, root).count() == 0
    assert publish.publish(spark, root, published_tables(spark, 2), "v1") == 1
    assert publish.current(spark, root, "places").count() == 2
    assert publish.current(spark, root, "places").columns == list(places.PLACE_COLUMNS)
    assert publish.current(spark, root, "place_history").count() == 2  # the orphan went with its place
    # A crash after writing the tables, before the manifest row.
    publish.export_tables(published_tables(spark, 5), f"{root}/half")
    assert publish.current(spark, root, "places").count() == 2
    assert publish.publish(spark, root, published_tables(spark, 3), "v2") == 2
    assert publish.current(spark, root, "places").count() == 3
    assert tuples(publish.versions(spark, root), "version", "data_version") == [(1, "v1"), (2, "v2")]
    sizes = {r["table"]: r for r in publish.size_report(spark, publish.version_folder(spark, root, 2)).collect()}
    assert set(sizes) >= set(publish.TABLES) and all(sizes[t]["bytes"] > 0 for t in publish.TABLES)


def test_failed_checks_stop_the_publication(spark, tmp_path):
    root = str(tmp_path / "out")
    checks = spark.createDataFrame([("a", True, ""), ("b", False, "")], "check string, ok boolean, detail string")
    with pytest.raises(RuntimeError, match="b"):
        publish.publish(spark, root, published_tables(spark), "v", checks)
    assert publish.versions(spark, root).count() == 0
    assert publish.publish(spark, root, published_tables(spark), "v", checks, blocking=("a",)) == 1
    with pytest.raises(ValueError):
        publish.publish(spark, root, {"places": published_tables(spark)["places"]}, "v")


def test_two_publishers_at_a_time_get_a_version_each(spark, tmp_path):
    root = str(tmp_path / "out")
    publish.publish(spark, root, published_tables(spark, 1), "v1")
    slow = publish.write_version(spark, root, published_tables(spark, 2))
    quick = publish.write_version(spark, root, published_tables(spark, 3))
    assert publish.commit_version(spark, root, quick, "quick") == 2
    assert publish.commit_version(spark, root, slow, "slow") == 3
    assert tuples(publish.versions(spark, root), "version", "data_version") == [(1, "v1"), (2, "quick"), (3, "slow")]
    counts = [spark.read.parquet(f"{publish.version_folder(spark, root, v)}/places").count() for v in (1, 2, 3)]
    assert counts == [1, 3, 2] and publish.current(spark, root, "places").count() == 2


def test_a_claimed_number_is_passed_over(spark, tmp_path, monkeypatch):
    """Another publisher claims the number between this one's look at the manifest and its claim."""
    root = str(tmp_path / "out")
    mine, theirs = (publish.write_version(spark, root, published_tables(spark, n)) for n in (2, 3))
    create = publish._create

    def raced(spark, name, text):
        if name.endswith("claims/00000001") and text == mine:
            monkeypatch.setattr(publish, "_create", create)
            assert publish.commit_version(spark, root, theirs, "theirs") == 1
        return create(spark, name, text)

    monkeypatch.setattr(publish, "_create", raced)
    assert publish.commit_version(spark, root, mine, "mine") == 2
    assert tuples(publish.versions(spark, root), "version", "data_version") == [(1, "theirs"), (2, "mine")]
    assert publish._create(spark, f"{root}/claims/00000003", "dead publisher")
    assert publish.publish(spark, root, published_tables(spark, 1), "next") == 4


def test_export_is_sorted_csv(spark, tmp_path):
    publish.export_tables(published_tables(spark, 7), str(tmp_path / "x"), "csv")
    parts = sorted((tmp_path / "x" / "places").glob("part-*.csv"))
    keys = [row.split(",")[0] for part in parts for row in part.read_text().splitlines()[1:]]
    assert keys == [f"p{i}" for i in range(7)]


def test_whole_build_from_csv(spark, tmp_path):
    raw_root = tmp_path / "raw"
    for q, label in enumerate(("2023Q1", "2023Q2", "2023Q3", "2023Q4")):
        rows = [line(HEADER, **{n.STORE_ID: f"k{i}", n.BUILDING: f"B{i}", n.NAME: f"가게{i}"}) for i in range(5)]
        rows.append(line(HEADER, **{n.STORE_ID: f"c{q}", n.BUILDING: "C", n.NAME: f"가게{q}"}))
        write_csv(raw_root / label, file_name("서울", f"2023{3 * q + 3:02d}"), HEADER, rows)
    out = str(tmp_path / "out")
    with pytest.raises(RuntimeError, match="place_count"):
        build.run(spark, str(raw_root), out)
    version = build.run(spark, str(raw_root), out, place_count_range=(1, 100))
    found = {r["place_key"]: r for r in publish.current(spark, out, "places").collect()}
    assert len(found) == 6 and found["C#1"]["turnover_count"] == 3 and found["B0#1"]["turnover_count"] == 0
    assert found["C#1"]["avg_tenure_months"] == 3.0 and found["C#1"]["last_quarter"] == "2023Q4"
    assert publish.current(spark, out, "place_history").count() == 9
    meta = dict(tuples(spark.read.parquet(f"{publish.version_folder(spark, out, version)}/app_meta"), "key", "value"))
    assert meta["latest_quarter"] == "2023Q4" and meta["data_version"].startswith("2023Q4+")


def test_build_reads_line_breaks_and_keeps_bad_lines(spark, tmp_path):
    raw_root, out = tmp_path / "raw", str(tmp_path / "out")
    rows = [line(HEADER, **{n.STORE_ID: f"k{i}", n.BUILDING: f"B{i}", n.NAME: "두\n줄"}) for i in range(4)]
    write_csv(raw_root / "2023Q1", file_name("서울", "202303"), HEADER, [*rows, ",".join(["x"] * (len(HEADER) + 2))])
    write_csv(raw_root / "old" / "2023Q1", file_name("서울", "202303"), HEADER, [line(HEADER, **{n.STORE_ID: "z"})])
    with pytest.raises(RuntimeError, match="malformed_lines"):
        build.run(spark, str(raw_root), out, place_count_range=(1, 100), blocking=["malformed_lines", "file_labels"])
    version = build.run(spark, str(raw_root), out, place_count_range=(1, 100), blocking=["malformed_lines"], most_malformed=0.5)
    assert publish.current(spark, out, "places").count() == 4
    assert tuples(publish.current(spark, out, "drop_report"), "total", "malformed", "dropped", "kept") == [(5, 1, 0, 4)]
    assert spark.read.parquet(f"{publish.version_folder(spark, out, version)}/quarantine").count() == 1


def session_with(folder, master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


def test_shared_folder_follows_the_session():
    cluster = session_with("hdfs://shared/", "spark://head:7077")
    first, second = shared_folder(cluster), shared_folder(cluster)
    assert first.startswith("hdfs://shared/occuspan-") and first != second
    with pytest.raises(RuntimeError):
        shared_folder(session_with(None, "spark://head:7077"))
