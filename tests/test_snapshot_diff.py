import csv
import json
import random

import pytest
from helpers import raw, tuples

from occuspan.operators import normalize as n
from occuspan.operators import snapshot_diff as d
from occuspan.sinks import publish


def shop(building, name, **other):
    return {n.BUILDING: building, n.NAME: name, n.ROAD_ADDRESS: f"길 {building}", **other}


@pytest.fixture(scope="module")
def sides(spark):
    a = [
        shop("gone", "x"), shop("undecidable", None), shop("all", "x"), shop("all", "y"), shop("partly", "x"),
        shop("partly", "y"), shop("kept", "(주)K"), shop("kept", "K"), shop(None, "x"), shop(" ", "blank"),
        shop("noname", "x"), shop("noname", None),
    ]
    b = [
        shop("new", "x", **{n.SIGUNGU_NAME: None}), shop("undecidable", "x"), shop("all", "z"), shop("partly", "X"), shop("partly", "q"),
        shop("kept", "k", **{n.ROAD_ADDRESS: "다른 길"}), shop("kept", "extra"), shop(" ", "blank"), shop("noname", "x"),
    ]
    return d.snapshot_rows(raw(spark, a)), d.snapshot_rows(raw(spark, b))


def test_verdicts(sides):
    found = {r["place_key"]: r for r in d.snapshot_diff(*sides).collect()}
    assert {key: r["verdict"] for key, r in found.items()} == {
        "gone#1": d.GONE, "new#1": d.NEW_PLACE, "undecidable#1": d.UNDECIDABLE, "all#1": d.ALL_REPLACED,
        "partly#1": d.PARTLY_REPLACED, "kept#1": d.KEPT, " #1": d.KEPT, "noname#1": d.KEPT,
    }
    assert (found["kept#1"]["n_a"], found["kept#1"]["n_b"], found["kept#1"]["survived"]) == (2, 2, 1)
    assert found["gone#1"]["n_b"] is None and found["gone#1"]["survived"] is None
    assert found["new#1"]["n_a"] is None and found["undecidable#1"]["survived"] is None
    assert found["all#1"]["survived"] == 0 and found["kept#1"]["road_address"] == "길 kept"


def test_listings_and_chunks(sides):
    rows = {r["place_key"]: r for r in d.diff_listing(*sides).collect()}
    assert len(rows) == 8 and all(r["chunk"] == 0 for r in rows.values())
    assert rows["kept#1"]["display_a"] == ["(주)K · 백반", "K · 백반"] and rows["gone#1"]["display_b"] == []
    split = d.display_lists(*sides, list_entries=1).filter("place_key = 'kept#1'").collect()
    assert sorted(x for r in split for x in r["display_a"]) == ["(주)K · 백반", "K · 백반"]
    assert len(split) > 1


def test_distribution_has_shares_and_a_total(sides):
    found = {r["verdict"]: (r["places"], r["pct"]) for r in d.verdict_distribution(d.snapshot_diff(*sides)).collect()}
    assert found[d.KEPT] == (3, 37.5) and found[d.TOTAL_LABEL] == (8, 100.0) and len(found) == 7


def test_search(sides):
    diff, shown = d.snapshot_diff(*sides), d.distinct_displays(*sides)
    found = d.place_search(diff, shown, ["길 ke", "백반", "x", "K ·", "없는말"], top=3)
    assert tuples(found.filter("term = '길 ke'"), "rank", "matches", "place_key") == [(1, 1, "kept#1")]
    assert tuples(found.filter("term = 'K ·'"), "place_key") == [("kept#1",)]
    every = found.filter("term = '백반'").orderBy("rank").collect()
    assert [r["matches"] for r in every] == [8, 8, 8] and [r["place_key"] for r in every] == [" #1", "all#1", "gone#1"]
    assert found.filter("term in ('x', '없는말')").count() == 0
    assert d.place_search(diff, shown, []).count() == 0
    assert [r["place_key"] for r in d.browse(diff, 2).collect()] == [" #1", "all#1"]


def test_thousands_of_terms_match_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("가나다라ab c12") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    places = [(f"p{i:03d}", None if i % 17 == 0 else " ".join(rng.sample(words, 2)), rng.choice(["1", "2", None]), "v") for i in range(200)]
    shown = [(rng.choice(places)[0], rng.choice([None, "", "x", *words])) for _ in range(400)]
    terms = [" " + "".join(rng.choice("가나다라ab c12") for _ in range(rng.randrange(0, 5))) + "\t" for _ in range(5000)] + words
    diff = spark.createDataFrame(places, "place_key string, road_address string, floor_label string, verdict string")
    displays = spark.createDataFrame(shown, "place_key string, display string")
    expected = set()
    for term in {t.strip() for t in terms if len(t.strip()) >= 2}:
        hit = {k for k, road, *_ in places if road and term in road} | {k for k, body in shown if body and term in body}
        order = sorted((p for p in places if p[0] in hit), key=lambda p: (p[1] is None, p[1] or "", p[2] is None, p[2] or "", p[0]))
        expected |= {(term, i + 1, len(hit), p[0]) for i, p in enumerate(order[:4])}
    for wanted in (terms, spark.createDataFrame([(t,) for t in terms], "term string")):
        found = d.place_search(diff, displays, wanted, top=4)
        assert {tuple(r)[:4] for r in found.collect()} == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan


def test_a_term_is_looked_up_by_its_rarest_pair(spark):
    texts = spark.createDataFrame([(i, "ab" if i < 50 else "abcd" if i < 53 else "cd") for i in range(60)], "text_id long, body string")
    terms = d.search_terms(["abcd", "ab", "abx", "bc "], spark)
    found = d.rarest_pairs(terms, d.search_index(texts))
    assert tuples(found, "term", "pair") == [("ab", "ab"), ("abcd", "bc"), ("bc", "bc")]


def test_verdicts_by_count(sides):
    found = [(r["position"], r["verdict"], r["places"]) for r in d.verdicts_by_count(d.snapshot_diff(*sides)).collect()]
    assert found[0] == (1, d.KEPT, 3) and [r[0] for r in found] == [1, 2, 3, 4, 5, 6] and [r[2] for r in found] == [3, 1, 1, 1, 1, 1]


def test_exports(spark, sides, tmp_path):
    flat = d.diff_export(d.diff_listing(*sides))
    publish.export_diff(flat, str(tmp_path / "csv"))
    lines = [row for part in sorted((tmp_path / "csv").glob("*.csv")) for row in csv.DictReader(part.open(encoding="utf-8"))]
    assert len(lines) == 8 and {row["display_a"] for row in lines if row["place_key"] == "kept#1"} == {"(주)K · 백반 / K · 백반"}
    publish.export_districts(flat, str(tmp_path / "json"))
    parts = sorted((tmp_path / "json" / "sigungu=종로구").glob("*.json"))
    rows = [json.loads(line) for part in parts for line in part.read_text(encoding="utf-8").splitlines()]
    order = [(r.get("road_address", ""), r["floor_label"]) for r in rows]
    assert len(rows) == 7 and order == sorted(order)


def test_exploded_index_is_never_broadcast(spark):
    """However small the file of the texts looks, only the terms' side is sent to every executor."""
    texts = spark.range(50).selectExpr("id AS text_id", "concat('ab', id, 'bc') AS body")
    found = d.term_candidates(d.search_terms(["ab1", "zz"], spark), d.search_index(texts))
    plan = found._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert len(sent) == 1 and "BuildRight" in sent[0] and "SortMergeJoin" not in plan
    assert {row["text_id"] for row in found.collect()} >= {1, 10, 19}
