import itertools
import random
from collections import Counter, defaultdict

from helpers import logical, spans, store, stores, tuples
from hypothesis import given, settings
from hypothesis import strategies as st

from occuspan.operators import timeline


def islands(periods, reach):
    """Groups of consecutive periods that are at most ``reach`` apart."""
    found = []
    for q in sorted(periods):
        if found and q - found[-1][-1] <= reach:
            found[-1].append(q)
        else:
            found.append([q])
    return found


def test_one_missing_period_is_bridged_two_are_not(spark):
    rows = [store(q, "a") for q in (0, 1, 3)] + [store(q, "b") for q in (0, 1, 4)]
    assert tuples(timeline.spans(stores(spark, rows)), "store_id", "island", "start_q", "end_q") == [
        ("a", 0, 0, 3), ("b", 0, 0, 1), ("b", 1, 4, 4),
    ]


def test_span_carries_the_latest_name_and_known_codes(spark):
    rows = [
        store(0, name="old", sido_code="1", dong_code="7"),
        store(1, name="mid", sido_code="2", dong_code=None),
        store(2, name="new", sido_code=None, dong_code=None, cat_code="Z"),
        store(9, name="later", sido_code=None, dong_code=None),
    ]
    found = {r["start_q"]: r for r in timeline.spans(stores(spark, rows)).collect()}
    assert (found[0]["name_norm"], found[0]["cat_code"], found[0]["seen_before"]) == ("new", "Z", 1)
    assert tuple(found[0]["sido_code_seen"]) == (1, "2") and tuple(found[0]["dong_code_seen"]) == (0, "7")
    assert tuple(found[9]["sido_code_seen"]) == (1, "2")


def test_null_ids_form_one_shop_per_place(spark):
    rows = [store(0, None), store(1, None), store(5, None, "b#2")]
    assert tuples(timeline.spans(stores(spark, rows)), "store_id", "place_key", "start_q", "end_q") == [
        (None, "b#1", 0, 1), (None, "b#2", 5, 5),
    ]


@settings(max_examples=12, deadline=None)
@given(st.sets(st.tuples(st.sampled_from("abc"), st.sampled_from("xy"), st.integers(0, 14)), min_size=1, max_size=60))
def test_every_sighting_is_in_exactly_one_span(spark, seen):
    seen = {(s, q): p for s, p, q in seen}  # one place per shop and period
    found = tuples(timeline.spans(stores(spark, [store(q, s, p) for (s, q), p in seen.items()])),
                   "store_id", "place_key", "start_q", "end_q")
    by_pair = defaultdict(list)
    for (s, q), p in seen.items():
        by_pair[s, p].append(q)
    wanted = [(s, p, i[0], i[-1]) for (s, p), qs in by_pair.items() for i in islands(qs, 2)]
    assert found == sorted(wanted, key=repr)


def test_reissued_ids_are_joined_across_one_missing_period(spark):
    for start, groups in ((5, 1), (6, 1), (7, 2)):
        rows = [("a", "p", 0, 4, "n"), ("b", "p", start, 9, "n")]
        assert timeline.logical_stores(spans(spark, rows)).count() == groups


def test_the_previous_end_counts_not_the_furthest(spark):
    rows = [("a", "p", 0, 10, "n", "A"), ("b", "p", 1, 2, "n", "B"), ("c", "p", 6, 8, "n", "C")]
    found = timeline.logical_stores(spans(spark, rows))
    assert tuples(found, "start_q", "end_q", "cat_code", "merged_spans") == [(0, 10, "A", 2), (6, 8, "C", 1)]


def test_nameless_spans_stay_apart(spark):
    rows = [("a", "p", 0, 4, ""), ("b", "p", 0, 4, ""), ("c", "p", 5, 6, ""), (None, "p", 5, 6, "")]
    found = timeline.logical_stores(spans(spark, rows))
    assert tuples(found, "start_q", "end_q", "merged_spans") == [(0, 4, 1), (0, 4, 1), (5, 6, 1), (5, 6, 1)]
    counts = timeline.merge_counts(found).first()
    assert tuple(counts) == (4, 4, 0)


def merged_by_hand(rows):
    groups = defaultdict(list)
    for sid, place, start, end, name, cat in rows:
        groups[place, name, sid if name == "" else None].append((start, end, cat))
    out = []
    for (place, name, _), stays in groups.items():
        parts = []
        for start, end, cat in sorted(stays):
            if name and parts and start - parts[-1][-1][1] <= 2:
                parts[-1].append((start, end, cat))
            else:
                parts.append([(start, end, cat)])
        for part in parts:
            last = max((end, start, cat) for start, end, cat in part)
            out.append((place, name, part[0][0], last[0], last[2], len(part)))
    return sorted(out, key=repr)


def random_spans(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(20)
        name = rng.choice(["", "n1", "n2", "n3"])
        rows.append((f"s{i}", rng.choice("pq"), start, start + rng.randrange(4), name, rng.choice("AB")))
    return rows


def test_merge_matches_a_walk_by_hand(spark):
    for seed in (1, 2):
        rows = random_spans(seed)
        columns = ("place_key", "name_norm", "start_q", "end_q", "cat_code", "merged_spans")
        assert tuples(timeline.logical_stores(spans(spark, rows)), *columns) == merged_by_hand(rows)
        shuffled = spans(spark, rows[::-1]).repartition(7)
        assert tuples(timeline.logical_stores(shuffled), *columns) == merged_by_hand(rows)


def test_turnover_pairs_ends_with_starts_right_after(spark):
    rows = [
        ("two_end", "a", 0, 3), ("two_end", "b", 1, 3), ("two_end", "c", 4, 12),
        ("missing_period", "a", 0, 9), ("missing_period", "b", 11, 12),
        ("censored", "a", 0, 12), ("censored", "b", 3, 12),
    ]
    assert tuples(timeline.place_turnover(logical(spark, rows), 12), "place_key", "turnover_count") == [("two_end", 1)]
    counts = tuples(timeline.boundary_counts(logical(spark, rows), 12), "place_key", "boundary_q", "n_ended", "n_started")
    assert ("two_end", 3, 2, 1) in counts and ("missing_period", 10, 0, 1) in counts and ("censored", 2, 0, 1) in counts
    assert not any(row[1] < 0 or row[1] >= 12 for row in counts)


def test_turnover_matches_counting_by_hand(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pqr"), f"n{i}", s := rng.randrange(12), min(12, s + rng.randrange(5))) for i in range(200)]
    ended = Counter((p, e) for p, _, _, e in rows if e < 12)
    started = Counter((p, s - 1) for p, _, s, _ in rows if s > 0)
    wanted = [(p, sum(min(ended[p, q], started[p, q]) for q in range(12))) for p in "pqr"]
    found = tuples(timeline.place_turnover(logical(spark, rows), 12), "place_key", "turnover_count")
    assert found == wanted
    assert all(n <= min(sum(p == k for k, *_ in rows), 200) for p, n in found)


def test_plan_has_one_exchange_per_grouping(spark):
    rows = [store(q, s, p) for q, s, p in itertools.product(range(3), "ab", ["b#1"])]
    chain = timeline.logical_stores(timeline.spans(stores(spark, rows)))
    plan = chain._jdf.queryExecution().executedPlan().toString()
    # Shop and place; counting equal intervals; place and name.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "Join" not in plan and "Python" not in plan and "CartesianProduct" not in plan
