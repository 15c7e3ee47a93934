"""Queries that read the snapshots several times: each delivery reads its own rows, a shared source is written once."""

from types import SimpleNamespace

from helpers import raw, tuples
from pyspark.sql import functions as F

from occuspan.operators import normalize, timeline
from occuspan.plans import queries

SPAN = ("store_id", "place_key", "island", "start_q", "end_q", "name_norm", "cat_code", "cat_name")


def shops(spark):
    sightings = [("s1", q, "0") for q in range(5)] + [("s2", 0, "1"), ("s2", 2, "1"), ("s3", 2, "1"), ("s3", 4, "0")]
    return raw(spark, [{normalize.STORE_ID: s, normalize.PERIOD: q, normalize.SIDO_CODE: sido} for s, q, sido in sightings])


def test_a_delivery_of_one_period_reads_that_period(spark, tmp_path, monkeypatch):
    rows, asked = shops(spark).localCheckpoint(), []

    def of_period(_, sf_dir, period):
        asked.append((sf_dir, period))
        return rows.filter(F.col(normalize.PERIOD) == period)

    monkeypatch.setattr(queries, "raw_snapshots", of_period)
    tables = SimpleNamespace(spark=spark, sf_dir="given", folder=str(tmp_path), latest=4, raw=rows)
    found = queries._appended_spans(tables)
    assert asked == [("given", 2), ("given", 4)]
    assert tuples(found, *SPAN) == tuples(timeline.spans(normalize.stores(rows)), *SPAN)


def test_quarantine_computes_its_snapshots_once(spark, tmp_path, monkeypatch):
    staged, stage = [], queries.stage

    def recorded(df, folder, name, codec=None):
        staged.append(name)
        return stage(df, folder, name, codec)

    monkeypatch.setattr(queries, "stage", recorded)
    report = queries._csv_quarantine(SimpleNamespace(spark=spark, folder=str(tmp_path), raw=shops(spark)))
    assert report.collect() and staged == ["raw"]
