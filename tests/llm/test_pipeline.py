"""Stages of the corpus pipeline, and all of them in turn, on copies and awkward ids."""

import random

import pytest

import corpus_pipeline
from occuspan.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n=40):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)


def test_run_keeps_one_of_many_copies(spark, tmp_path):
    rng = random.Random(4)
    copied, unnamed = ("\n".join(words_of(rng) for _ in range(3)) for _ in range(2))
    rows = [(i, copied) for i in range(5, 17)] + [(None, unnamed)] * 11 + [(i, words_of(rng)) for i in range(100, 120)]
    table_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {5, None, *range(100, 120)}


@pytest.mark.parametrize("limit", [100, 0])
def test_lines_of_documents_without_ids_stay(spark, limit):
    docs = table_of(spark, [(None, "common line\ncommon line")] * 11)
    found = line_dedup.dedup_lines(docs, keep="first", filter_bits=1 << 14, broadcast_keys=limit).collect()
    assert [r.text for r in found] == ["common line"] * 11


def test_unlinked_documents_with_null_or_repeated_ids_stay(spark):
    rng = random.Random(5)
    alone = [(i, words_of(rng)) for i in [None] * 6 + [7] * 4 + [8, 9]]
    copied = [words_of(rng) for _ in range(3)]
    copies = [(i, t) for t, ids in zip(copied, ([None] * 3, [7, 7, 20], [30, 31])) for i in ids]
    left = corpus_pipeline.drop_near_duplicates(spark, table_of(spark, alone + copies), "").collect()
    assert sorted(r.text for r in left) == sorted([t for _, t in alone] + copied)
    assert {r.text: r.doc_id for r in left}[copied[1]] == 7 and {r.text: r.doc_id for r in left}[copied[2]] == 30
