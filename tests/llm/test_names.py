"""Columns of the caller may have any name: an operator's own names never meet them."""

import random

import pytest
from pyspark.sql import functions as F

from occuspan.llm import chat, class_lm, clean_lines, jaccard, line_dedup, merkle, mixing, quality, ring

AWKWARD = ["rank", "rare", "ranks", "node", "root", "gid", "Shard2", "a.b", "my col", "size2", "digest", "block", "turn", "label", "__marked"]
RESULTS = ["shard", "slot", "n_lines", "n_dropped", "n_shingles", "component_id", "size", "score", "predicted", "n_tokens", "kept", "cleaned"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = ["\n".join(["shared line"] * (i % 2) + [" ".join(f"w{rng.randrange(300)}" for _ in range(30))]) for i in range(24)] + [None, "", "long " * 20_000]
    names = ["doc_id", "text", "source", *AWKWARD, *(r.title() for r in RESULTS[:4]), *RESULTS[4:]]
    schema = ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names)
    rows = [(i, t, f"s{i % 3}", *(f"{n}-{i}" for n in names[3:])) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


def check(found, docs, results, lost=()):
    """All other columns are there with their values, and the results, once each."""
    taken = {r.lower() for r in results}
    kept = [c for c in docs.columns if c.lower() not in taken and c not in lost]
    assert found.columns == [*kept, *results]
    stay = [F.col(f"`{c}`") for c in kept if c not in ("text",)]
    assert sorted(map(tuple, found.select(*stay).collect())) == sorted(map(tuple, docs.select(*stay).collect()))
    assert len(found.filter("doc_id < 0").collect()) == 0


def test_ring(docs):
    check(ring.assign_shards(docs, shards=3), docs, ["shard", "slot"])


def test_line_dedup(docs):
    for limit in (100, 0):
        check(line_dedup.dedup_lines(docs, filter_bits=1 << 14, broadcast_keys=limit), docs, ["n_lines", "n_dropped"])


def test_jaccard(docs):
    kept = [c for c in docs.columns if c != "text"]
    found = jaccard.jaccard_components(docs, sketch_bits=12, keep=kept)
    check(found, docs, ["n_shingles", "component_id"], ["text"])


def test_class_model(docs):
    found = class_lm.score_documents(docs.withColumn("train", F.col("doc_id") % 3 != 0))
    check(found, docs.withColumn("train", F.col("doc_id") % 3 != 0), ["n_tokens", "n_known", "train_tokens", "base_score", "score"], ["text"])


def test_mixing(docs):
    rows = mixing.mix_sources(docs)["rows"]
    kept = [c for c in docs.columns if c not in ("text", "size")]
    assert rows.columns == [*kept, "__row", "size", "source_rank"] and rows.count() == docs.count()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.filter("`a.b` <> concat('a.b-', doc_id)").count() == 0


def test_cleaning_and_quality(docs):
    cleaned = clean_lines.clean_documents(docs)
    assert {"a.b", "my col", "rank"} <= set(cleaned.columns) and cleaned.count() == docs.count()
    labels = docs.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    check(scored, docs, ["score", "predicted"])


def test_chat_and_manifest(docs):
    turns = chat.format_turns(docs, role="source", text="a.b", keep=[c for c in docs.columns if c != "text"])
    check(turns, docs, [n for n, _, _ in chat.MADE], ["text"])
    assert chat.read_back(turns.withColumn("x.y", F.col("doc_id")), "source", "x.y").count() == 3
    leaves = docs.withColumn("leaf", F.sha2(F.col("`a.b`"), 256))
    manifest = merkle.build_manifest(leaves, "leaf", ["doc_id"], "my col", 2)
    found = merkle.versions(manifest, "leaf", [c for c in docs.columns if c != "text"], ["subroot", "proof_sha256", "version_root"])
    check(found, docs, ["subroot", "proof_sha256", "version_root"], ["text"])
    assert found.filter(F.col("version_root") != manifest.root).count() == 0
