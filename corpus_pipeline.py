"""From raw documents to token ids: quality, line dedup, near duplicates, mixing, encoding.

Each stage is written below the session's shared folder and read again by the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occuspan.llm import bpe, jaccard, line_dedup, mixing, quality
from occuspan.llm.common import shared_folder, stage, table
from occuspan.llm.queries import tokenizer_path

# Training, drawing and merging of components are no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject.

    A null or empty text is scored like any text without words; repeated rows score
    alike; without usable labels every document stays.
    """
    weights = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, weights).filter("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents hold, but for the first one's; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, keep="first")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: the one with the smallest id.

    Of several rows with that id, the one with the smallest text by its hash stays.
    Texts without words are no duplicates of one another.
    """
    mark = F.xxhash64("text", "source", "lang")
    found = jaccard.jaccard_components(docs.withColumn("__mark", mark), keep=["doc_id", "__mark"], root="__root")
    folder = shared_folder(spark)
    found = stage(found.filter("n_shingles > 0"), folder, "components")
    kept = found.groupBy("__root").agg(F.min(F.struct("doc_id", "__mark")).alias("k")).select("k.*")
    gone = stage(found.select("doc_id", "__mark").distinct().exceptAll(kept), folder, "gone")
    gone = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_IDS else gone
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (mark == gone["__mark"])
    left = docs.join(gone, same, "left_anti")
    repeated = stage(found.groupBy("doc_id", "__mark").count().filter("count > 1").select("doc_id", "__mark"), folder, "repeated")
    if repeated.isEmpty():
        return left
    # Rows that agree in id and text are one document; rows without words are not among them.
    repeated = F.broadcast(repeated) if repeated.count() <= jaccard.BROADCAST_IDS else repeated
    again = docs["doc_id"].eqNullSafe(repeated["doc_id"]) & (mark == repeated["__mark"])
    first = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(F.length("text")))
    one = left.join(repeated, again, "left_semi").withColumn("__first", first).filter("__first = 1").drop("__first")
    return left.join(repeated, again, "left_anti").unionByName(one)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each time a part of one is taken; n_chars follows the text.

    Texts without words are never taken; null sources are one source; repeated rows are
    documents of their own.
    """
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every mixed row, with its doc_id and source; a text without words has none."""
    return bpe.encode_documents(docs, tokenizer_path(), keep=["doc_id", "source"])


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing sources", mix),
    ("bpe encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; rows of the last one. An empty table ends with no rows."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for number, (_, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), folder, f"stage{number}")
    return docs
