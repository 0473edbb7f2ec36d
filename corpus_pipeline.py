"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
secrets are masked, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all of docs; all but the last return the columns of documents.
Rows without a doc_id are judged by their text where a stage can, are never duplicates and hold no benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontamination, ngram_join, packing, secrets, toxicity
from marquee.llm.common import saved, table
from marquee.llm.queries import tokenizer_path

#: Ids of documents to leave out are broadcast up to this many (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids(doc_id)."""
    ids = saved(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the classifier calls toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns).where("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each component, and one row of each doc_id."""
    found = saved(ngram_join.similar(docs).where("doc_id IS NOT NULL"))
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = _without(docs, found.where("doc_id <> component_id").select("doc_id"))
    if repeated.isEmpty():
        return kept
    return _without(kept, repeated).unionByName(kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item."""
    return _without(docs, decontamination.contained(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; n_chars follows the text."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The layout of the packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic_documents),
    ("ngram_join", near_duplicates),
    ("decontamination", contaminated_documents),
    ("secrets", masked_secrets),
    ("packing", packed),
]
#: SQL can't express the classifier or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
