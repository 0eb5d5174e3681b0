"""A corpus of documents made ready for training, in five stages.

Each stage takes all that the one before kept; all but the last return the
columns of ``documents``. A stage's rows are written before the next stage
begins, which deletes what the stage kept in tables of its own. Rows are judged each for itself, by a key of doc_id and
text, whether or not their doc_id is null or stands at other rows too; of rows
with the same doc_id and text one stays.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import table
from spanforge.llm.jaccard_join import jaccard_components
from spanforge.llm.packing import pack
from spanforge.llm.pii import redact
from spanforge.llm.quality import score_quality
from spanforge.llm.winnow import decontaminate
from spanforge.shared import remove, write_table, written


def _keyed(docs: DataFrame) -> DataFrame:
    # which of the two are null is hashed too, as a null leaves a hash as it was
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _by_key(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the key for doc_id."""
    return _keyed(docs).select(F.col("_key").alias("doc_id"), "text")


#: What the last stage has written for itself.
_left: set[str] = set()


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's own tables last until the next stage begins, which reads what the one before has written."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            remove(spark, _left.pop())
        with written() as made:
            out = f(spark, docs, sf_dir)
        _left.update(made)
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), *docs.columns)
    return scored.where("predicted = 1").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group that the Jaccard join links, one without a doc_id only where all are."""
    found = jaccard_components(_by_key(docs)).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group"))
    named, _ = write_table(_keyed(docs).groupBy("_key").agg(F.min("doc_id").alias("_id"), F.count("*").alias("_rows")), "pipeline-keys")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_key"))
    keys, _ = write_table(found.distinct().join(named, "_key").groupBy("_group").agg(first.alias("_first")).select("_first._key"), "kept")
    kept = _keyed(docs).join(keys, "_key", "left_semi")
    if named.where("_rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["_key"])
    return kept.select(*docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    hit = decontaminate(_by_key(docs), table(spark, sf_dir, "benchmark"))
    # written, so that Spark knows its size and moves the texts only if it is large
    keys, _ = write_table(hit.where("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return _keyed(docs).join(keys, "_key", "left_anti").select(*docs.columns)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and counts the characters anew."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: No SQL gives a trained classifier's or a tokenizer's rows; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, new = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            remove(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
