"""Queries of the operators on training text, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import credentials, jaccard_join, perspectives, rules, suffixes, winnow
from .common import table
from .credentials import find_secrets
from .jaccard_join import jaccard_components
from .packing import pack
from .perspectives import rotate
from .pii import find_pii
from .quality import score_quality
from .rules import apply_rules
from .suffixes import repeated_passages
from .token_store import token_store
from .winnow import decontaminate


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold passages which others hold too."""
    return repeated_passages(table(spark, sf_dir, "documents")).where("n_passages > 0")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).drop("rules_run", "rejected_by")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


QUERIES = {f.__name__: f for f in (op1_token_store, op2_pii, op3_quality_classifier, op4_packing, op5_secret_scan, op6_suffix_arrays, op7_jaccard_join, op8_perspectives, op9_quality_rules, op10_decontamination)}
#: Where SQL can't give a query's rows they are tested against brute force instead.
SQL = {
    "op5_secret_scan": credentials.SQL,
    "op6_suffix_arrays": suffixes.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op8_perspectives": perspectives.SQL,
    "op9_quality_rules": rules.SQL,
    "op10_decontamination": winnow.SQL,
}
