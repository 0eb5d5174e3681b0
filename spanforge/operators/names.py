"""Reconciliation of read names between an alignment table and any number of read files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import read_name


def name_counts(records: DataFrame, name: str) -> DataFrame:
    """(name, n) over normalised names."""
    return records.groupBy(read_name(F.col(name)).alias("name")).agg(F.count("*").alias("n"))


def reconcile(alignments: DataFrame, files: list[DataFrame], name: str = "name") -> DataFrame:
    """Full outer join on the name: (name, in_alignment, in_files, mask), ``mask`` with a bit for each file that has it."""
    a = name_counts(alignments, name).withColumnRenamed("n", "in_alignment")
    tagged = reduce(DataFrame.unionByName, [f.select(read_name(F.col(name)).alias("name"), F.lit(i).alias("_i")) for i, f in enumerate(files)])
    b = tagged.groupBy("name").agg(F.count("*").alias("in_files"), F.bit_or(F.expr("shiftleft(1L, _i)")).alias("mask"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return a.join(b, "name", "full_outer").select("name", zero("in_alignment"), zero("in_files"), zero("mask"))


def name_statistics(records: DataFrame, name: str) -> DataFrame:
    """One row: records, unique names, names that occur more than once, and records of those."""
    n = name_counts(records, name)
    return n.agg(F.sum("n").alias("records"), F.count("*").alias("unique_names"), F.count_if(F.col("n") > 1).alias("repeated_names"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_records"))


def missing_examples(reconciled: DataFrame, first: DataFrame, n: int, side: str = "in_alignment") -> DataFrame:
    """The first ``n`` names, by (name, pos), that a side lacks."""
    return reconciled.where(F.col(side) == 0).join(first, "name").orderBy("pos", "name").limit(n)
