"""Genomes: small tables of sequences (seqname, length, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_sequence(genome: DataFrame, seqname: str, length: int) -> DataFrame:
    """The genome with one more sequence at its end; a known name is an error."""
    if genome.where(F.col("seqname") == seqname).limit(1).count():
        raise ValueError(f"sequence {seqname} is known already")
    last = genome.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    return genome.unionByName(genome.sparkSession.createDataFrame([(seqname, length, last)], "seqname string, length long, ord long"), allowMissingColumns=True)


def sequence_length(genome: DataFrame, seqname: str) -> int:
    found = genome.where(F.col("seqname") == seqname).select("length").first()
    if found is None:
        raise ValueError(f"no sequence {seqname}")
    return found.length


def filter_sequences(genome: DataFrame, keep: Column) -> DataFrame:
    return genome.where(keep)


def total_length(genome: DataFrame) -> DataFrame:
    return genome.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
