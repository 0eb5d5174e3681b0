"""Read filters and pairing, on batch and streaming tables alike.

A read is (seqname, start, end, strand, mapq, duplicate, paired_end) and
whatever else its row holds. Filters are switched on by their arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the bits of an alignment's flag, from the lowest (fixed values).
FLAG_BITS = ("paired", "proper_pair", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first_in_pair", "second_in_pair", "secondary", "failed_qc", "duplicate", "supplementary")
#: CIGAR operations that use up the reference (fixed values).
ON_REFERENCE = "MDN=X"


def flag_bit(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(1 << FLAG_BITS.index(name)) != 0


def flag_bits(flag: Column) -> dict[str, Column]:
    return {n: flag_bit(flag, n) for n in FLAG_BITS}


def cigar_length(cigar: Column) -> Column:
    """Reference bases under a CIGAR, given as text or as an array of (n, op)."""
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{ON_REFERENCE}]"), F.lit(1)), lambda n: n.cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)


def cigar_array_length(cigar: Column) -> Column:
    on = F.filter(cigar, lambda c: c["op"].isin(*ON_REFERENCE))
    return F.aggregate(on, F.lit(0).cast("long"), lambda a, c: a + c["n"])


def paired_as_single(reads: DataFrame, on: bool = False) -> DataFrame:
    return reads.withColumn("paired_end", F.lit(False)) if on else reads


def keep_paired(reads: DataFrame, on: bool = False) -> DataFrame:
    return reads.where("paired_end") if on else reads


def keep_single(reads: DataFrame, on: bool = False) -> DataFrame:
    return reads.where("not paired_end") if on else reads


def drop_duplicates(reads: DataFrame, on: bool = False) -> DataFrame:
    return reads.where("not duplicate") if on else reads


def keep_strand(reads: DataFrame, strand: str = "*") -> DataFrame:
    return reads if strand == "*" else reads.where(F.col("strand") == strand)


def keep_mapq(reads: DataFrame, least: int = 0) -> DataFrame:
    return reads.where(F.col("mapq") >= least) if least > 0 else reads


def keep_lengths(reads: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """Lengths from ``least`` to ``most``; 0 leaves the upper end open, both 0 switch the filter off."""
    length = F.col("end") - F.col("start")
    if least == most == 0:
        return reads
    kept = reads.where(length >= least)
    return kept.where(length <= most) if most else kept


def shift(reads: DataFrame, forward: int = 0, reverse: int = 0) -> DataFrame:
    """Moves forward reads right and reverse reads left, keeping their lengths, not below zero."""
    if forward == reverse == 0:
        return reads
    by = F.when(F.col("strand") == "+", F.lit(forward)).when(F.col("strand") == "-", F.lit(-reverse)).otherwise(0)
    start = F.greatest(F.col("start") + by, F.lit(0)).cast("long")
    return reads.withColumns({"start": start, "end": start + F.col("end") - F.col("start")})


def extend(reads: DataFrame, d: int) -> DataFrame:
    """Single-end reads to ``d`` bases from their 5' end; those without a strand are dropped. Paired reads stay."""
    if d <= 0:
        return reads
    single = ~F.col("paired_end")
    start = F.when(single & (F.col("strand") == "-"), F.greatest(F.col("end") - d, F.lit(0))).otherwise(F.col("start"))
    end = F.when(single & (F.col("strand") == "+"), F.col("start") + d).otherwise(F.col("end"))
    return reads.where(F.col("paired_end") | F.col("strand").isin("+", "-")).withColumns({"start": start, "end": end})


def filtered(reads: DataFrame, paired_only=False, single_only=False, as_single=False, lengths=(0, 0), no_duplicates=False, mapq=0, strand="*", shifts=(0, 0)) -> DataFrame:
    """All filters in their fixed order; Catalyst folds them into one."""
    r = keep_single(keep_paired(reads, paired_only), single_only)
    r = drop_duplicates(keep_lengths(paired_as_single(r, as_single), *lengths), no_duplicates)
    return shift(keep_strand(keep_mapq(r, mapq), strand), *shifts)


def mate_pairs(reads: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The first two records of each name, side by side: every column with suffix 1 and 2.

    The lesser by ``order`` is the first. Names with one record give no row.
    """
    rows = F.struct(*order, *[c for c in reads.columns if c not in (*order, name)])
    two = reads.groupBy(name).agg(F.min(rows).alias("_a"), F.max(rows).alias("_b"), F.count("*").alias("_n")).where("_n = 2")
    cols = [c for c in reads.columns if c != name]
    return two.select(name, *[F.col(f"_a.{c}").alias(f"{c}1") for c in cols], *[F.col(f"_b.{c}").alias(f"{c}2") for c in cols])


def pair_fragments(pairs: DataFrame, strand_specific: bool = False) -> DataFrame:
    """One read a pair on one sequence: from the first start to the second end, lesser mapq, either's duplicate mark."""
    same = pairs.where("seqname1 = seqname2")
    second = F.col("strand2") if strand_specific else F.lit("*")
    return same.select(
        F.col("seqname1").alias("seqname"), F.least("start1", "start2").alias("start"), F.greatest("end1", "end2").alias("end"), second.alias("strand"),
        F.least("mapq1", "mapq2").alias("mapq"), (F.col("duplicate1") | F.col("duplicate2")).alias("duplicate"), F.lit(True).alias("paired_end"),
    )
