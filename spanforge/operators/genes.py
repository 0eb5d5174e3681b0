"""Gene tables: promoters, expression, merging by attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_genes(genes: DataFrame) -> DataFrame:
    """Genes have names, a coding range and a strand of + or -."""
    kinds = dict(genes.dtypes)
    if kinds.get("names") != "string" or not kinds.get("cds", "").startswith("struct<from:"):
        raise ValueError("genes need names (string) and cds (struct of from and to)")
    return genes.withColumn("strand", F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(F.raise_error("gene without a strand")))


def find_gene(genes: DataFrame, name: str) -> DataFrame:
    """The gene of a name; of several the last."""
    return last_by_name(genes.where(F.col("names") == name))


def last_by_name(genes: DataFrame) -> DataFrame:
    """One row a name: the one with the largest row_id."""
    rows = F.struct(*[F.col(c) for c in genes.columns])
    return genes.groupBy("names").agg(F.max_by(rows, "row_id").alias("_g")).select("_g.*")


def promoters(genes: DataFrame, before: int, after: int) -> DataFrame:
    """Windows around the transcription starts; genes with one window are one row, their columns lists in row order.

    (seqname, start, end, strand, then a list for each other column but cds)
    """
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("start") - before).otherwise(F.col("end") - 1 - after)
    end = F.when(plus, F.col("start") + after + 1).otherwise(F.col("end") + before)
    bad = F.when(end < start, F.raise_error("inverted promoter window")).otherwise(start)
    own = genes.select(
        "row_id", "seqname", F.greatest(bad, F.lit(0)).alias("start"), F.greatest(end, F.lit(0)).alias("end"), "strand", *[c for c in genes.columns if c not in ("row_id", "seqname", "start", "end", "strand", "cds")]
    )
    meta = [c for c in own.columns if c not in ("row_id", "seqname", "start", "end", "strand")]
    lists = [F.transform(F.array_sort(F.collect_list(F.struct("row_id", F.col(c).alias("x")))), lambda s: s["x"]).alias(c) for c in meta]
    return own.groupBy("seqname", "start", "end").agg(F.min_by("strand", "row_id").alias("strand"), F.min("row_id").alias("row_id"), *lists)


def merge_by_attribute(rows: DataFrame, attribute: str) -> DataFrame:
    """One interval for each value of the attribute and sequence; strands that differ become ``*``. Empty values are left out."""
    have = rows.where(F.col(attribute).isNotNull() & (F.col(attribute) != ""))
    strand = F.when(F.count_distinct("strand") > 1, "*").otherwise(F.min("strand"))
    return have.groupBy(F.col(attribute).alias("name"), "seqname").agg(F.min("start").alias("start"), F.max("end").alias("end"), strand.alias("strand")).withColumn("score", F.lit(0).cast("long"))


def expression(genes: DataFrame, rows: DataFrame, gene_id: str, value: str) -> DataFrame:
    """``genes`` with ``expr``, the sum of ``value`` over rows of their name; 0 without rows. Unknown names count for nothing.

    Of genes that share a name the last gets the sum.
    """
    sums = rows.groupBy(F.col(gene_id).alias("names")).agg(F.sum(value).alias("_sum"))
    last = genes.groupBy("names").agg(F.max("row_id").alias("_last"))
    met = genes.drop("expr").join(last.join(sums, "names", "left"), "names", "left")
    return met.withColumn("expr", F.when(F.col("row_id") == F.col("_last"), F.coalesce("_sum", F.lit(0.0))).otherwise(0.0)).drop("_last", "_sum")
