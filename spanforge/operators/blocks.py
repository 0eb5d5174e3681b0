"""Ordered operators over blocks of positions.

A window over a whole sequence is one task however long the sequence is. These
helpers cut a sequence into blocks of positions, run the window inside each
block, and carry across blocks only a summary of one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block where the caller knows nothing better.
BLOCK = 1 << 16


def block_of(pos: str | Column, size: int) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / F.lit(size)).cast("long")


def with_halo(df: DataFrame, pos: str, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Adds ``_block`` and ``_own``: each row stands in its block, and as a guest in the blocks
    whose windows of ``before`` and ``after`` positions reach it."""
    own = block_of(pos, size)
    first, last = block_of(F.col(pos) - F.lit(after), size), block_of(F.col(pos) + F.lit(before), size)
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == own)


def halo_window(df: DataFrame, keys: list[str], pos: str, before: int, after: int, columns: dict, size: int = BLOCK) -> DataFrame:
    """Adds ``columns`` (name to a function of a window specification ordered by ``pos``).

    The specification has no frame; a frame set on it may look ``before`` and ``after`` positions far.
    """
    spread = with_halo(df, pos, before, after, max(size, 4 * (before + after)))
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    for name, make in columns.items():
        spread = spread.withColumn(name, make(w))
    return spread.where("_own").drop("_block", "_own")


def carried(df: DataFrame, keys: list[str], order: list[str], block: str, own: str, how: str) -> DataFrame:
    """Replaces ``own`` by its running ``last`` (non-null) or ``max`` over all rows of the key before and at the row.

    Only one row a block is looked at across blocks.
    """
    agg = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max}[how]
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("__run", agg(F.col(own)).over(inside))
    if how == "max":
        whole = df.groupBy(*keys, block).agg(F.max(own).alias("__sum"))
    else:
        whole = df.where(F.col(own).isNotNull()).groupBy(*keys, block).agg(F.max_by(own, F.struct(*order)).alias("__sum"))
        whole = df.select(*keys, block).distinct().join(whole, [*keys, block], "left")
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    prior = whole.withColumn("__prior", agg(F.col("__sum")).over(before)).drop("__sum")
    joined = run.join(prior, [*keys, block], "left")
    value = F.greatest("__run", "__prior") if how == "max" else F.coalesce("__run", "__prior")
    return joined.withColumn(own, value).drop("__run", "__prior")


def counted_before(df: DataFrame, keys: list[str], block: str, own: str, out: str, sign: int = 1, size: int = 4096) -> DataFrame:
    """Adds ``out``: how many rows of the key before this one, in the order of ``block`` times ``sign``, have a value in ``own``.

    Rows are counted within runs of ``size`` blocks; only one row a run is looked at across them.
    """
    placed = df.withColumn("__at", F.col(block) * sign).withColumn("__run", block_of("__at", size))
    inside = Window.partitionBy(*keys, "__run").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*keys, "__run").agg(F.count(own).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    prior = runs.withColumn("__prior", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return placed.withColumn(out, F.count(own).over(inside)).join(prior, [*keys, "__run"]).withColumn(out, F.col(out) + F.col("__prior")).drop("__at", "__run", "__prior")
