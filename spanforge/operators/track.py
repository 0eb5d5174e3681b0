"""Binned signal tracks.

A track is a table (seqname, bin, value) with a bin size; a bin without data has
no value (null, never NaN). Tracks are dense: every bin of the grid has a row.
Operators return new tracks. Ordered operators work on blocks of bins, so long
sequences are cut into many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce as fold

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_of, carried, halo_window, with_halo

BLOCK = 1 << 14
KEYS = ["seqname"]


def grid(genome: DataFrame, bin_size: int) -> DataFrame:
    """Every whole bin (seqname, bin) of the genome; the partial one at an end is left out."""
    n = F.floor(F.col("length") / bin_size)
    return genome.where(n > 0).select("seqname", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))


@dataclass(frozen=True)
class Track:
    rows: DataFrame
    bin_size: int = 10
    genome: DataFrame | None = None
    name: str = ""

    @classmethod
    def from_rows(cls, rows: DataFrame, genome: DataFrame, bin_size: int, name: str = "", init: float | None = None) -> Track:
        """A dense track; bins without a row get ``init``."""
        dense = grid(genome, bin_size).join(rows.select("seqname", "bin", "value"), ["seqname", "bin"], "left")
        value = clean(F.col("value"))
        return cls(dense.withColumn("value", value if init is None else F.coalesce(value, F.lit(float(init)))), bin_size, genome, name)

    def with_rows(self, rows: DataFrame) -> Track:
        return replace(self, rows=rows)

    # Access and projection

    def at(self, seqname: str, position: int) -> DataFrame:
        return self.rows.where((F.col("seqname") == seqname) & (F.col("bin") == position // self.bin_size))

    def slice(self, seqname: str, start: int, end: int) -> DataFrame:
        """Bins floor(start / size) up to, not with, floor(end / size)."""
        return self.rows.where((F.col("seqname") == seqname) & (F.col("bin") >= start // self.bin_size) & (F.col("bin") < end // self.bin_size))

    def filter_genome(self, keep: Column) -> Track:
        """Drops the sequences that fail ``keep``, from the rows and the genome alike."""
        genome = None if self.genome is None else self.genome.where(keep)
        return replace(self, rows=self.rows.where(keep), genome=genome)

    def map(self, f: Callable[[Column], Column]) -> Track:
        return self.with_rows(self.rows.withColumn("value", clean(f(F.col("value")).cast("double"))))

    def map_with(self, f: Callable[[Column, Column, Column], Column]) -> Track:
        """``f(seqname, position, value)`` for every bin."""
        v = f(F.col("seqname"), F.col("bin") * self.bin_size, F.col("value"))
        return self.with_rows(self.rows.withColumn("value", clean(v.cast("double"))))

    def fold(self, f: Callable[[float, float], float], start: float) -> DataFrame:
        """Ordered left fold over each sequence's values: (seqname, value). For folds that no aggregate gives."""
        def run(key, frame):
            x = start
            for v in frame.sort_values("bin")["value"].tolist():
                x = f(x, v)
            return pd.DataFrame({"seqname": [key[0]], "value": [float(x)]})

        return self.rows.groupBy("seqname").applyInPandas(run, "seqname string, value double")

    def reduce(self, agg: Column) -> DataFrame:
        return self.rows.groupBy("seqname").agg(agg.alias("value"))

    # Windows

    def window_map(self, size: int, agg: Callable[[Column], Column]) -> Track:
        """Aggregate over ``size`` bins from bin - size // 2 on; what lies outside has no value."""
        before, after = size // 2, size - size // 2 - 1
        new = halo_window(self.rows, KEYS, "bin", before, after, {"_v": lambda w: agg(F.col("value")).over(w.rowsBetween(-before, after))}, BLOCK)
        return self.with_rows(new.withColumn("value", F.col("_v")).drop("_v"))

    def window_apply(self, size: int, f: Callable[[list], float]) -> Track:
        """Any Python function of the window's values, with None for missing ones and those outside."""
        before, after = size // 2, size - size // 2 - 1
        framed = halo_window(self.rows, KEYS, "bin", before, after, {"_w": lambda w: F.collect_list(F.struct("bin", "value")).over(w.rowsBetween(-before, after))}, BLOCK)

        @F.pandas_udf("double")
        def run(bins: pd.Series, windows: pd.Series) -> pd.Series:
            out = []
            for at, window in zip(bins, windows, strict=True):
                have = {x["bin"]: x["value"] for x in window}
                out.append(f([have.get(b) for b in range(at - before, at + after + 1)]))
            return pd.Series(out, dtype="float64")

        return self.with_rows(framed.withColumn("value", clean(run("bin", "_w"))).drop("_w"))

    def smooth_adaptive(self, sizes: list[int], min_counts: float) -> Track:
        """For each bin the mean over the first window, in ascending size, that sums to ``min_counts``, else over the largest.

        Windows are moved inward at a sequence's ends; bins closer to an end than
        half the smallest window have no value.
        """
        sizes = sorted(sizes)
        reach = max(sizes)
        lengths = self.rows.groupBy("seqname").agg((F.max("bin") + 1).alias("_n"))
        rows = self.rows.join(lengths, "seqname").withColumn("_x", F.coalesce("value", F.lit(0.0)))
        sums = {}
        for s in sizes:
            half = s // 2

            sums[f"_s{s}"] = lambda w, s=s, half=half: F.sum("_x").over(w.rowsBetween(-half, s - half - 1))
            sums[f"_head{s}"] = lambda w, s=s: F.sum(F.when(F.col("bin") < s, F.col("_x"))).over(w.rowsBetween(-reach, reach))
            sums[f"_tail{s}"] = lambda w, s=s: F.sum(F.when(F.col("bin") >= F.col("_n") - s, F.col("_x"))).over(w.rowsBetween(-reach, reach))
        done = halo_window(rows, KEYS, "bin", reach, reach, sums, BLOCK)
        value = None
        for s in reversed(sizes):
            half = s // 2
            total = F.when(F.col("bin") < half, F.col(f"_head{s}")).when(F.col("bin") + s - half > F.col("_n"), F.col(f"_tail{s}")).otherwise(F.col(f"_s{s}"))
            mean = total / F.least(F.lit(s), F.col("_n"))
            value = mean if value is None else F.when(total >= min_counts, mean).otherwise(value)
        inner = (F.col("bin") >= sizes[0] // 2) & (F.col("bin") < F.col("_n") - (sizes[0] - 1) // 2)
        return self.with_rows(done.select("seqname", "bin", F.when(inner, value).alias("value")))

    # Runs

    def runs(self) -> DataFrame:
        """Maximal runs of equal values (seqname, start, end, strand, value); each missing bin is a row of its own."""
        changes = halo_window(self.rows, KEYS, "bin", 1, 0, {"_prev": lambda w: F.lag("value").over(w), "_has": lambda w: F.lag(F.lit(True)).over(w)}, BLOCK)
        new = F.col("_has").isNull() | F.col("value").isNull() | F.col("_prev").isNull() | (F.col("value") != F.col("_prev"))
        marked = changes.withColumn("_run", F.when(new, F.col("bin"))).withColumn("_b", block_of("bin", BLOCK))
        named = carried(marked.select("seqname", "bin", "value", "_b", "_run"), KEYS, ["bin"], "_b", "_run", "last")
        each = named.groupBy("seqname", "_run").agg(F.min("bin").alias("_a"), F.max("bin").alias("_z"), F.first("value").alias("value"))
        return each.select("seqname", (F.col("_a") * self.bin_size).alias("start"), ((F.col("_z") + 1) * self.bin_size).alias("end"), F.lit("*").alias("strand"), "value")

    # Summaries

    def summary(self) -> DataFrame:
        """One row: valid, min, max, sum, sum_squares, mean, variance over bins with a value."""
        v = F.col("value")
        s = self.rows.agg(F.count(v).alias("valid"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_squares"))
        mean = F.try_divide("sum", "valid")
        return s.withColumn("mean", mean).withColumn("variance", F.try_divide("sum_squares", "valid") - mean * mean)

    def histogram(self, bins: int, cumulative: bool = False) -> DataFrame:
        """(x, count): ``bins`` equal steps from the least to the largest value, the largest in the last; 0 counts each value."""
        have = self.rows.where("value is not null").select("value")
        if bins == 0:
            out = have.groupBy(F.col("value").alias("x")).agg(F.count("*").alias("count"))
        else:
            lo, hi = have.agg(F.min("value"), F.max("value")).first()
            if lo is None:
                return have.selectExpr("value as x", "0L as count").limit(0)
            step = (hi - lo) / bins if hi > lo else 1.0
            at = F.least(F.floor((F.col("value") - lo) / step), F.lit(bins - 1)).cast("long")
            counts = have.groupBy(at.alias("_i")).agg(F.count("*").alias("count"))
            steps = have.sparkSession.range(bins).select(F.col("id").alias("_i"))
            out = steps.join(counts, "_i", "left").select((F.lit(lo) + F.col("_i") * step).alias("x"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
        if cumulative:
            out = cumulated(out, "x", "count")
        return out

    def distribution(self) -> DataFrame:
        """Distinct values with their counts and the counts up to them: (value, count, cumulative)."""
        counts = self.rows.where("value is not null").groupBy("value").agg(F.count("*").alias("count"))
        return cumulated(counts.withColumn("cumulative", F.col("count")), "value", "cumulative")

    def to_quantiles(self) -> Track:
        """Each value's share of values that are not larger."""
        d = self.distribution()
        total = self.rows.agg(F.count("value").alias("_n"))
        ranks = d.crossJoin(F.broadcast(total)).select("value", (F.col("cumulative") / F.col("_n")).alias("_q"))  # one row
        return self.with_rows(self.rows.join(ranks, "value", "left").select("seqname", "bin", F.col("_q").alias("value")))

    def quantile_normalize(self, reference: Track) -> Track:
        """Maps the distribution onto the reference's.

        The least value goes to the least reference value, every other one to the
        least later reference value whose share reaches its own; a value that none
        reaches stays.
        """
        return self.with_rows(self.rows.join(quantile_map(self, reference), "value", "left").select("seqname", "bin", F.coalesce("_to", "value").alias("value")))

    # Tables

    def as_ranges(self) -> DataFrame:
        return self.runs().where("value is not null")


def as_bed6(track: Track) -> DataFrame:
    """A track's runs as BED6 rows: no name, and the rounded value as score."""
    return track.as_ranges().select("seqname", "start", "end", "strand", F.lit(".").alias("name"), F.round("value").cast("long").alias("score"))


def clean(c: Column) -> Column:
    """NaN as null."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def cumulated(df: DataFrame, order: str, count: str) -> DataFrame:
    """Running total of ``count`` by ``order``, over sorted ranges of it and then over their totals."""
    ranged = df.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    from ..shared import write_table

    kept, _ = write_table(ranged, "cumulated")
    totals = kept.groupBy("_p").agg(F.sum(count).alias("_t"))  # one row a partition
    prior = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    own = kept.withColumn(count, F.sum(count).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(F.broadcast(prior), "_p").withColumn(count, F.col(count) + F.col("_before")).drop("_p", "_before")


def quantile_map(track: Track, reference: Track) -> DataFrame:
    """(value, _to) of each distinct value that has an image.

    Shares are compared as cumulative counts times the other side's total, which is exact.
    """
    mine, theirs = track.distribution(), reference.distribution()
    n, m = (t.rows.agg(F.count("value").alias("_n")).first()[0] for t in (track, reference))
    a = mine.select("value", (F.col("cumulative") * m).alias("_f"), F.lit(0).alias("_side"))
    firsts = theirs.agg(F.min("value").alias("_least")), mine.agg(F.min("value").alias("_least"))
    least_ref, least_in = (f.first()[0] for f in firsts)
    b = theirs.where(F.col("value") > F.lit(least_ref)).select("value", (F.col("cumulative") * n).alias("_f"), F.lit(1).alias("_side")) if least_ref is not None else None
    if b is None or least_in is None:
        return mine.select("value", F.lit(None).cast("double").alias("_to"))
    # on the line of shares the image is the next reference value at or after the input; ties read the input first
    both = a.unionByName(b).withColumn("_ref", F.when(F.col("_side") == 1, F.col("value"))).withColumn("_neg", -F.col("_f"))
    size = max(1, (n * m) >> 10)
    both = both.withColumn("_blk", block_of("_neg", size)).withColumn("_turn", -F.col("_side")).withColumn("_all", F.lit(0)).withColumn("_down", -F.coalesce("_ref", F.lit(0.0)))
    found = carried(both.select("_all", "value", "_side", "_neg", "_turn", "_down", "_ref", "_blk"), ["_all"], ["_neg", "_turn", "_down"], "_blk", "_ref", "last")
    image = F.when(F.col("value") == F.lit(least_in), F.lit(least_ref)).otherwise(F.col("_ref"))
    return found.where("_side = 0").select("value", image.alias("_to"))


def joined(tracks: list[Track]) -> DataFrame:
    """(seqname, bin, v0, v1, ...) over the bins of all tracks; a track that lacks a sequence has no value there."""
    if len({t.bin_size for t in tracks}) != 1:
        raise ValueError("tracks differ in bin size")
    sides = [t.rows.select("seqname", "bin", F.col("value").alias(f"v{i}")) for i, t in enumerate(tracks)]
    return fold(lambda a, b: a.join(b, ["seqname", "bin"], "full_outer"), sides)


def map_list(tracks: list[Track], f: Callable[[list[Column]], Column]) -> Track:
    """``f`` over the bins' values, one column a track."""
    both = joined(tracks)
    value = clean(f([F.col(f"v{i}") for i in range(len(tracks))]).cast("double"))
    return tracks[0].with_rows(both.select("seqname", "bin", value.alias("value")))


def window_map_list(tracks: list[Track], size: int, f: Callable[[list[Callable[[Callable[[Column], Column]], Column]]], Column]) -> Track:
    """``f`` gets for each track a function that applies an aggregate to the track's window."""
    before, after = size // 2, size - size // 2 - 1
    both = joined(tracks)
    overs = lambda w: [lambda agg, i=i: agg(F.col(f"v{i}")).over(w.rowsBetween(-before, after)) for i in range(len(tracks))]
    new = halo_window(both, KEYS, "bin", before, after, {"_v": lambda w: f(overs(w))}, BLOCK)
    return tracks[0].with_rows(new.select("seqname", "bin", clean(F.col("_v").cast("double")).alias("value")))


def map_udf(tracks: list[Track], f: Callable) -> Track:
    """A Python plug-in ``f(seqname, position, values)`` for every bin, in Arrow batches."""
    both = joined(tracks)

    @F.pandas_udf("double")
    def run(seqname: pd.Series, position: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([f(s, p, list(v)) for s, p, v in zip(seqname, position, values, strict=True)], dtype="float64")

    values = F.array(*[F.col(f"v{i}") for i in range(len(tracks))])
    return tracks[0].with_rows(both.select("seqname", "bin", clean(run("seqname", F.col("bin") * tracks[0].bin_size, values)).alias("value")))


def joint_positive(tracks: list[Track], thresholds: list[float]) -> DataFrame:
    """Maximal runs where every track is above its threshold, with the first bin of the largest sum as summit.

    (seqname, start, end, strand, summit, summit_sum, values)
    """
    both = joined(tracks)
    cols = [F.col(f"v{i}") for i in range(len(tracks))]
    above = fold(lambda a, b: a & b, [c.isNotNull() & (c > t) for c, t in zip(cols, thresholds, strict=True)])
    up = both.where(above).withColumn("_sum", fold(lambda a, b: a + b, cols))
    first = halo_window(up, KEYS, "bin", 1, 0, {"_prev": lambda w: F.lag("bin").over(w)}, BLOCK)
    marked = first.withColumn("_run", F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("bin") - 1), F.col("bin"))).withColumn("_b", block_of("bin", BLOCK))
    named = carried(marked.drop("_prev"), KEYS, ["bin"], "_b", "_run", "last")
    size = tracks[0].bin_size
    top = F.max_by(F.struct("bin", "_sum", F.array(*cols).alias("values")), F.struct("_sum", -F.col("bin")))
    each = named.groupBy("seqname", "_run").agg(F.min("bin").alias("_a"), F.max("bin").alias("_z"), top.alias("_t"))
    return each.select(
        "seqname", (F.col("_a") * size).alias("start"), ((F.col("_z") + 1) * size).alias("end"), F.lit("*").alias("strand"),
        (F.col("_t.bin") * size).alias("summit"), F.col("_t._sum").alias("summit_sum"), F.col("_t.values").alias("values"),
    )


def cross_correlation(a: Track, b: Track, start: int, stop: int, normalize: bool = True) -> DataFrame:
    """(lag, y) for lags start, start + bin size, ... below ``stop`` (in positions).

    The sum of products over the pairs of bins that exist, by the number of all
    bins. ``normalize`` first centres both tracks and then divides by the root of
    the product of their variances. Bins without a value count as 0.
    """
    size = a.bin_size
    both = joined([a, b]).select("seqname", "bin", F.coalesce("v0", F.lit(0.0)).alias("x"), F.coalesce("v1", F.lit(0.0)).alias("y"))
    s = both.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("y") * F.col("y")).alias("yy")).first()
    if not s.n:
        return both.select(F.lit(0).cast("long").alias("lag"), "y").limit(0)
    mx, my, scale = (s.mx, s.my, ((s.xx - s.mx**2) * (s.yy - s.my**2)) ** 0.5) if normalize else (0.0, 0.0, 1.0)
    lags = both.sparkSession.range(start // size * size, stop, size).select((F.col("id") if start % size == 0 else F.col("id") + start % size).alias("lag"))
    first, count = start // size, -(-(stop - start // size * size) // size)
    centred = both.select("seqname", "bin", (F.col("x") - mx).alias("x"), (F.col("y") - my).alias("y"))
    # blocks of bins with the bins that the lags reach, so that every lag of a block is one product of two arrays
    width = max(4096, 4 * (abs(first) + count))
    spread = with_halo(centred, "bin", max(0, -first), max(0, first + count), width)

    def products(table: pa.Table) -> pa.Table:
        bins, own = table.column("bin").to_numpy(), table.column("_own").to_numpy(zero_copy_only=False)
        low = int(bins.min()) + min(first, 0)
        x, y = np.zeros(int(bins.max()) - low + 1), np.zeros(int(bins.max()) - low + 1 + max(0, first + count))
        x[bins[own] - low] = table.column("x").to_numpy()[own]
        y[bins - low] = table.column("y").to_numpy()
        at = np.flatnonzero(x)
        p = [float((x[at] * y[at + k]).sum()) if len(at) else 0.0 for k in range(first, first + count)]
        return pa.table({"lag": pa.array([k * size + start % size for k in range(first, first + count)], pa.int64()), "p": p})

    sums = spread.groupBy("seqname", "_block").applyInArrow(products, "lag long, p double").groupBy("lag").agg(F.sum("p").alias("p"))
    return lags.join(sums, "lag", "left").select("lag", F.try_divide(F.coalesce("p", F.lit(0.0)) / s.n, F.lit(scale)).alias("y"))
