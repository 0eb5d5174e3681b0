"""Binned range queries over pre-aggregated levels of a track.

A level is a table (seqname, bin, valid, min, max, sum, sum_squares) at a
coarser bin size, written sorted so that readers prune by sequence and
position. A query takes the coarsest level that divides its bins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import halo_window
from .track import Track

STATISTICS = ["valid", "min", "max", "sum", "sum_squares"]
MAX_LEVELS = 11
ITEMS_PER_SLOT = 1024

#: Summaries of a bin by name.
SUMMARIES = {
    "mean": lambda s: F.try_divide(s("sum"), s("valid")),
    "max": lambda s: s("max"),
    "min": lambda s: s("min"),
    "discrete mean": lambda s: F.floor(F.try_divide(s("sum"), s("valid"))) + 0.5,
    "discrete max": lambda s: F.floor(s("max")),
    "discrete min": lambda s: F.floor(s("min")),
    "variance": lambda s: F.try_divide(s("sum_squares"), s("valid")) - F.pow(F.try_divide(s("sum"), s("valid")), F.lit(2)),
}


def summary(name: str | Callable[[Callable[[str], Column]], Column], s=F.col) -> Column:
    """A summary by its name, or one of the caller's: a function that gets a function from a statistic's name to its column."""
    if callable(name):
        return name(s).cast("double")
    if name not in SUMMARIES:
        raise ValueError(f"summary {name!r} is none of {sorted(SUMMARIES)}")
    return SUMMARIES[name](s).cast("double")


def statistics(rows: DataFrame, keys: list) -> DataFrame:
    v = F.col("value")
    return rows.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("valid"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_squares"))


def merged(stats: DataFrame, keys: list) -> DataFrame:
    """Adds up summaries, which merge in any order."""
    return stats.groupBy(*keys).agg(F.sum("valid").alias("valid"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("sum_squares").alias("sum_squares"))


def level_sizes(bin_size: int, longest: int, items: int = ITEMS_PER_SLOT) -> list[int]:
    """Bin sizes of the levels: from max(100, 4 bins) by factors of 4 bins while the longest sequence needs more than a slot."""
    out, size = [], max(100, 4 * bin_size)
    while longest / size > items and len(out) < MAX_LEVELS:
        out.append(size)
        size *= 4 * bin_size
    return out


@dataclass
class Rollups:
    track: Track
    levels: dict[int, DataFrame]

    @classmethod
    def build(cls, track: Track, sizes: list[int], path: str | None = None) -> Rollups:
        """Levels in ascending size, each from the coarsest earlier one that divides it; written under ``path`` if given."""
        levels: dict[int, DataFrame] = {}
        for size in sorted(sizes):
            if size % track.bin_size:
                continue
            base = max((s for s in levels if size % s == 0), default=None)
            if base is None:
                made = statistics(track.rows, ["seqname", F.floor(F.col("bin") * track.bin_size / size).cast("long").alias("bin")])
            else:
                made = merged(levels[base], ["seqname", F.floor(F.col("bin") * base / size).cast("long").alias("bin")])
            if path:
                made.repartitionByRange("seqname", "bin").sortWithinPartitions("seqname", "bin").write.mode("overwrite").parquet(f"{path}/level={size}")
                made = track.rows.sparkSession.read.parquet(f"{path}/level={size}")
            levels[size] = made
        return cls(track, levels)

    @classmethod
    def open(cls, spark: SparkSession, track: Track, sizes: list[int], path: str) -> Rollups:
        return cls(track, {s: spark.read.parquet(f"{path}/level={s}") for s in sizes})

    def choose(self, bin_size: int) -> int | None:
        """The coarsest level that fits, or none for the raw bins."""
        return max((s for s in self.levels if s <= bin_size and bin_size % s == 0), default=None)

    def query(self, seq_regex: str, start: int, end: int, bin_size: int) -> DataFrame:
        """Summaries (seqname, start, end, valid, ...) of bins wholly inside the rounded range.

        Sequences are those whose whole name matches; bin size 0 gives the raw bins.
        """
        t = self.track
        if bin_size:
            start, end = start // bin_size * bin_size, -(-end // bin_size) * bin_size
        size = bin_size or t.bin_size
        level = self.choose(bin_size) if bin_size else None
        if level is None:
            width = t.bin_size
            base = t.rows.select("seqname", "bin", F.when(F.col("value").isNotNull(), 1).cast("long").alias("valid"), F.col("value").alias("min"), F.col("value").alias("max"), F.col("value").alias("sum"), (F.col("value") * F.col("value")).alias("sum_squares")).where("valid = 1")
        else:
            width, base = level, self.levels[level]
        at = F.col("bin") * width
        inside = base.where(F.col("seqname").rlike(f"^(?:{seq_regex})$") & (at >= start) & (at + width <= end))
        out = merged(inside, ["seqname", F.floor(at / size).cast("long").alias("_b")])
        return out.select("seqname", (F.col("_b") * size).alias("start"), ((F.col("_b") + 1) * size).alias("end"), *STATISTICS)

    def slice(self, seqname: str, start: int, end: int, f: str = "mean", bin_size: int = 0, overlap: int = 0, init: float | None = None) -> DataFrame:
        """(nth, value) for each of the floor((end - start) / size) bins; ``overlap`` widens a bin's summary by so many on each side."""
        size = bin_size or self.track.bin_size
        n = max(0, (end - start) // size)
        spark = self.track.rows.sparkSession
        have = self.query(_escaped(seqname), start, end, bin_size).select(F.floor((F.col("start") - start) / size).cast("long").alias("nth"), *STATISTICS)
        cells = spark.range(n).select(F.col("id").alias("nth")).join(have, "nth", "left").withColumn("seqname", F.lit(seqname))
        if overlap:
            aggs = {"valid": F.sum, "min": F.min, "max": F.max, "sum": F.sum, "sum_squares": F.sum}
            cells = halo_window(cells, ["seqname"], "nth", overlap, overlap, {f"_{c}": (lambda w, c=c, a=a: a(c).over(w.rowsBetween(-overlap, overlap))) for c, a in aggs.items()})
            value = summary(f, lambda c: F.col(f"_{c}"))
        else:
            value = summary(f)
        return cells.select("nth", F.coalesce(value, F.lit(init).cast("double")).alias("value"))


def _escaped(name: str) -> str:
    import re

    return re.escape(name)


def adjacent_records(records: DataFrame, bin_size: int) -> DataFrame:
    """Summaries of irregular records (seqname, start, end, value) packed in order until a bin's width is reached.

    A gap between records adds its bases to ``valid`` and 0 to least and largest.
    """
    import pandas as pd

    def run(key, frame):
        out, cur = [], None
        for start, end, v in frame.sort_values("start")[["start", "end", "value"]].itertuples(index=False):
            if v is None or v != v:
                continue
            if cur and (cur[1] - cur[0] >= bin_size or start >= cur[0] + bin_size):
                out.append(cur)
                cur = None
            if cur is None:
                cur = [start, end, 1.0, v, v, v, v * v]
            else:
                if start > cur[1]:
                    cur[2] += start - cur[1]
                    cur[3], cur[4] = min(cur[3], 0.0), max(cur[4], 0.0)
                cur = [cur[0], end, cur[2] + 1, min(cur[3], v), max(cur[4], v), cur[5] + v, cur[6] + v * v]
        if cur:
            out.append(cur)
        return pd.DataFrame([(key[0], *c) for c in out], columns=["seqname", "start", "end", *STATISTICS])

    return records.groupBy("seqname").applyInPandas(run, "seqname string, start long, end long, valid double, min double, max double, sum double, sum_squares double")


def _region_bins(regions: DataFrame, track: Track, bin_size: int) -> DataFrame:
    """The track's bins inside each region: row_id, nth (of bins of ``bin_size`` from the region's start), value."""
    size = track.bin_size
    bins = F.explode(F.sequence(F.ceil(F.col("start") / size), F.floor(F.col("end") / size) - 1))
    have = regions.where(F.floor(F.col("end") / size) > F.ceil(F.col("start") / size)).select("row_id", "seqname", "start", "end", bins.alias("bin"))
    met = have.join(track.rows.where("value is not null"), ["seqname", "bin"])
    return met.withColumn("nth", F.floor((F.col("bin") * size - F.col("start")) / bin_size).cast("long"))


def extract_regions(regions: DataFrame, track: Track, f: str = "mean", bin_size: int | None = None, init: float | None = None, reverse_minus: bool = False) -> DataFrame:
    """(row_id, nth, value): the summary of each bin of each region, from its start; reversed on ``-`` if asked."""
    size = bin_size or track.bin_size
    n = F.floor((F.col("end") - F.col("start")) / size)
    cells = regions.where(n > 0).select("row_id", "strand", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("nth"))
    have = statistics(_region_bins(regions, track, size), ["row_id", "nth"])
    out = cells.join(have, ["row_id", "nth"], "left")
    nth = F.when((F.col("strand") == "-") & F.lit(reverse_minus), F.col("_n") - 1 - F.col("nth")).otherwise(F.col("nth"))
    return out.select("row_id", nth.alias("nth"), F.coalesce(summary(f), F.lit(init).cast("double")).alias("value"))


def region_values(regions: DataFrame, track: Track, name: str, **options) -> DataFrame:
    """``regions`` with a list column of their bins' summaries, which replaces one of that name."""
    cells = extract_regions(regions, track, **options).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("_v"))
    return regions.drop(name).join(cells, "row_id", "left").withColumn(name, F.coalesce("_v.value", F.array().cast("array<double>"))).drop("_v")


def region_track(regions: DataFrame, track: Track, f: str = "mean") -> Track:
    """A track of the extracted values at their places; later rows overwrite earlier ones."""
    cells = extract_regions(regions, track, f).join(regions.select("row_id", "seqname", "start"), "row_id")
    at = F.floor((F.col("start") + F.col("nth") * track.bin_size) / track.bin_size).cast("long")
    last = cells.where("value is not null").groupBy("seqname", at.alias("bin")).agg(F.max_by("value", "row_id").alias("value"))
    return Track.from_rows(last, track.genome, track.bin_size)


def region_score(regions: DataFrame, track: Track, f: str = "mean") -> DataFrame:
    """(row_id, score): one summary over the bins inside each region, null without data."""
    have = statistics(_region_bins(regions, track, 1).drop("nth"), ["row_id"])
    return regions.select("row_id").join(have, "row_id", "left").select("row_id", summary(f).alias("score"))


def keep_scored(regions: DataFrame, track: Track, threshold: float, above: bool = True, f: str = "mean") -> DataFrame:
    """Regions on one side of a threshold; those without data stay."""
    ok = F.col("score").isNull() | ((F.col("score") >= threshold) if above else (F.col("score") <= threshold))
    return regions.join(region_score(regions, track, f).where(ok).select("row_id"), "row_id", "left_semi")


