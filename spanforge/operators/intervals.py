"""Interval tables: joins, merging, selection.

An interval table has ``seqname``, ``start``, ``end`` (half-open), ``strand`` and
a unique ``row_id``; all other columns are metadata that follow their row.
Strands are ignored by joins. Empty intervals overlap nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import write_table
from .blocks import block_of, carried, counted_before

#: Width of the finest bins of an overlap join, and how much wider each next level is.
BIN = 1 << 10
FACTOR = 8
COORDS = ["seqname", "start", "end"]


def new_ranges(df: DataFrame, seqname: str, start: str, end: str, strand: str | None = None, row_id: str | None = None) -> DataFrame:
    """An interval table from named columns; without a strand column every strand is ``*``."""
    named = df.withColumnsRenamed({seqname: "seqname", start: "start", end: "end"} | ({strand: "strand"} if strand else {}) | ({row_id: "row_id"} if row_id else {}))
    if not strand:
        named = named.withColumn("strand", F.lit("*"))
    if not row_id:
        named = named.withColumn("row_id", F.monotonically_increasing_id())
    valid = F.when(F.col("start") > F.col("end"), F.raise_error("interval with start > end")).otherwise(F.col("start").cast("long"))
    return named.withColumn("start", valid).withColumn("end", F.col("end").cast("long"))


# Overlap joins --------------------------------------------------------------


def _level(width: Column, bin_width: int, top: int) -> Column:
    """The finest level at which an interval spans at most FACTOR bins and a part."""
    out = F.lit(top)
    for k in range(top - 1, -1, -1):
        out = F.when(width <= bin_width * FACTOR ** (k + 1), k).otherwise(out)
    return out


def _top_level(sides: list[DataFrame], bin_width: int) -> int:
    longest = max(s.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0 for s in sides)
    k = 0
    while longest > bin_width * FACTOR ** (k + 1):
        k += 1
    return k


def _binned(df: DataFrame, p: str, bin_width: int, top: int, touching: bool) -> DataFrame:
    last = F.col("end") if touching else F.greatest(F.col("end") - 1, F.col("start"))
    own = df.select(F.col("seqname").alias("_seq"), F.col("row_id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), last.alias("_last"))
    if not touching:
        own = own.where(F.col(f"{p}_start") < F.col(f"{p}_end"))
    if top == 0:
        own = own.withColumn("_level", F.lit(0)).withColumn(f"{p}_level", F.lit(0)).withColumn("_width", F.lit(bin_width))
    else:
        # an interval stands at its own level and, for longer partners, at every coarser one
        own = own.withColumn(f"{p}_level", _level(F.col(f"{p}_end") - F.col(f"{p}_start"), bin_width, top))
        own = own.withColumn("_level", F.explode(F.sequence(F.col(f"{p}_level"), F.lit(top))))
        own = own.withColumn("_width", (F.lit(bin_width) * F.pow(F.lit(FACTOR), F.col("_level"))).cast("long"))
    bins = F.sequence(F.floor(F.col(f"{p}_start") / F.col("_width")), F.floor(F.col("_last") / F.col("_width")))
    return own.withColumn("_bin", F.explode(bins)).withColumn(f"{p}_bin", F.floor(F.col(f"{p}_start") / F.col("_width"))).drop("_last", "_width")


def overlaps(query: DataFrame, subject: DataFrame, bin_width: int = BIN, touching: bool = False) -> DataFrame:
    """Pairs (seqname, q_id, q_start, q_end, s_id, s_start, s_end) of overlapping intervals, each once.

    Both sides are cut into bins and joined on (seqname, level, bin); a pair is
    kept in the first bin that both stand in. ``touching`` also counts intervals
    that only touch.
    """
    top = _top_level([query, subject], bin_width)
    q, s = _binned(query, "q", bin_width, top, touching), _binned(subject, "s", bin_width, top, touching)
    meets = (F.col("q_start") <= F.col("s_end")) & (F.col("s_start") <= F.col("q_end")) if touching else (F.col("q_start") < F.col("s_end")) & (F.col("s_start") < F.col("q_end"))
    once = (F.col("_bin") == F.greatest("q_bin", "s_bin")) & (F.col("_level") == F.greatest("q_level", "s_level"))
    return q.join(s, ["_seq", "_level", "_bin"]).where(meets & once).select(F.col("_seq").alias("seqname"), "q_id", "q_start", "q_end", "s_id", "s_start", "s_end")


def overlap_semi(query: DataFrame, subject: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Rows of ``query`` that overlap some row of ``subject``."""
    hits = overlaps(query, subject, bin_width).select(F.col("q_id").alias("row_id")).distinct()
    return query.join(hits, "row_id", "left_semi")


def overlap_anti(query: DataFrame, subject: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Rows of ``query`` that overlap no row of ``subject``."""
    hits = overlaps(query, subject, bin_width).select(F.col("q_id").alias("row_id")).distinct()
    return query.join(hits, "row_id", "left_anti")


def intersection(query: DataFrame, subject: DataFrame, bin_width: int = BIN) -> DataFrame:
    """One clipped row for each overlapping pair, with the query's strand and metadata."""
    pairs = overlaps(query, subject, bin_width).select(F.col("q_id").alias("row_id"), "s_id", F.greatest("q_start", "s_start").alias("start"), F.least("q_end", "s_end").alias("end"))
    return query.drop("start", "end").join(pairs, "row_id")


def range_intersection(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    """Start and end of two ranges' intersection; without one it is empty at the larger start."""
    start = F.greatest(a_start, b_start)
    return start, F.greatest(start, F.least(a_end, b_end))


# Nearest --------------------------------------------------------------------


def nearest(query: DataFrame, subject: DataFrame, k: int, bin_width: int = BIN, per_block: int = 32) -> DataFrame:
    """All touching or overlapping subjects at distance 0, and the k nearest others by gap.

    (q_id, s_id, distance): gaps are positive for subjects to the left of the
    query and negative to the right; equal gaps prefer the left, then row_id.
    Candidates come from the query's block of positions and from the k blocks
    beside it that hold subjects, so no query is compared with a whole sequence.
    """
    zero = overlaps(query, subject, bin_width, touching=True).select("q_id", "s_id", F.lit(0).cast("long").alias("distance"))
    n = subject.groupBy("seqname").agg(F.count("*").alias("n"), F.max("end").alias("m")).agg(F.sum("n"), F.sum("m")).first()
    size = max(1, int((n[1] or 1) / max(1, n[0] or 1) * per_block))
    left = _beside(query, subject, k, size, "left")
    right = _beside(query, subject, k, size, "right")
    rank = Window.partitionBy("q_id").orderBy("gap", "side", "s_id")
    others = left.unionByName(right).withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k)
    return zero.unionByName(others.select("q_id", "s_id", F.when(F.col("side") == 0, F.col("gap")).otherwise(-F.col("gap")).alias("distance")))


def _beside(query: DataFrame, subject: DataFrame, k: int, size: int, side: str) -> DataFrame:
    """Up to k nearest subjects wholly on one side of each query: (q_id, s_id, gap, side)."""
    at, mine, sign = (F.col("end"), "start", 1) if side == "left" else (F.col("start"), "end", -1)
    s = subject.select("seqname", F.col("row_id").alias("s_id"), at.alias("at"), block_of(at, size).alias("block"))
    q = query.select("seqname", F.col("row_id").alias("q_id"), F.col(mine).alias("q_at"), block_of(mine, size).alias("block"))
    # of each block the k subjects nearest to the blocks on the other side
    inward = Window.partitionBy("seqname", "block").orderBy(F.col("at") * -sign, "s_id")
    tops = s.withColumn("_n", F.row_number().over(inward)).where(F.col("_n") <= k).groupBy("seqname", "block").agg(F.collect_list(F.struct("at", "s_id")).alias("top"))
    blocks = q.select("seqname", "block").distinct().join(tops, ["seqname", "block"], "full_outer")
    # k blocks with subjects hold k subjects; blocks without pass on what they are given
    ranked = counted_before(blocks, ["seqname"], "block", "top", "_filled", sign)
    have = ranked.where("top is not null").select("seqname", F.col("_filled").alias("nth"), "top")
    asked = ranked.join(q.select("seqname", "block").distinct(), ["seqname", "block"]).where("_filled > 0").select("seqname", "block", F.explode(F.sequence(F.greatest(F.col("_filled") - k, F.lit(0)), F.col("_filled") - 1)).alias("nth"))
    carried_in = asked.join(have, ["seqname", "nth"]).select("seqname", "block", F.explode("top").alias("t")).select("seqname", "block", "t.at", "t.s_id")
    pool = s.select("seqname", "block", "at", "s_id").unionByName(carried_in)
    gap = (F.col("q_at") - F.col("at")) * sign
    near = q.join(pool, ["seqname", "block"]).withColumn("gap", gap).where("gap > 0")
    best = Window.partitionBy("q_id").orderBy("gap", "s_id")
    return near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("q_id", "s_id", "gap", F.lit(0 if side == "left" else 1).alias("side"))


# Merging --------------------------------------------------------------------


def merge(ranges: DataFrame, min_gap: int = 0, block: int = 1 << 16) -> DataFrame:
    """Disjoint cover (seqname, start, end, strand ``*``) of all intervals.

    Intervals that overlap become one; those that only touch stay apart. With
    ``min_gap`` > 0 intervals closer than that are joined too.
    """
    # of intervals with one start the longest stands for all, so that depth makes no block longer
    longest = ranges.where("start < end").groupBy("seqname", "start").agg(F.max("end").alias("end"))
    own = longest.withColumn("_block", block_of("start", block)).withColumn("_reach", F.col("end"))
    order = ["start", "end"]
    # the furthest end of what comes before a row decides whether it opens an island
    reach = carried(own, ["seqname"], order, "_block", "_reach", "max").withColumnRenamed("_reach", "_upto")
    before = Window.partitionBy("seqname", "_block").orderBy(*order)
    firsts = reach.groupBy("seqname", "_block").agg(F.max("_upto").alias("_far"))
    prior = firsts.withColumn("_prior", F.max("_far").over(Window.partitionBy("seqname").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_far")
    seen = reach.join(prior, ["seqname", "_block"]).withColumn("_seen", F.greatest(F.lag("_upto").over(before), "_prior"))
    opens = F.col("_seen").isNull() | (F.col("start") >= F.col("_seen") + F.lit(min_gap))
    marked = seen.withColumn("_island", F.when(opens, F.col("start")))
    islands = carried(marked.select(*COORDS, "_block", "_island"), ["seqname"], order, "_block", "_island", "last")
    return islands.groupBy("seqname", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*COORDS, F.lit("*").alias("strand"))


def merge_many(sets: list[DataFrame], min_gap: int = 0) -> DataFrame:
    """Disjoint cover of several tables."""
    return merge(reduce(DataFrame.unionByName, [s.select(*COORDS) for s in sets]), min_gap)


def label_regions(regions: DataFrame, sets: list[DataFrame]) -> DataFrame:
    """``regions`` with ``labels``, the sorted numbers of the sets that overlap each. The regions are written first, as they are read three times."""
    regions, _ = write_table(regions, "regions")
    tagged = reduce(DataFrame.unionByName, [s.select(*COORDS, "row_id", F.lit(i).alias("_set")) for i, s in enumerate(sets)])
    ids = tagged.withColumn("row_id", F.struct("_set", "row_id"))
    hit = overlaps(regions, ids).groupBy("q_id").agg(F.sort_array(F.collect_set("s_id._set")).alias("labels"))
    return regions.join(hit.withColumnRenamed("q_id", "row_id"), "row_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))


# Selection ------------------------------------------------------------------


def subset(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by (ord, row_id), repeats kept; ``ord`` gives the new order."""
    return ranges.join(rows, "row_id")


def remove(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    return ranges.join(rows.select("row_id"), "row_id", "left_anti")


def slice_rows(ranges: DataFrame, first: int, stop: int) -> DataFrame:
    """Rows whose row_id lies in [first, stop)."""
    return ranges.where((F.col("row_id") >= first) & (F.col("row_id") < stop))


def filter_genome(ranges: DataFrame, genome: DataFrame) -> DataFrame:
    """Rows whose sequence is known and that end within it. A genome is a list of sequences, so it is small."""
    known = genome.select("seqname", "length")
    return ranges.join(known, "seqname").where(F.col("end") <= F.col("length")).drop("length")


def filter_strand(ranges: DataFrame, strand: str) -> DataFrame:
    return ranges.where(F.col("strand") == strand)


def set_lengths(ranges: DataFrame, n: int) -> DataFrame:
    """Length ``n`` from the 5' end: forward rows keep their start, reverse ones their end; others stay."""
    start = F.when(F.col("strand") == "-", F.greatest(F.col("end") - n, F.lit(0))).otherwise(F.col("start"))
    end = F.when(F.col("strand") == "+", F.col("start") + n).otherwise(F.col("end"))
    return ranges.withColumns({"start": start, "end": end})


def resize_center(ranges: DataFrame, n: int) -> DataFrame:
    """Length ``n`` around the middle, clamped at zero."""
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    start = F.greatest(middle - n // 2, F.lit(0)).cast("long")
    return ranges.withColumns({"start": start, "end": start + n})


def append(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all tables; their columns must agree in name and type."""
    for o in others:
        if dict(o.dtypes) != dict(first.dtypes):
            raise ValueError(f"columns differ: {first.dtypes} and {o.dtypes}")
    return reduce(DataFrame.unionByName, [first, *others])


def sort_ranges(ranges: DataFrame, by: str = "", reverse: bool = False) -> DataFrame:
    """By ``seqnames``, ``ranges`` or ``strand``; without a name by sequence, start and end.

    Reversed ``ranges`` keep ties on the start ascending by end.
    """
    way = F.desc if reverse else F.asc
    orders = {"": [way("seqname"), way("start"), way("end")], "seqnames": [way("seqname")], "ranges": [way("start"), F.asc("end")], "strand": [way("strand")]}
    if by not in orders:
        raise ValueError(f"no such order: {by}")
    return ranges.orderBy(*orders[by], "row_id")


def sort_by(ranges: DataFrame, column: str, reverse: bool = False) -> DataFrame:
    """By a scalar metadata column; list and struct columns leave the order as it is."""
    kind = dict(ranges.dtypes)[column]
    if kind.startswith(("array", "struct")):
        return ranges
    return ranges.orderBy(F.desc(column) if reverse else F.asc(column), "row_id")


def shuffle_rows(ranges: DataFrame, seed: int | None = None) -> DataFrame:
    return ranges.orderBy(F.rand(seed))


def random_ranges(genome: DataFrame, n: int, width: int, strands: bool = False, seed: int = 0) -> DataFrame:
    """``n`` random intervals of ``width`` within the genome, sequences drawn by their length."""
    spark = genome.sparkSession
    usable = [(r.seqname, r.length - width + 1) for r in genome.orderBy("seqname").collect() if r.length >= width]
    total = sum(w for _, w in usable)
    if not total:
        raise ValueError("no sequence is long enough")
    edges, at = [], 0
    for name, w in usable:
        edges.append((name, at, at + w))
        at += w
    lookup = F.broadcast(spark.createDataFrame(edges, "seqname string, lo long, hi long"))  # one row a sequence
    drawn = spark.range(n).withColumn("_at", F.floor(F.rand(seed) * total).cast("long"))
    placed = drawn.join(lookup, (F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi")))
    strand = F.when(F.rand(seed + 1) < 0.5, "+").otherwise("-") if strands else F.lit("*")
    start = F.col("_at") - F.col("lo")
    return placed.select("seqname", start.alias("start"), (start + width).alias("end"), strand.alias("strand"), F.col("id").alias("row_id"))


def draw_regions(genome: DataFrame, n: int, width: int, avoid: DataFrame | None = None, seed: int = 0, block: int = 1 << 16) -> DataFrame:
    """``n`` random regions of ``width`` that overlap no row of ``avoid``, all free places equally likely.

    A place is a start position. In each block of positions the places that
    ``avoid`` leaves are gaps; blocks are numbered through by their places, and a
    draw is a number that finds its block and in it its gap. Without a free
    place it is an error.
    """
    spark = genome.sparkSession
    usable = genome.where(F.col("length") >= width).select("seqname", F.explode(F.expr(f"sequence(0, (length - {width}) div {block})")).alias("_block"), (F.col("length") - width + 1).alias("_most"))
    ends = usable.select("seqname", "_block", F.least((F.col("_block") + 1) * block, "_most").alias("_start"), F.lit(None).cast("long").alias("_end"))
    places = ends
    if avoid is not None:
        taken = avoid.where("start < end").select("seqname", F.greatest(F.col("start") - width + 1, F.lit(0)).alias("_from"), F.col("end").alias("_to"))
        spread = taken.where("_from < _to").withColumn("_block", F.explode(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")))
        clipped = spread.select("seqname", "_block", F.greatest("_from", F.col("_block") * block).alias("_start"), F.least("_to", (F.col("_block") + 1) * block).alias("_end"))
        longest = clipped.groupBy("seqname", "_block", "_start").agg(F.max("_end").alias("_end"))  # a row a position at most
        places = ends.unionByName(longest.join(usable.select("seqname", "_block"), ["seqname", "_block"], "left_semi"))
    # the row of a block's end comes last and closes its last gap
    before = Window.partitionBy("seqname", "_block").orderBy("_start", F.col("_end").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.min(F.when(F.col("_end").isNull(), F.col("_start"))).over(Window.partitionBy("seqname", "_block"))
    gaps = places.withColumn("_open", F.coalesce(F.max("_end").over(before), F.col("_block") * block)).withColumn("_stop", F.least("_start", last))
    gaps = gaps.where("_open < _stop").select("seqname", "_block", F.col("_open").alias("_gap"), (F.col("_stop") - F.col("_open")).alias("_n"))
    gaps = gaps.withColumn("_below", F.sum("_n").over(Window.partitionBy("seqname", "_block").orderBy("_gap").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    # one row a block
    sums = gaps.groupBy("seqname", "_block").agg(F.sum("_n").alias("_sum"))
    edges = sums.withColumn("_hi", F.sum("_sum").over(Window.orderBy("seqname", "_block").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_lo", F.col("_hi") - F.col("_sum"))
    total = edges.agg(F.max("_hi")).first()[0]
    if not total:
        raise ValueError("no region is free")
    drawn = spark.range(n).withColumn("_at", F.floor(F.rand(seed) * total).cast("long")).withColumn("_step", F.expr(f"_at div {block}"))
    steps = edges.withColumn("_step", F.explode(F.expr(f"sequence(_lo div {block}, (_hi - 1) div {block})"))).drop("_sum")
    found = drawn.join(steps, "_step").where("_lo <= _at and _at < _hi").withColumn("_nth", F.col("_at") - F.col("_lo"))
    placed = found.join(gaps, ["seqname", "_block"]).where("_below <= _nth and _nth < _below + _n")
    start = F.col("_gap") + F.col("_nth") - F.col("_below")
    return placed.select("seqname", start.alias("start"), (start + width).alias("end"), F.lit("*").alias("strand"), F.col("id").alias("row_id"))
