"""Segmentations: states on bins, labels and differential scores of merged regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import write_table
from .intervals import label_regions, merge_many, resize_center
from .rollup import keep_scored, region_score
from .track import BLOCK, Track

#: Bins that a task fills.
PART = 1 << 20


def states_to_track(segments: DataFrame, genome: DataFrame, bin_size: int, default: str | None = None) -> tuple[Track, DataFrame]:
    """A track of state numbers from (seqname, start, end, name, row_id), and the states (state, name).

    Numbers follow the first appearance; a default state is 0 and fills what no
    segment covers. Later rows overwrite earlier ones.
    """
    firsts = segments.groupBy("name").agg(F.min("row_id").alias("_first"))
    if default:
        firsts = firsts.where(F.col("name") != default)
    # one row a state
    states = firsts.withColumn("state", (F.row_number().over(Window.orderBy("_first")) - (0 if default else 1)).cast("long")).select("state", "name")
    if default:
        states = states.unionByName(segments.sparkSession.createDataFrame([(0, default)], "state long, name string"))
    known = segments.where("start < end").join(states, "name").select("seqname", "row_id", "state", "start", "end")
    rows = _cells(known, genome, bin_size)
    if default:
        rows = rows.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return Track(rows, bin_size, genome), states


def _cells(segments: DataFrame, genome: DataFrame, bin_size: int) -> DataFrame:
    """(seqname, bin, value): each bin of the genome with the state of the last segment that has it, or none.

    Segments, not bins, are dealt by blocks of bins, into parts of bounded size.
    A row at each block's start makes sure of the block; each row then also
    gives the bins without a state up to the next row's.
    """
    n = F.floor(F.col("length") / bin_size).cast("long")
    lengths = genome.select("seqname", n.alias("_n")).where("_n > 0")
    total = lengths.agg(F.sum("_n")).first()[0] or 0
    first = F.floor(F.col("start") / bin_size)
    # a segment has a bin for each step from its start
    last = first + F.floor((F.col("end") - 1 - F.col("start")) / bin_size)
    spans = segments.join(F.broadcast(lengths), "seqname")  # one row a sequence
    spans = spans.select("seqname", "_n", "row_id", "state", F.greatest(first, F.lit(0)).cast("long").alias("_a"), F.least(last, F.col("_n") - 1).cast("long").alias("_z")).where("_a <= _z")
    spans = spans.withColumn("_block", F.explode(F.expr(f"sequence(_a div {BLOCK}, _z div {BLOCK})")))
    spans = spans.select("seqname", "_n", "_block", "row_id", "state", F.greatest("_a", F.col("_block") * BLOCK).alias("_a"), F.least("_z", (F.col("_block") + 1) * BLOCK - 1).alias("_z"))
    kinds = dict(spans.dtypes)
    starts = lengths.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {BLOCK})")))
    starts = starts.select("seqname", "_n", "_block", F.lit(None).cast(kinds["row_id"]).alias("row_id"), F.lit(None).cast(kinds["state"]).alias("state"), (F.col("_block") * BLOCK).alias("_a"), (F.col("_block") * BLOCK).alias("_z"))
    dealt = spans.unionByName(starts).repartition(max(1, -(-total // PART)), "seqname", "_block")
    cells = dealt.select("seqname", "_n", "_block", "row_id", "state", F.explode(F.sequence("_a", "_z")).alias("bin"))
    own = cells.groupBy("seqname", "_block", "_n", "bin").agg(F.max_by("state", "row_id").cast("double").alias("value"))
    following = F.lead("bin").over(Window.partitionBy("seqname", "_block").orderBy("bin"))
    stop = F.coalesce(following, F.least(F.col("_n"), (F.col("_block") + 1) * BLOCK)) - 1
    filled = own.withColumn("_stop", stop).select("seqname", F.col("bin").alias("_bin"), "value", F.explode(F.sequence("bin", "_stop")).alias("bin"))
    return filled.select("seqname", "bin", F.when(F.col("bin") == F.col("_bin"), F.col("value")).alias("value"))


def palette(n: int) -> list[str]:
    """``n`` colours around the circle of hues as 'r,g,b'."""
    import colorsys

    return [",".join(str(round(255 * c)) for c in colorsys.hsv_to_rgb(i / max(1, n), 0.65, 0.9)) for i in range(n)]


def track_to_segments(track: Track, names: dict[int, str] | None = None, colours: dict[int, str] | None = None, scores: Track | None = None) -> DataFrame:
    """BED9 rows of a track's runs of states; scores are 100 times the mean of another track, at least 0."""
    runs = track.as_ranges()
    whole = F.when((F.col("value") >= 0) & (F.col("value") == F.floor("value")), F.col("value").cast("long")).otherwise(F.raise_error("state is no whole number of at least 0"))
    runs = runs.withColumn("_s", whole).withColumn("row_id", F.struct("seqname", "start"))
    label = F.col("_s").cast("string")
    for s, n in (names or {}).items():
        label = F.when(F.col("_s") == s, n).otherwise(label)
    colour = F.lit("0,0,0")
    for s, c in (colours or {}).items():
        colour = F.when(F.col("_s") == s, c).otherwise(colour)
    if scores is not None:
        runs = runs.join(region_score(runs, scores), "row_id", "left")
        score = F.greatest(F.floor(100 * F.coalesce("score", F.lit(0.0))), F.lit(0)).cast("long")
    else:
        score = F.lit(0).cast("long")
    return runs.select("seqname", "start", "end", label.alias("name"), score.alias("score"), F.lit(".").alias("strand"), F.col("start").alias("thickStart"), F.col("end").alias("thickEnd"), colour.alias("itemRgb"))


def differential(sets: list[DataFrame], scores: list[Track], labels: list[str] | None = None, filters: list[tuple[Track, float, bool]] = (), size: int | None = None, min_labels: int = 0, max_labels: int | None = None) -> DataFrame:
    """Merged regions with the sets that overlap them and a differential score.

    ln((pos + 1) / n_pos) - ln((neg + 1) / n_neg) over the largest signal of
    each set's track, by whether the set overlaps the region; 0 without a label,
    null (below all) where every set does.
    """
    kept = [s for s in sets]
    for track, threshold, above in filters:
        kept = [keep_scored(s, track, threshold, above) for s in kept]
    regions, _ = write_table(merge_many(kept).withColumn("row_id", F.struct("seqname", "start")), "regions")
    labelled = label_regions(regions, kept)
    each = reduce(DataFrame.unionByName, [region_score(regions, t, "max").withColumn("_set", F.lit(i)) for i, t in enumerate(scores)])
    met = labelled.join(each, "row_id").withColumn("_pos", F.array_contains("labels", F.col("_set")))
    sums = met.groupBy("row_id").agg(F.sum(F.when(F.col("_pos"), F.col("score"))).alias("_p"), F.sum(F.when(~F.col("_pos"), F.col("score"))).alias("_n"), F.count_if("_pos").alias("_np"), F.count_if(~F.col("_pos")).alias("_nn"))
    ln = lambda s, n: F.ln((F.coalesce(s, F.lit(0.0)) + 1) / n)
    score = F.when(F.col("_np") == 0, 0.0).when(F.col("_nn") > 0, ln(F.col("_p"), F.col("_np")) - ln(F.col("_n"), F.col("_nn")))
    out = labelled.join(sums.select("row_id", score.alias("score")), "row_id")
    out = out.where(F.size("labels") >= min_labels)
    if max_labels is not None:
        out = out.where(F.size("labels") <= max_labels)
    return resize_center(out, size) if size else out


def presence(labelled: DataFrame) -> DataFrame:
    """(n_sets, regions, fraction): how many regions so many sets overlap."""
    n = labelled.groupBy(F.size("labels").alias("n_sets")).agg(F.count("*").alias("regions"))
    total = labelled.agg(F.count("*").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("n_sets", "regions", (F.col("regions") / F.col("_t")).alias("fraction"))  # one row
