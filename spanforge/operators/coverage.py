"""Coverage tracks from reads, with control, normalisation and smoothing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reads as R
from .track import Track, cross_correlation, grid, map_list

METHODS = ("simple", "overlap", "mean overlap")


def read_bins(reads: DataFrame, bin_size: int, method: str) -> DataFrame:
    """(seqname, bin, value): what each read adds to each bin it overlaps."""
    if method not in METHODS:
        raise ValueError(f"binning method {method!r} is none of {METHODS}")
    bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))
    each = reads.where("start < end").select("seqname", "start", "end", F.explode(bins).alias("bin"))
    bases = F.least(F.col("end"), (F.col("bin") + 1) * bin_size) - F.greatest(F.col("start"), F.col("bin") * bin_size)
    value = {"simple": F.lit(1.0), "overlap": bases.cast("double"), "mean overlap": bases / bin_size}[method]
    return each.select("seqname", "bin", value.alias("value"))


def coverage(reads: DataFrame, genome: DataFrame, bin_size: int, d: int = 0, method: str = "simple", init: float | None = 0.0) -> tuple[Track, DataFrame]:
    """The coverage track and a one-row table ``n`` of the reads that count.

    Reads are extended to ``d`` bases. Those that start past a sequence's last
    bin count for nothing, and those that reach past it add to the bins there are.
    """
    whole = genome.select("seqname", F.floor(F.col("length") / bin_size).alias("_bins"))
    inside = R.extend(reads, d).join(whole, "seqname").where(F.floor(F.col("start") / bin_size) < F.col("_bins"))
    sums = read_bins(inside, bin_size, method).groupBy("seqname", "bin").agg(F.sum("value").alias("value"))
    track = grid(genome, bin_size).join(sums, ["seqname", "bin"], "left")
    if init is not None:
        track = track.withColumn("value", F.coalesce("value", F.lit(0.0)) + init)
    return Track(track, bin_size, genome), inside.agg(F.count("*").alias("n"))


def normalize(treatment: Track, control: Track, c1: float, c2: float, log: bool = False) -> Track:
    """((t + c1) / (c + c2)) * c2 / c1, or its logarithm. Both pseudocounts are positive."""
    if c1 <= 0 or c2 <= 0:
        raise ValueError("pseudocounts must be positive")
    ratio = lambda v: (v[0] + c1) / (v[1] + c2) * c2 / c1
    return map_list([treatment, control], (lambda v: F.ln(ratio(v))) if log else ratio)


def five_prime_tracks(reads: DataFrame, genome: DataFrame, bin_size: int) -> tuple[Track, Track]:
    """Coverage of 5' ends: forward reads at their start, reverse reads one past their last base."""
    forward = reads.where("strand = '+'").withColumn("end", F.col("start") + 1)
    reverse = reads.where("strand = '-'").withColumn("start", F.col("end")).withColumn("end", F.col("end") + 1)
    return tuple(coverage(r, genome, bin_size)[0] for r in (forward, reverse))


def cross_correlate_reads(reads: DataFrame, genome: DataFrame, max_delay: int = 2000, bin_size: int = 10) -> tuple[DataFrame, int, int]:
    """(lag, y), the mean read length and the number of reads with a strand."""
    stranded = reads.where(F.col("strand").isin("+", "-"))
    s = stranded.agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases")).first()
    if not s.n:
        raise ValueError("no reads available")
    return cross_correlation(*five_prime_tracks(stranded, genome, bin_size), 0, max_delay), s.bases // s.n, s.n


def fragment_length(reads: DataFrame, genome: DataFrame, max_delay: int = 2000, bin_size: int = 10, lag_range: tuple[int, int] = (-1, -1)) -> DataFrame:
    """One row (fragment_length, y): the first best lag from 1.5 times the read length, or from ``lag_range``."""
    y, length, _ = cross_correlate_reads(reads, genome, max_delay, bin_size)
    low = length + length // 2 if lag_range[0] == -1 else lag_range[0]
    high = max_delay if lag_range[1] == -1 else lag_range[1]
    low, high = low // bin_size * bin_size, high // bin_size * bin_size
    inside = y.where((F.col("lag") == low) | (F.col("lag") >= low) & (F.col("lag") < high))
    return inside.agg(F.max_by("lag", F.struct("y", -F.col("lag"))).alias("fragment_length"), F.max("y").alias("y"))


@dataclass
class CoverageOptions:
    binning_method: str = "simple"
    bin_size: int = 10
    bin_overlap: int = 0
    normalize_track: str = ""
    shift_reads: tuple[int, int] = (0, 0)
    paired_as_single_end: bool = False
    paired_end_strand_specific: bool = False
    initial_value: float = 0.0
    log_scale: bool = False
    pseudocounts: tuple[float, float] = (0.0, 0.0)
    estimate_fraglen: bool = False
    fraglen_range: tuple[int, int] = (-1, -1)
    fraglen_bin_size: int = 10
    filter_chroms: list[str] = field(default_factory=list)
    remove_filtered_chroms: bool = False
    filter_mapq: int = 0
    filter_read_lengths: tuple[int, int] = (0, 0)
    filter_duplicates: bool = False
    filter_strand: str = "*"
    filter_paired_end: bool = False
    filter_single_end: bool = False
    smoothen_control: bool = False
    smoothen_sizes: list[int] = field(default_factory=list)
    smoothen_min: float = 20.0
    max_delay: int = 2000


def _of_filter(reads: DataFrame, o: CoverageOptions) -> DataFrame:
    return R.filtered(reads, o.filter_paired_end, o.filter_single_end, o.paired_as_single_end, o.filter_read_lengths, o.filter_duplicates, o.filter_mapq, o.filter_strand, o.shift_reads)


def _scaled(track: Track, n: DataFrame, o: CoverageOptions, pseudocount: float) -> tuple[Track, float]:
    """A track per million reads, and per bin size where asked; the pseudocount follows."""
    if o.normalize_track not in ("", "rpkm", "cpm"):
        raise ValueError(f"normalisation {o.normalize_track!r} is neither rpkm nor cpm")
    if not o.normalize_track:
        return track, pseudocount
    reads = n.first().n
    if not reads:
        return track, pseudocount
    c = 1e6 / (reads * (o.bin_size if o.normalize_track == "rpkm" else 1))
    return track.map(lambda v: v * c), pseudocount * c


def for_estimate(source: DataFrame, o: CoverageOptions) -> DataFrame:
    """The single reads by which a source's fragment length is estimated."""
    return R.filtered(R.paired_as_single(source, o.paired_as_single_end), single_only=True, no_duplicates=o.filter_duplicates, mapq=o.filter_mapq, lengths=o.filter_read_lengths)


def estimated_length(source: DataFrame, genome: DataFrame, o: CoverageOptions) -> int:
    return fragment_length(for_estimate(source, o), genome, o.max_delay, o.fraglen_bin_size, o.fraglen_range).first().fragment_length


def coverage_pipeline(treatment: list[DataFrame], genome: DataFrame, options: CoverageOptions | None = None, control: list[DataFrame] | None = None, fraglen: list[int] | None = None, fraglen_control: list[int] | None = None) -> Track:
    """Reads of one or more sources to a normalised coverage track.

    Filters, fragment lengths (given or estimated for each source), coverage,
    scaling, the ratio to the control or pseudocount and logarithm, and at last
    the named sequences dropped or set to zero.
    """
    o = options or CoverageOptions()

    def covered(sources: list[DataFrame], lengths: list[int] | None) -> tuple[Track, DataFrame]:
        total = None
        for i, source in enumerate(sources):
            d = (lengths or [0] * len(sources))[i]
            if o.estimate_fraglen and not d:
                d = estimated_length(source, genome, o)
            part = R.extend(_of_filter(source, o), d).select("seqname", "start", "end", "strand", "paired_end")
            total = part if total is None else total.unionByName(part)
        return coverage(total, genome, o.bin_size, 0, o.binning_method, o.initial_value)

    track, c1 = _scaled(*covered(treatment, fraglen), o, o.pseudocounts[0])
    if control:
        other, c2 = _scaled(*covered(control, fraglen_control), o, o.pseudocounts[1])
        if o.smoothen_control:
            other = other.smooth_adaptive(o.smoothen_sizes, o.smoothen_min)
        track = normalize(track, other, c1, c2, o.log_scale)
    else:
        if c1 != 0:
            track = track.map(lambda v: v + c1)
        if o.log_scale:
            track = track.map(F.ln)
    if o.filter_chroms:
        named = F.col("seqname").isin(o.filter_chroms)
        if o.remove_filtered_chroms:
            track = track.filter_genome(~named)
        else:
            track = track.with_rows(track.rows.withColumn("value", F.when(named, F.lit(0.0)).otherwise(F.col("value"))))
    return track
