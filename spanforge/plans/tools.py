"""End-to-end jobs: each reads files or tables, composes operators, and returns or writes a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import coverage as C
from ..operators import genes as G
from ..operators import intervals as I
from ..operators import kmers as K
from ..operators import motifs as M
from ..operators import names as N
from ..operators import rollup as U
from ..operators import segmentation as S
from ..operators import sequences as Q
from ..operators import track as T
from ..operators.reads import flag_bit
from ..shared import write_table
from ..sources import bam as B
from ..sources import bigwig as W
from ..sources import motif_files, text


def bam_check_bin(spark: SparkSession, path: str) -> DataFrame:
    """Mapped records whose stored bin differs from that of their interval."""
    r = B.single_reads(B.read_bam(spark, path, ["cigar"]))
    bins = B.read_bam(spark, path, []).select(F.col("ord").alias("row_id"), "bin")
    return r.join(bins, "row_id").withColumn("expected", scalar.ucsc_bin(F.col("start"), F.col("end"))).where("bin <> expected")


def bam_check_fastq(spark: SparkSession, bam: str, fastqs: list[str]) -> DataFrame:
    """Names with their counts in the alignment file and the read files."""
    a = B.read_bam(spark, bam, ["read_name"]).where(~flag_bit(F.col("flag"), "secondary") & ~flag_bit(F.col("flag"), "supplementary")).select(F.col("read_name").alias("name"))
    return N.reconcile(a, [text.read_fastq(spark, f).select(F.col("header").alias("name")) for f in fastqs])


def bam_genome(spark: SparkSession, path: str) -> DataFrame:
    return B.read_genome(spark, path)


def bam_to_bigwig(
    spark: SparkSession, treatment: list[str], out: str, options: C.CoverageOptions | None = None, control: list[str] = (), fraglen: list[int] | None = None, fraglen_control: list[int] | None = None,
    save_fraglen: bool = False, save_cross_correlation: bool = False,
) -> T.Track:
    """Coverage of alignment files, which share one genome, written as a signal file.

    Reads are parsed once. For every file whose fragment length is estimated,
    ``save_fraglen`` writes it to NAME.fraglen.txt beside the file and
    ``save_cross_correlation`` the lags with their correlation to NAME.fraglen.table.
    """
    o = options or C.CoverageOptions()
    genomes = [B.read_genome(spark, p).select("seqname", "length") for p in [*treatment, *control]]
    for g in genomes[1:]:
        if g.exceptAll(genomes[0]).union(genomes[0].exceptAll(g)).limit(1).count():
            raise ValueError("alignment files have different genomes")

    def reads(paths: list[str]) -> list[DataFrame]:
        each = (B.simple_reads(B.read_bam(spark, p, ["read_name", "cigar"]), not o.paired_as_single_end, o.paired_end_strand_specific) for p in paths)
        return [write_table(r, "reads")[0] for r in each]

    def lengths(paths: list[str], sources: list[DataFrame], given: list[int] | None) -> list[int]:
        found = list(given or [0] * len(paths))
        for i, (path, source) in enumerate(zip(paths, sources, strict=True)):
            if not o.estimate_fraglen or found[i]:
                continue
            name = path.removesuffix(".bam")
            found[i] = C.estimated_length(source, genomes[0], o)
            if save_fraglen:
                text.write_text(spark.range(1), F.lit(str(found[i])), f"{name}.fraglen.txt")
            if save_cross_correlation:
                lags, _, _ = C.cross_correlate_reads(C.for_estimate(source, o), genomes[0], o.max_delay, o.fraglen_bin_size)
                text.write_text(lags, F.concat_ws("\t", F.col("lag"), F.col("y")), f"{name}.fraglen.table", order=["lag"])
        return found

    own, other = reads(treatment), reads(control)
    track = C.coverage_pipeline(own, genomes[0], o, other or None, lengths(treatment, own, fraglen), lengths(control, other, fraglen_control))
    W.write_track(track, out)
    return track


def bam_to_fastq(spark: SparkSession, path: str, fill: str | None = None, suffix: bool = True) -> DataFrame:
    """(mate, header, sequence, qualities) of primary records that passed quality control; mate 0 is unpaired."""
    flag = F.col("flag")
    r = B.read_bam(spark, path, ["read_name", "seq", "qual"]).where(~flag_bit(flag, "secondary") & ~flag_bit(flag, "supplementary") & ~flag_bit(flag, "failed_qc"))
    mate = F.when(~flag_bit(flag, "paired"), 0).when(flag_bit(flag, "first_in_pair"), 1).when(flag_bit(flag, "second_in_pair"), 2).otherwise(0)
    back = flag_bit(flag, "reverse")
    name = F.when((mate > 0) & F.lit(suffix), F.concat("read_name", F.lit("/"), mate)).otherwise(F.col("read_name"))
    return r.select("ord", mate.alias("mate"), name.alias("header"), scalar.fastq_sequence(F.col("seq"), back).alias("sequence"), scalar.fastq_quality(F.col("qual"), F.col("seq"), back, fill).alias("qualities"))


def bam_view(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    return B.read_bam(spark, path, columns)


def bed_remove_overlaps(spark: SparkSession, path: str, others: list[str], columns: int = 3) -> DataFrame:
    out = text.read_bed(spark, path, columns)
    for o in others:
        out = I.overlap_anti(out, text.read_bed(spark, o))
    return out


def bigwig_counts_to_quantiles(spark: SparkSession, path: str, out: str) -> T.Track:
    track = W.read_track(spark, path).to_quantiles()
    W.write_track(track, out)
    return track


def bigwig_edit_chrom_names(spark: SparkSession, path: str, pattern: str, replacement: str, out: str | None = None) -> DataFrame:
    """(seqname, new); with ``out`` the renamed file is written, without it is a dry run."""
    track = W.read_track(spark, path)
    if out:
        W.write_track(W.rename_sequences(track, pattern, replacement), out)
    return track.genome.select("seqname", F.regexp_replace("seqname", pattern, replacement).alias("new"))


def bigwig_extract(spark: SparkSession, path: str, regions: str, f: str = "mean", bin_size: int | None = None) -> DataFrame:
    return U.region_values(text.read_bed(spark, regions, 3), W.read_track(spark, path), "values", f=f, bin_size=bin_size)


def bigwig_extract_track(spark: SparkSession, path: str, regions: str, out: str) -> T.Track:
    track = U.region_track(text.read_bed(spark, regions, 3), W.read_track(spark, path))
    W.write_track(track, out)
    return track


def bigwig_extract_chroms(spark: SparkSession, path: str, chroms: list[str], out: str) -> T.Track:
    track = W.read_track(spark, path)
    have = {r.seqname for r in track.genome.where(F.col("seqname").isin(chroms)).collect()}
    if missing := set(chroms) - have:
        raise ValueError(f"no such sequences: {sorted(missing)}")
    kept = track.filter_genome(F.col("seqname").isin(chroms))
    W.write_track(kept, out)
    return kept


def bigwig_genome(spark: SparkSession, path: str) -> DataFrame:
    return W.read_genome(spark, path)


def bigwig_histogram(spark: SparkSession, path: str, bins: int = 100, cumulative: bool = False) -> DataFrame:
    return W.read_track(spark, path).histogram(bins, cumulative)


def bigwig_info(spark: SparkSession, path: str) -> DataFrame:
    return W.info(spark, path)


def bigwig_map(spark: SparkSession, paths: list[str], f, out: str) -> T.Track:
    """A plug-in over the bins of several files."""
    track = T.map_udf([W.read_track(spark, p) for p in paths], f)
    W.write_track(track, out)
    return track


def bigwig_nil(spark: SparkSession, path: str, out: str, bin_size: int = 0) -> None:
    W.write_track(W.read_track(spark, path, bin_size), out)


def bigwig_positive(spark: SparkSession, paths: list[str], thresholds: list[float], exclude: str | None = None, annotate: str | None = None, k: int = 1) -> DataFrame:
    """Joint peaks, outside of ``exclude`` and beside their nearest rows of ``annotate``; missing bins count as 0."""
    peaks = T.joint_positive([W.read_track(spark, p, init=0.0) for p in paths], thresholds)
    peaks = peaks.withColumn("row_id", F.struct("seqname", "start"))
    if exclude:
        peaks = I.overlap_anti(peaks, text.read_bed(spark, exclude))
    if annotate:
        genes = text.read_bed(spark, annotate, 6)
        near = I.nearest(peaks, genes, k).join(genes.select(F.col("row_id").alias("s_id"), "name"), "s_id")
        lists = near.groupBy(F.col("q_id").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct(F.abs("distance").alias("by"), "distance", "name"))).alias("nearest"))
        peaks = peaks.join(lists, "row_id", "left")
    return peaks.drop("row_id").orderBy(F.desc("summit_sum"), "seqname", "start")


def bigwig_quantile_normalize(spark: SparkSession, reference: str, path: str, out: str) -> T.Track:
    track = W.read_track(spark, path).quantile_normalize(W.read_track(spark, reference))
    W.write_track(track, out)
    return track


def bigwig_query(spark: SparkSession, path: str, seq_regex: str, start: int, end: int, bin_size: int) -> DataFrame:
    return U.Rollups(W.read_track(spark, path), {}).query(seq_regex, start, end, bin_size)


def bigwig_query_sequence(spark: SparkSession, path: str, seqname: str, start: int, end: int, f: str = "mean", bin_size: int = 0, overlap: int = 0, init: float | None = None) -> DataFrame:
    return U.Rollups(W.read_track(spark, path), {}).slice(seqname, start, end, f, bin_size, overlap, init)


def bigwig_statistics(spark: SparkSession, path: str) -> DataFrame:
    return W.read_track(spark, path).summary()


def chromhmm_to_bigwig(spark: SparkSession, paths: str, genome: DataFrame, state: str, bin_size: int, out: str) -> T.Track:
    rows = text.read_chromhmm(spark, paths).where(F.col("state") == state).select("seqname", "bin", "value")
    track = T.Track.from_rows(rows, genome, bin_size)
    W.write_track(track, out)
    return track


def _regions(spark: SparkSession, fasta: str, regions: str | None) -> DataFrame:
    """(name, sequence) of whole sequences or of the regions of a BED file."""
    s = text.read_fasta(spark, fasta, ordered=True)
    if regions is None:
        return s.select("name", "sequence")
    cut = Q.extract(s.drop("ord"), text.read_bed(spark, regions))
    return cut.select(F.format_string("%s|%d|%d", "seqname", "start", "end").alias("name"), "sequence")


def count_kmers(spark: SparkSession, fasta: str, relation: K.Relation, regions: str | None = None, binary: bool = False) -> DataFrame:
    """Every region with every class that occurs somewhere."""
    s = _regions(spark, fasta, regions)
    return K.dense_counts(K.count_kmers(s, relation, binary), s)


def draw_genomic_regions(spark: SparkSession, genome: str, n: int, width: int, avoid: str | None = None, seed: int = 0) -> DataFrame:
    return I.draw_regions(text.read_genome(spark, genome), n, width, text.read_bed(spark, avoid) if avoid else None, seed)


def fasta_extract(spark: SparkSession, fasta: str, regions: str) -> DataFrame:
    return _regions(spark, fasta, regions)


def fasta_unresolved_regions(spark: SparkSession, fasta: str) -> DataFrame:
    return Q.unresolved(text.read_fasta(spark, fasta).select("name", "sequence"))


def gtf_to_bed(spark: SparkSession, path: str, merge_by: str | None = None) -> DataFrame:
    if merge_by is None:
        return text.read_gtf(spark, path).withColumn("name", F.col("feature"))
    return G.merge_by_attribute(text.read_gtf(spark, path, {merge_by: "str"}, {merge_by: ""}), merge_by)


def meme_extract(path: str, kind: str = "pwm", alpha: float = 0.0, names: list[str] | None = None) -> dict[str, M.Matrix]:
    return motif_files.motif_matrices(path, kind, alpha, names)


def observed_over_expected_cpg(spark: SparkSession, fasta: str, regions: str | None = None) -> DataFrame:
    return Q.cpg(_regions(spark, fasta, regions))


def pwm_scan_regions(spark: SparkSession, fasta: str, regions: str, matrices: list[str], mean: bool = False) -> DataFrame:
    """(name, motif, score): the best score over both strands, or the log-mean over both."""
    s = _regions(spark, fasta, regions)
    out = None
    for path in matrices:
        m = motif_files.read_matrix(path)
        one = M.mean_scores(s, m).select("name", F.col("both").alias("score")) if mean else M.max_scores(s, m).select("name", F.col("best").alias("score"))
        one = one.withColumn("motif", F.lit(path))
        out = one if out is None else out.unionByName(one)
    return out


def pwm_scan_sequences(spark: SparkSession, fasta: str, matrix: str, bin_size: int, out: str, f: str = "mean") -> T.Track:
    s = text.read_fasta(spark, fasta)
    genome = s.select(F.col("name").alias("seqname"), F.length("sequence").cast("long").alias("length"))
    track = T.Track.from_rows(M.binned_scores(s.select("name", "sequence"), motif_files.read_matrix(matrix), bin_size, f), genome, bin_size)
    W.write_track(track, out)
    return track


def segmentation_differential(spark: SparkSession, beds: list[str], states: list[str], signals: list[str], size: int | None = None, **options) -> DataFrame:
    sets = [text.read_bed(spark, b, 6).where(F.col("name").isin(states)) for b in beds]
    return S.differential(sets, [W.read_track(spark, p) for p in signals], size=size, **options).orderBy(F.desc("score"), "seqname", "start")


def sequence_similarity(spark: SparkSession, fasta: str, reference: str, relation: K.Relation, regions: str | None = None, **options) -> DataFrame:
    ref = text.read_fasta(spark, reference).select("sequence").limit(2).collect()
    if len(ref) != 1:
        raise ValueError("the reference holds one sequence")
    return K.similarities(_regions(spark, fasta, regions), ref[0].sequence, relation, **options)
