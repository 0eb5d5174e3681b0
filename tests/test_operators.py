"""Small cases with known answers, and ways of one operator against each other."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import scalar
from spanforge.operators import coverage as C
from spanforge.operators import genes as G
from spanforge.operators import intervals as I
from spanforge.operators import kmers as K
from spanforge.operators import motifs as M
from spanforge.operators import reads as R
from spanforge.operators import rollup as U
from spanforge.operators import segmentation as S
from spanforge.operators import sequences as Q
from spanforge.operators import track as T

IV = "row_id long, seqname string, start long, end long, strand string"


def iv(spark, rows):
    return spark.createDataFrame([(i, s, a, b, "*") for i, (s, a, b) in enumerate(rows)], IV)


def pairs(df):
    return sorted((r.q_id, r.s_id) for r in df.collect())


def test_overlap_case(spark):
    q, s = iv(spark, [("chr4", 600, 950), ("chr4", 850, 950)]), iv(spark, [("chr4", 100, 900), ("chr4", 200, 800), ("chr4", 300, 700), ("chr4", 400, 600)])
    assert pairs(I.overlaps(q, s)) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert pairs(I.overlaps(q, s, bin_width=8)) == pairs(I.overlaps(q, s, bin_width=100_000))


def test_nearest_case(spark):
    q, s = iv(spark, [("chr4", 600, 950), ("chr4", 950, 1000)]), iv(spark, [("chr4", 100, 900), ("chr4", 200, 300), ("chr4", 300, 700), ("chr4", 400, 600)])
    q = iv(spark, [("chr4", 600, 950), ("chr4", 850, 950)])
    got = sorted((r.q_id, r.s_id, r.distance) for r in I.nearest(q, s, 2).collect())
    assert got == sorted([(0, 0, 0), (0, 2, 0), (0, 3, 0), (0, 1, 300), (1, 0, 0), (1, 2, 150), (1, 3, 250)])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_intervals(spark, seed):
    r = random.Random(seed)
    rows = lambda n: [(f"c{r.randrange(2)}", a, a + r.choice([0, 1, 3, 30, 900, 20_000])) for a in (r.randrange(3000) for _ in range(n))]
    qr, sr = rows(60), rows(80)
    q, s = iv(spark, qr), iv(spark, sr)
    meet = lambda a, b: a[0] == b[0] and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2]
    want = sorted((i, j) for i, a in enumerate(qr) for j, b in enumerate(sr) if meet(a, b))
    for width in (16, 1024):
        assert pairs(I.overlaps(q, s, width)) == want
    assert sorted(x.row_id for x in I.overlap_semi(q, s).collect()) == sorted({i for i, _ in want})
    assert sorted(x.row_id for x in I.overlap_anti(q, s).collect()) == sorted(set(range(60)) - {i for i, _ in want})
    touch = lambda a, b: a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]
    expect = []
    for i, a in enumerate(qr):
        expect += [(i, j, 0) for j, b in enumerate(sr) if touch(a, b)]
        gaps = [(a[1] - b[2], 0, j) for j, b in enumerate(sr) if b[0] == a[0] and b[2] < a[1]] + [(b[1] - a[2], 1, j) for j, b in enumerate(sr) if b[0] == a[0] and b[1] > a[2]]
        expect += [(i, j, g if side == 0 else -g) for g, side, j in sorted(gaps)[:3]]
    for block in (2, 32):
        assert sorted((x.q_id, x.s_id, x.distance) for x in I.nearest(q, s, 3, per_block=block).collect()) == sorted(expect)
    merged = []
    for c, a, b in sorted(x for x in sr if x[1] < x[2]):
        if merged and merged[-1][0] == c and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([c, a, b])
    for block in (64, 1 << 16):
        assert sorted((x.seqname, x.start, x.end) for x in I.merge(s, block=block).collect()) == [tuple(m) for m in merged]


def test_merge_case_and_gap(spark):
    s = iv(spark, [("chr1", 6, 21), ("chr1", 10, 31), ("chr1", 24, 81), ("chr2", 6, 21), ("chr2", 10, 31), ("chr2", 31, 40)])
    assert sorted((r.seqname, r.start, r.end) for r in I.merge(s).collect()) == [("chr1", 6, 81), ("chr2", 6, 31), ("chr2", 31, 40)]
    assert sorted((r.seqname, r.start, r.end) for r in I.merge(s, min_gap=1).collect()) == [("chr1", 6, 81), ("chr2", 6, 40)]


def test_errors(spark):
    with pytest.raises(Exception, match="start > end"):
        I.new_ranges(spark.createDataFrame([("c", 5, 2)], "a string, b long, c long"), "a", "b", "c").collect()
    with pytest.raises(ValueError, match="columns differ"):
        I.append(iv(spark, []), iv(spark, []).drop("strand"))
    with pytest.raises(ValueError, match="no such order"):
        I.sort_ranges(iv(spark, []), "x")
    with pytest.raises(ValueError, match="pseudocounts"):
        C.normalize(None, None, 0, 1)


def track(spark, values, bin_size=10, names=("c",)):
    rows = [(n, i, v) for n in names for i, v in enumerate(values)]
    genome = spark.createDataFrame([(n, len(values) * bin_size) for n in names], "seqname string, length long")
    return T.Track.from_rows(spark.createDataFrame(rows, "seqname string, bin long, value double"), genome, bin_size)


def values(t):
    return [r.value for r in t.rows.orderBy("seqname", "bin").collect()]


def test_blocks_do_not_change_windows(spark, monkeypatch):
    r = random.Random(3)
    v = [None if r.random() < 0.2 else float(r.randrange(4)) for _ in range(300)]
    t = track(spark, v)
    whole = [(values(t.window_map(7, F.sum)), sorted(map(tuple, t.runs().collect()), key=str), values(t.smooth_adaptive([5, 11, 40], 20)))]
    monkeypatch.setattr(T, "BLOCK", 16)
    assert [(values(t.window_map(7, F.sum)), sorted(map(tuple, t.runs().collect()), key=str), values(t.smooth_adaptive([5, 11, 40], 20)))] == whole
    want = [None if not (w := [x for x in v[max(0, i - 3) : i + 4] if x is not None]) else sum(w) for i in range(300)]
    assert whole[0][0] == want


def test_distribution_case(spark):
    d = track(spark, [1.0, 2.0, 2.0, 3.0, 1.0, 2.0]).distribution().orderBy("value").collect()
    assert [(r.value, r["count"], r.cumulative) for r in d] == [(1, 2, 2), (2, 3, 5), (3, 1, 6)]


def test_empty_tracks(spark):
    t = track(spark, [None, None])
    assert t.histogram(5).count() == 0 and t.summary().first().valid == 0 and values(t.quantile_normalize(track(spark, [1.0]))) == [None, None]
    assert t.as_ranges().count() == 0 and t.runs().count() == 2
    assert values(track(spark, [1.0, None]).to_quantiles()) == [1.0, None]


def test_genome_and_meta(spark):
    from spanforge.operators import genome, meta

    g = spark.createDataFrame([("a", 10, 0), ("b", 5, 1)], "seqname string, length long, ord long")
    more = genome.add_sequence(g, "c", 7)
    assert genome.total_length(more).first().total == 22 and genome.sequence_length(more, "c") == 7
    with pytest.raises(ValueError, match="known"):
        genome.add_sequence(g, "a", 1)
    t = iv(spark, [("c", 1, 2), ("c", 3, 4)])
    v = spark.createDataFrame([(0, "x"), (1, "y")], "row_id long, value string")
    assert [r.n for r in meta.add(t, "n", v).orderBy("row_id").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="another length"):
        meta.add(t, "n", v.where("row_id = 0")).collect()
    full = meta.rename(meta.add(t, "k", F.lit(3)), {"k": "m"})
    assert meta.meta_columns(full) == ["m"] and meta.column(full, "m", "string") is None and meta.meta_columns(meta.delete(full, "m", "start")) == []


def test_track_as_bed(spark):
    got = T.as_bed6(track(spark, [1.6, 1.6, None, 3.0])).orderBy("start").collect()
    assert [(r.start, r.end, r.name, r.score) for r in got] == [(0, 20, ".", 2), (30, 40, ".", 3)]


def test_track_access(spark):
    t = track(spark, [1.0, 2.0, 3.0, 4.0], 100)
    assert t.at("c", 399).first().value == 4.0 and [r.value for r in t.slice("c", 150, 399).orderBy("bin").collect()] == [2.0, 3.0]
    assert t.fold(lambda a, b: a * 10 + b, 0.0).first().value == 1234.0


def test_reads(spark):
    reads = spark.createDataFrame([("c", 100, 120, "+", 10, False, False), ("c", 100, 120, "-", 30, True, False), ("c", 5, 9, "-", 30, False, True), ("c", 1, 9, "*", 0, False, False)], "seqname string, start long, end long, strand string, mapq int, duplicate boolean, paired_end boolean")
    assert [(r.start, r.end) for r in R.extend(reads, 50).collect()] == [(100, 150), (70, 120), (5, 9)]
    assert R.extend(reads, 0).count() == 4 and R.keep_lengths(reads, 10, 0).count() == 2 and R.keep_mapq(reads, 0).count() == 4
    assert [(r.start, r.end) for r in R.shift(reads, 3, 7).collect()] == [(103, 123), (93, 113), (0, 4), (1, 9)]
    c = [r.n for r in spark.createDataFrame([("3S10M2I5D1N4=2X7H",), ("*",)], "c string").select(R.cigar_length(F.col("c")).alias("n")).collect()]
    assert c == [22, 0]


def test_coverage_counts(spark):
    genome = spark.createDataFrame([("c", 35)], "seqname string, length long")
    reads = spark.createDataFrame([("c", 5, 15, "+", False), ("c", 25, 34, "-", False), ("c", 31, 34, "+", False), ("x", 1, 2, "+", False)], "seqname string, start long, end long, strand string, paired_end boolean")
    t, n = C.coverage(reads, genome, 10, method="overlap")
    assert values(t) == [5.0, 5.0, 5.0] and n.first().n == 2
    assert values(C.coverage(reads, genome, 10, init=None)[0].map(lambda v: v)) == [1.0, 1.0, 1.0]
    with pytest.raises(ValueError, match="binning"):
        C.coverage(reads, genome, 10, method="x")


def test_fragment_length(spark):
    genome = spark.createDataFrame([("c", 5000)], "seqname string, length long")
    r = random.Random(0)
    rows = []
    for _ in range(400):
        a = r.randrange(100, 4500)
        rows += [("c", a, a + 30, "+", 9, False, False), ("c", a + 120 - 30, a + 120, "-", 9, False, False)]
    reads = spark.createDataFrame(rows, "seqname string, start long, end long, strand string, mapq int, duplicate boolean, paired_end boolean")
    assert C.fragment_length(reads, genome, 300, 10).first().fragment_length == 120
    o = C.CoverageOptions(estimate_fraglen=True, max_delay=300, bin_size=50)
    assert C.coverage_pipeline([reads], genome, o).rows.count() == 100


def test_kmer_cases(spark):
    r = K.Relation(4, 5, True, True, True, "gapped")
    s = spark.createDataFrame([("s", "acgtcgcg")], "name string, sequence string")
    got = {x.kmer: x["count"] for x in K.count_kmers(s, r).collect()}
    assert len(got) == 44 and {k: v for k, v in got.items() if v > 1} == {"cgnc": 2, "cnnc": 2, "annnc": 2, "cgnng": 2, "cnnng": 2}
    assert r.label("anntc") == "anntc|tnnag|ctnna|gannt" and r.label("gacgt") == "acgtc|tgcag|ctgca|gacgt"
    assert {x.kmer for x in K.count_kmers(s, K.Relation(4, 5, True, True, True, "gapped", max_ambiguous=1)).collect()} == {k for k in got if k.count("n") <= 1}
    plain = K.Relation(2, 2)
    assert {x.kmer: x["count"] for x in K.count_kmers(spark.createDataFrame([("s", "acGTnnta")], "name string, sequence string"), plain).collect()} == {"ac": 2, "cg": 1, "ta": 1}
    assert plain.enumerate(1) == list("acgt") and len(plain.cylinder(3, "ac", 1)) == 4 and r.instances("an") == ["aa", "ac", "ag", "at"]


def test_kmer_graph(spark):
    r = K.Relation(2, 6, alphabet="gapped")
    nodes, edges = K.graph(spark, ["at", "tc", "gctc", "gcta", "annnc", "atnnc", "anntc", "anctc", "angtc", "agctc", "aagntc", "aagctc", "agctca"], r)
    near = {}
    for e in edges.collect():
        near.setdefault(r.label(e.upper), set()).add(r.label(e.lower))
        near.setdefault(r.label(e.lower), set()).add(r.label(e.upper))
    assert near["anntc|gannt"] == {"ga|tc", "anctc|gagnt", "angtc|gacnt", "annnc|gnnnt"}
    assert near["agctc|gagct"] == {"gagc|gctc", "anctc|gagnt", "aagctc|gagctt", "agctca|tgagct"} and near["at|at"] == {"atnnc|gnnat"}
    cluster = {x.label.split("|")[0]: x.cluster for x in nodes.collect()}
    assert [cluster[k] for k in ("at", "annnc", "atnnc", "anntc", "anctc", "aagntc")] == [3, 17, 19, 25, 29, 55]


def test_sequences(spark):
    s = spark.createDataFrame([("a", "NNacgTTn"), ("b", "")], "name string, sequence string")
    assert sorted((r.start, r.end) for r in Q.unresolved(s).collect()) == [(0, 2), (7, 8)]
    assert [r.sequence for r in Q.extract(s, spark.createDataFrame([("a", 2, 5)], "seqname string, start long, end long")).collect()] == ["acg"]
    for bad in (("a", 5, 99), ("x", 0, 1)):
        with pytest.raises(Exception, match="outside|missing"):
            Q.extract(s, spark.createDataFrame([bad], "seqname string, start long, end long")).collect()
    long = spark.createDataFrame([("l", "acgt" * 40_000)], "name string, sequence string")
    assert Q.motif_scan(long, "tacg").count() == 39_999
    one = spark.createDataFrame([("gattaca", True, "abc"), ("ACGX", False, None)], "s string, r boolean, q string")
    assert [r[0] for r in one.select(scalar.reverse_complement(F.col("s"))).collect()] == ["TGTAATC", "NCGT"]
    assert [r[0] for r in one.select(scalar.fastq_quality(F.col("q"), F.col("s"), F.col("r"), "!")).collect()] == ["cba", "!!!!"]


def test_motif_strands(spark):
    m = M.Matrix({"a": [1, 0, 0], "c": [0, 2, 0], "g": [0, 0, 3], "t": [0.5, 0, 0]})
    s = spark.createDataFrame([("x", "ttacgnn"), ("y", "ac")], "name string, sequence string")
    for r in M.scores(s, m).collect():
        w = "ttacgnn"[r.at : r.at + 3]
        assert r.forward == m.score(w) and r.reverse == m.score(w, reverse=True)
    assert {r.name: r.best for r in M.max_scores(s, m).collect()} == {"x": 6.0, "y": None}
    assert M.mean_scores(s, m, legacy_mean=True).where("name = 'x'").first().forward > M.mean_scores(s, m).where("name = 'x'").first().forward


def test_genes(spark):
    g = spark.createDataFrame([(0, "g1", "c", 1000, 2000, "+"), (1, "g2", "c", 1000, 1500, "+"), (2, "g1", "c", 50, 700, "-")], "row_id long, names string, seqname string, start long, end long, strand string").withColumn("cds", F.struct(F.col("start").alias("from"), F.col("end").alias("to")))
    p = sorted((r.start, r.end, r.strand, r.names) for r in G.promoters(G.check_genes(g), 100, 50).collect())
    assert p == [(649, 800, "-", ["g1"]), (900, 1051, "+", ["g1", "g2"])]
    assert G.find_gene(g, "g1").first().row_id == 2
    with pytest.raises(Exception, match="without a strand"):
        G.check_genes(g.withColumn("strand", F.lit("*"))).collect()
    x = G.expression(g, spark.createDataFrame([("g1", 1.5), ("g1", 2.0), ("zz", 9.0)], "id string, v double"), "id", "v")
    assert sorted((r.row_id, r.expr) for r in x.collect()) == [(0, 0.0), (1, 0.0), (2, 3.5)]


def test_rollup_levels(spark, tmp_path):
    t = track(spark, [float(i % 9) if i % 5 else None for i in range(400)])
    assert U.level_sizes(10, 10_000_000) == [100, 4000] and U.level_sizes(10, 50_000) == []
    r = U.Rollups.build(t, [40, 200], str(tmp_path / "r"))
    again = U.Rollups.open(spark, t, [40, 200], str(tmp_path / "r"))
    plain = U.Rollups(t, {})
    for size in (40, 120, 400, 70):
        want = sorted(map(tuple, plain.query("c", 100, 3000, size).collect()))
        assert sorted(map(tuple, r.query("c", 100, 3000, size).collect())) == want == sorted(map(tuple, again.query("c", 100, 3000, size).collect()))
    assert (r.choose(400), r.choose(120), r.choose(70)) == (200, 40, None)
    assert [x.value for x in plain.slice("c", 100, 150).orderBy("nth").collect()] == [None, 2.0, 3.0, 4.0, 5.0]


def test_segmentation(spark):
    genome = spark.createDataFrame([("c", 60)], "seqname string, length long")
    seg = spark.createDataFrame([(0, "c", 10, 30, "E2"), (1, "c", 30, 50, "E1"), (2, "c", 20, 30, "E3")], "row_id long, seqname string, start long, end long, name string")
    t, states = S.states_to_track(seg, genome, 10, "none")
    assert values(t) == [0.0, 1.0, 3.0, 2.0, 2.0, 0.0] and {r.name: r.state for r in states.collect()} == {"none": 0, "E2": 1, "E1": 2, "E3": 3}
    t2, _ = S.states_to_track(seg, genome, 10)
    assert values(t2) == [None, 0.0, 2.0, 1.0, 1.0, None]
    out = S.track_to_segments(t2, {0: "x"}, {0: "1,2,3"}, t2).orderBy("start").collect()
    assert [(r.start, r.end, r.name, r.score, r.itemRgb) for r in out] == [(10, 20, "x", 0, "1,2,3"), (20, 30, "2", 200, "0,0,0"), (30, 50, "1", 100, "0,0,0")]
    with pytest.raises(Exception, match="whole number"):
        S.track_to_segments(t2.map(lambda v: v + 0.5)).collect()


def test_packed_records(spark):
    rows = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 10, 20, 3.0), ("c", 25, 30, 2.0), ("c", 60, 70, 5.0)], "seqname string, start long, end long, value double")
    got = [(r.start, r.end, r.valid, r.min, r.max, r["sum"]) for r in U.adjacent_records(rows, 30).collect()]
    assert got == [(0, 30, 3 + 5.0, 0.0, 3.0, 6.0), (60, 70, 1.0, 5.0, 5.0, 5.0)]


def test_streamed_filters_and_pairs(spark, tmp_path):
    from spanforge.streaming import reads as ST

    rows = [("a", "c", 10, 20, "+", 30, False), ("b", "c", 50, 60, "+", 5, False), ("a", "c", 80, 90, "-", 20, True), ("d", "c", 1, 2, "+", 30, False), ("e", "c", 1, 2, "+", 40, False), ("e", "x", 1, 2, "+", 40, False)]
    spark.createDataFrame(rows, ST.READ).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ST.READ).parquet(str(tmp_path / "in"))
    out = ST.pair_mates(ST.dropped(R.keep_mapq(stream, 10), "kept"))
    q = out.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("pairs").collect()] == [("a", "c", 10, 90, "*", 20, True, True)]


def test_tools(spark, tmp_path):
    from spanforge.plans import tools

    (tmp_path / "a.fa").write_text(">c1\nacgtnnacgcgtta\n>c2\nttttcgcgacgt\n")
    (tmp_path / "r.bed").write_text("c1\t0\t4\nc2\t4\t8\n")
    (tmp_path / "x.bed").write_text("c1\t2\t3\n")
    (tmp_path / "m").write_text("A 1 0\nC 0 1\nG 0 0\nT -1 0\n")
    fa, bed, m = (str(tmp_path / n) for n in ("a.fa", "r.bed", "m"))
    assert [r.sequence for r in tools.fasta_extract(spark, fa, bed).orderBy("name").collect()] == ["acgt", "cgcg"]
    assert tools.fasta_unresolved_regions(spark, fa).count() == 1
    assert tools.bed_remove_overlaps(spark, bed, [str(tmp_path / "x.bed")]).count() == 1
    assert tools.count_kmers(spark, fa, K.Relation(2, 2), bed).where("count = 0").count() > 0
    assert {r.name: r.score for r in tools.pwm_scan_regions(spark, fa, bed, [m]).collect()} == {"c1|0|4": 2.0, "c2|4|8": 1.0}
    assert tools.observed_over_expected_cpg(spark, fa).count() == 2
    bw, bw2 = str(tmp_path / "a.bw"), str(tmp_path / "b.bw")
    tools.pwm_scan_sequences(spark, fa, m, 2, bw, "max")
    assert tools.bigwig_genome(spark, bw).count() == 2 and tools.bigwig_info(spark, bw).first().sequences == 2
    assert tools.bigwig_statistics(spark, bw).first().valid == 13
    tools.bigwig_map(spark, [bw, bw], lambda s, p, v: v[0] + v[1], bw2)
    assert tools.bigwig_statistics(spark, bw2).first()["max"] == 2 * tools.bigwig_statistics(spark, bw).first()["max"]
    assert tools.bigwig_histogram(spark, bw, 4).count() == 4
    tools.bigwig_counts_to_quantiles(spark, bw, bw2)
    assert tools.bigwig_statistics(spark, bw2).first()["max"] == 1.0
    assert tools.bigwig_extract(spark, bw, bed).where("size(values) = 2").count() == 2
    assert tools.bigwig_query(spark, bw, "c1", 0, 14, 4).count() == 4
    assert tools.bigwig_query_sequence(spark, bw, "c2", 0, 12).count() == 6
    assert tools.bigwig_positive(spark, [bw], [1.0]).count() > 0
    assert tools.bigwig_edit_chrom_names(spark, bw, "^c", "chr", bw2).count() == 2 and {r.seqname for r in tools.bigwig_genome(spark, bw2).collect()} == {"chr1", "chr2"}
    tools.bigwig_extract_chroms(spark, bw, ["c2"], bw2)
    assert tools.bigwig_genome(spark, bw2).count() == 1
    with pytest.raises(ValueError, match="no such"):
        tools.bigwig_extract_chroms(spark, bw, ["zz"], bw2)
    (tmp_path / "ref.fa").write_text(">r\nacgt\n")
    assert tools.sequence_similarity(spark, fa, str(tmp_path / "ref.fa"), K.Relation(2, 2)).agg(F.max("similarity")).first()[0] == pytest.approx(1.0)


def test_long_sequences_take_linear_time(spark):
    import time

    r = random.Random(2)
    seq = "".join(r.choice("acgt") for _ in range(1_000_000))
    df = spark.createDataFrame([("long", seq), ("odd", "acé" + seq[:70_000])], "name string, sequence string")
    began = time.time()
    n = Q.windows(df.where("name = 'long'"), 6).agg(F.count("*"), F.max("at")).first()
    assert tuple(n) == (999_995, 999_994) and time.time() - began < 10
    at = {(x.name, x["at"]): x.kmer for x in Q.windows(df, 8).where("at in (0, 3, 65530, 65536, 65540, 131071, 999992)").collect()}
    assert all(v == (seq[a : a + 8] if name == "long" else ("ac?" + seq)[a : a + 8]) for (name, a), v in at.items()) and len(at) == 12


@pytest.mark.parametrize("size", [4, 1000])
def test_extract_across_pieces(spark, size):
    s = spark.createDataFrame([("a", "acgtacgtaa"), ("b", "ACGTACGT"), ("c", "")], "name string, sequence string")
    rows = [("a", 0, 10), ("a", 3, 9), ("a", 4, 4), ("a", 10, 10), ("b", 7, 8), ("b", 8, 8), ("c", 0, 0), ("b", 0, 4)]
    text = {"a": "acgtacgtaa", "b": "ACGTACGT", "c": ""}
    got = {x.row_id: (x.seqname, x.sequence) for x in Q.extract(s, iv(spark, rows), size).collect()}
    assert got == {i: (n, text[n][a:b]) for i, (n, a, b) in enumerate(rows)}
    for bad in (("a", 9, 11), ("x", 0, 1), ("b", 9, 9)):
        with pytest.raises(Exception, match="outside the sequence"):
            Q.extract(s, iv(spark, [bad]), size).collect()


def test_draws_from_what_is_free(spark):
    genome = spark.createDataFrame([("a", 100), ("b", 40), ("c", 3)], "seqname string, length long")
    avoid = iv(spark, [("a", 0, 20), ("a", 10, 60), ("a", 65, 90), ("b", 5, 35), ("z", 0, 9), ("a", 62, 62)])
    for block in (8, 1 << 16):
        got = I.draw_regions(genome, 600, 5, avoid, seed=3, block=block).collect()
        # free: [60, 65), [90, 100) on a, [0, 5) and [35, 40) on b
        assert {(x.seqname, x.start) for x in got} == {("a", 60), *(("a", p) for p in range(90, 96)), ("b", 0), ("b", 35)}
        assert len(got) == 600 and all(x.end - x.start == 5 for x in got) and len({x.row_id for x in got}) == 600
    with pytest.raises(ValueError, match="free"):
        I.draw_regions(genome, 1, 30, iv(spark, [("a", 20, 80), ("b", 20, 21)]))
    assert I.draw_regions(genome, 7, 3).count() == 7


def test_cross_correlation_over_blocks(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x, y = r.normal(size=9000), r.normal(size=9000)
    genome = spark.createDataFrame([("a", 90_000)], "seqname string, length long")
    track = lambda v: T.Track(spark.createDataFrame([("a", i, float(z)) for i, z in enumerate(v)], "seqname string, bin long, value double"), 10, genome)
    for start, stop in ((0, 60), (-30, 25), (7, 40)):
        got = {k.lag: k.y for k in T.cross_correlation(track(x), track(y), start, stop).collect()}
        a, b = x - x.mean(), y - y.mean()
        want = {}
        for lag in range(start // 10 * 10, stop, 10):
            k = lag // 10
            p = (a[max(0, -k) : 9000 - max(0, k)] * b[max(0, k) : 9000 + min(0, k)]).sum()
            want[lag + start % 10] = p / 9000 / (x.var() * y.var()) ** 0.5
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_summaries_of_the_caller_and_first_occurrences(spark):
    genome = spark.createDataFrame([("a", 40)], "seqname string, length long")
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 5.0), ("a", 3, 8.0)], "seqname string, bin long, value double")
    stats = U.statistics(rows, [F.floor(F.col("bin") / 2).alias("half")])
    assert {r.half: r.v for r in stats.select("half", U.summary(lambda s: s("max") - s("min")).alias("v")).collect()} == {0: 2.0, 1: 3.0}
    got = U.Rollups(T.Track(rows, 10, genome), {}).slice("a", 0, 40, lambda s: s("sum") * 2, 20).orderBy("nth").collect()
    assert [r.value for r in got] == [8.0, 26.0]
    with pytest.raises(ValueError, match="none of"):
        U.summary("middle")
    (r,) = spark.createDataFrame([([10, 10, 20, 30, 20],)], "x array<long>").select(scalar.distinct_first(F.col("x")).alias("x")).collect()
    assert r.x == [10, 20, 30]


def test_unresolved_is_linear_and_local(spark):
    text = "én" * 20_000 + "xNNnx"
    s = spark.createDataFrame([("a", text), ("b", None), ("c", "n")], "name string, sequence string")
    out = Q.unresolved(s)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.seqname, r.start, r.end) for r in out.collect())
    assert got == [("a", 2 * i + 1, 2 * i + 2) for i in range(20_000)] + [("a", 40_001, 40_004), ("c", 0, 1)]


def test_similarities_shuffle_nothing(spark, monkeypatch):
    monkeypatch.setattr(K, "SPAN", 16)
    r = random.Random(4)
    texts = {f"s{i}": "".join(r.choice("acgtACGTn") for _ in range(n)) for i, n in enumerate((0, 11, 12, 70, 200))}
    s = spark.createDataFrame(list(texts.items()), "name string, sequence string")
    reference, relation = "acgattacgta", K.Relation(2, 3, alphabet="gapped")
    out = K.similarities(s, reference, relation, "tanimoto")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    x, want = K._members(reference, relation), {}
    for name, text in texts.items():
        for start in range(len(text) - len(reference)):
            y = K._members(text[start : start + len(reference)], relation)
            dot = sum(x[c] * n for c, n in y.items())
            want[name, start] = pytest.approx(dot / (sum(v * v for v in x.values()) + sum(v * v for v in y.values()) - dot))
    assert {(v.name, v.start): v.similarity for v in out.collect()} == want


def test_given_kmers_leave_out_the_others_before_they_are_dealt(spark):
    s = spark.createDataFrame([("a", "acgtnACC"), ("a", "ggt"), ("b", "ttt"), (None, "aca")], "name string, sequence string")
    out = K.count_given(s, K.Relation(3, 3, alphabet="gapped"), ["acn", "gat"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(((x.name, x.kmer, x["count"]) for x in out.collect()), key=str) == [("a", "acn", 4), (None, "acn", 1)]


def test_kmers_of_a_name_are_added_up_without_a_hash_table(spark):
    s = spark.createDataFrame([("a", "acgt" * 40_000), ("a", "acg"), ("b", "ttt"), (None, "aca"), (None, "tgt"), ("c", "")], "name string, sequence string")
    out = K.count_kmers(s, K.Relation(3, 3))
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(((x.name, x.kmer, x["count"]) for x in out.collect()), key=str) == [('a', 'acg', 80001), ('a', 'gta', 79998), ('b', 'aaa', 1), (None, 'aca', 2)]


def test_states_fill_blocks_without_dealing_bins(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "PART", 8)
    genome = spark.createDataFrame([("a", 135), ("b", 9), ("c", 40)], "seqname string, length long")
    rows = [("a", 5, 12, "x", 0), ("a", 25, 95, "y", 1), ("a", 60, 70, "x", 2), ("a", 120, 400, "x", 3), ("d", 0, 50, "x", 4), ("b", 0, 9, "y", 5), ("a", 50, 50, "y", 6)]
    segments = spark.createDataFrame(rows, "seqname string, start long, end long, name string, row_id long")
    track, _ = S.states_to_track(segments, genome, 10)
    plan = track.rows._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    want = {("a", b): None for b in range(13)} | {("c", b): None for b in range(4)} | {("a", 0): 0.0, ("a", 12): 0.0} | {("a", b): 1.0 for b in range(2, 9)} | {("a", 6): 0.0}
    got = track.rows.collect()
    assert {(r.seqname, r.bin): r.value for r in got} == want and len(got) == len(want)
