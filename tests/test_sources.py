import gzip
import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spanforge.operators.motifs import Matrix
from spanforge.operators.track import Track
from spanforge.sources import bam, bigwig, motif_files, text


def write(path, body):
    path.write_bytes(gzip.compress(body.encode()) if path.suffix == ".gz" else body.encode())
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("row_id").select(*columns).collect()]


def test_bed(spark, tmp_path):
    body = 'browser position chr7:1-2\ntrack name="x y"\nchr7 10 20 Pos1 0 + 10 20 255,0,0\nchr7 30 45 Neg1 7 - 31 44 0,0,255\n'
    b9 = text.read_bed(spark, write(tmp_path / "a.bed.gz", body), 9)
    assert rows(b9, "seqname", "start", "end", "strand", "name", "score", "thickStart", "thickEnd", "itemRgb") == [("chr7", 10, 20, "+", "Pos1", 0, 10, 20, "255,0,0"), ("chr7", 30, 45, "-", "Neg1", 7, 31, 44, "0,0,255")]
    for n in (3, 6, 9):
        text.write_bed(b9, str(tmp_path / f"o{n}"), n, compress=True)
        again = text.read_bed(spark, str(tmp_path / f"o{n}"), n)
        assert rows(again, "seqname", "start", "end") == rows(b9, "seqname", "start", "end")
    tabbed = text.read_bed(spark, write(tmp_path / "t.bed", "chr1\t1\t5\ta name\t9\t-\n"), 6)
    assert rows(tabbed, "name", "score", "strand") == [("a name", 9, "-")]
    with pytest.raises(Exception, match="BED6 needs 6 fields"):
        text.read_bed(spark, write(tmp_path / "short.bed", "chr1 1 5\n"), 6).collect()
    with pytest.raises(ValueError, match="name"):
        text.write_bed(b9.drop("name"), str(tmp_path / "no"), 6)
    with pytest.raises(ValueError, match="columns"):
        text.read_bed(spark, "x", 4)


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 5, 10, "+", 0, "a", [1, 2], 0.5), ("chr10", 100, 2000, "-", 1, "bb", [], None)], "seqname string, start long, end long, strand string, row_id long, names string, l array<long>, v double")
    path = str(tmp_path / "t")
    text.write_table_text(df.coalesce(1), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len({len(x) for x in lines}) == 1 and " | " in lines[0]
    only = tmp_path / "one.table"
    only.write_text("\n".join(sorted(lines, key=lambda x: "seqnames" not in x)) + "\n")
    again = text.read_table(spark, str(only), {"names": "String", "l": "Vec<Int>", "v": "Float", "absent": "Int"})
    assert rows(again, "seqname", "start", "end", "strand", "names", "l", "v") == [("chr1", 5, 10, "+", "a", [1, 2], 0.5), ("chr10", 100, 2000, "-", "bb", [], None)]
    assert text.read_table(spark, str(only)).columns == ["seqname", "start", "end", "strand", "names", "l", "v", "row_id"]


def test_gtf(spark, tmp_path):
    body = '#!x\n1 src gene 11869 14409 . + . gene_id "G1"; gene_num 5;\n1 src transcript 11869 14409 2.5 - 0 gene_id "G 2";\n'
    path = write(tmp_path / "a.gtf", body)
    g = text.read_gtf(spark, path, {"gene_id": "str", "gene_num": "int"}, {"gene_num": 0})
    assert rows(g, "seqname", "start", "end", "strand", "feature", "score", "frame", "gene_id", "gene_num") == [("1", 11869, 14409, "+", "gene", None, None, "G1", 5), ("1", 11869, 14409, "-", "transcript", 2.5, 0, "G 2", 0)]
    with pytest.raises(Exception, match="gene_num is missing"):
        text.read_gtf(spark, path, {"gene_num": "int"}).collect()
    text.write_gtf(g, str(tmp_path / "o"))
    again = text.read_gtf(spark, str(tmp_path / "o"), {"gene_id": "str", "gene_num": "int"})
    assert rows(again, "feature", "score", "gene_id", "gene_num") == rows(g, "feature", "score", "gene_id", "gene_num")


def test_signal_text(spark, tmp_path):
    b = text.read_bedgraph(spark, write(tmp_path / "a.bg", "chr1\t0\t20\t1.5\n\nchr1\t10\t30\t2.5\nchr2\t0\t10\tNaN\n"))
    assert rows(b, "seqname", "start", "end", "values") == [("chr1", 0, 20, 1.5), ("chr1", 10, 30, 2.5), ("chr2", 0, 10, None)]
    assert sorted(map(tuple, text.bedgraph_bins(b, 10).collect())) == [("chr1", 0, 1.5), ("chr1", 1, 2.5), ("chr1", 2, 2.5), ("chr2", 0, None)]
    text.write_bedgraph(b, str(tmp_path / "bg"))
    assert rows(text.read_bedgraph(spark, str(tmp_path / "bg")), "start", "values") == rows(b, "start", "values")
    w = write(tmp_path / "a.wig", "track type=wiggle_0\nfixedStep chrom=chr1 start=1 step=10 span=10\n1\n2\n3\nvariableStep chrom=chr2 span=10\n11 7\n41 8\n")
    want = [("chr1", 0, 1.0), ("chr1", 1, 2.0), ("chr1", 2, 3.0), ("chr2", 1, 7.0), ("chr2", 4, 8.0)]
    assert sorted(map(tuple, text.read_wiggle(spark, w, 10).collect())) == want
    grid = spark.createDataFrame([*want, ("chr2", 0, None), ("chr2", 2, None), ("chr2", 3, 0.0)], "seqname string, bin long, value double")
    text.write_wiggle(grid.coalesce(1), str(tmp_path / "wig"), 10)
    one = tmp_path / "one.wig"
    one.write_text("\n".join(x.read_text().strip() for x in sorted((tmp_path / "wig").glob("part-*"))))
    assert sorted(map(tuple, text.read_wiggle(spark, str(one), 10).collect())) == want


def test_sequences(spark, tmp_path):
    seq = "acgt" * 50
    f = text.read_fasta(spark, write(tmp_path / "a.fa", f">chr1|x y\n{seq[:60]}\n{seq[60:]}\n>chr2 z\nNNac\n"), ordered=True)
    assert [tuple(r) for r in f.orderBy("ord").select("name", "sequence").collect()] == [("chr1", seq), ("chr2", "NNac")]
    text.write_fasta(f, str(tmp_path / "fa"))
    assert sorted(map(tuple, text.read_fasta(spark, str(tmp_path / "fa")).select("name", "sequence").collect())) == [("chr1", seq), ("chr2", "NNac")]
    assert all(len(r.value) <= 80 for r in spark.read.text(str(tmp_path / "fa")).collect())
    with pytest.raises(ValueError, match="twice"):
        text.read_fasta(spark, write(tmp_path / "b.fa", ">a\nac\n>a\ngt\n"), ordered=True)
    q = text.read_fastq(spark, write(tmp_path / "a.fq.gz", "@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+r2\n##\n"))
    assert [tuple(r) for r in q.orderBy("line").select("header", "sequence", "qualities").collect()] == [("r1 x", "ACGT", "IIII"), ("r2", "AC", "##")]
    text.write_fastq(q, str(tmp_path / "fq"))
    assert text.read_fastq(spark, str(tmp_path / "fq")).count() == 2
    with pytest.raises(Exception, match="bad FASTQ record"):
        text.read_fastq(spark, write(tmp_path / "c.fq", "@r1\nACGT\n+\nIII\n")).collect()


def test_small_tables(spark, tmp_path):
    g = text.read_genome(spark, write(tmp_path / "g", "chr1\t100\n\nchr2 50\n"))
    text.write_genome(g, str(tmp_path / "go"))
    assert [tuple(r) for r in text.read_genome(spark, str(tmp_path / "go")).orderBy("ord").select("seqname", "length").collect()] == [("chr1", 100), ("chr2", 50)]
    u = text.read_ucsc_genes(spark, write(tmp_path / "u", "g1 chr1 + 10 90 20 80\n"))
    assert rows(u, "names", "seqname", "start", "end", "strand", "cds.to") == [("g1", "chr1", 10, 90, "+", 80)]
    p = text.read_peaks(spark, write(tmp_path / "p", "# c\n\nchr\tstart\tend\tlength\tabs_summit\tpileup\tx\ty\tz\tname\nchr1\t10\t20\t11\t15\t33.0\t4\t5\t6\tn\n"))
    assert rows(p, "start", "end", "abs_summit", "pileup", "-log10(qvalue)") == [(10, 21, 15, 33.0, 6.0)]
    c = text.read_cpg_islands(spark, write(tmp_path / "c", "chr1 5 25 20 3 15 0.3 0.75 1.1\n"))
    assert rows(c, "start", "length", "cpgNum", "obsExp") == [(5, 20, 3, 1.1)]
    t = text.read_fpkm(spark, write(tmp_path / "f", "\t".join(["tracking_id", *"abcdefghijkl"]) + "\n" + "\t".join(["t", "-", "-", "G1", "s", "-", "l", "-", "-", "2.5", "1", "3", "OK"]) + "\n" + "\t".join(["t", "-", "-", "G1", "s", "-", "l", "-", "-", "9", "1", "3", "FAIL"]) + "\n"))
    assert [tuple(r) for r in t.collect()] == [("G1", 2.5)]
    h = text.read_chromhmm(spark, write(tmp_path / "h", "cell chr3\nE1 E2\n0.1 0.9\n0.5 0.5\n"))
    assert sorted(map(tuple, h.collect())) == [("chr3", 0, "E1", 0.1), ("chr3", 0, "E2", 0.9), ("chr3", 1, "E1", 0.5), ("chr3", 1, "E2", 0.5)]
    assert "..." in text.show(spark.range(30).withColumnRenamed("id", "row_id"), 10) and "..." not in text.show(spark.range(11).withColumnRenamed("id", "row_id"), 10)


MEME = """<MEME><training_set><alphabet><letter id="A" symbol="A"/><letter id="C" symbol="C"/><letter id="G" symbol="G"/><letter id="T" symbol="T"/></alphabet></training_set>
<model><background_frequencies><alphabet_array><value letter_id="A">0.25</value><value letter_id="C">0.25</value><value letter_id="G">0.25</value><value letter_id="T">0.25</value></alphabet_array></background_frequencies></model>
<motifs><motif id="m1" name="AC"><probabilities><alphabet_matrix><alphabet_array><value letter_id="A">1</value><value letter_id="C">0</value><value letter_id="G">0</value><value letter_id="T">0</value></alphabet_array>
<alphabet_array><value letter_id="A">0</value><value letter_id="C">0.5</value><value letter_id="G">0.5</value><value letter_id="T">0</value></alphabet_array></alphabet_matrix></probabilities></motif></motifs></MEME>"""
DREME = '<dreme><model><background A="0.3" C="0.2" G="0.2" T="0.3"/></model><motifs><motif id="m1" seq="AY"><pos A="1" C="0" G="0" T="0"/><pos A="0" C="0.5" G="0" T="0.5"/></motif></motifs></dreme>'


def test_motif_files(tmp_path):
    m = Matrix({"a": [1, -0.5], "c": [0, 0.25], "g": [0, 2], "t": [-1, 3]})
    motif_files.write_matrix(m, str(tmp_path / "m"))
    assert motif_files.read_matrix(str(tmp_path / "m")).values == m.values
    assert m.score("ac") == 1.25 and m.score("gt", reverse=True) == 1.25 and m.reverse_complement().score("gt") == 1.25 and m.score("nc") == 0.25
    motif_files.write_jaspar(m, str(tmp_path / "j"), "x")
    assert (tmp_path / "j").read_text().startswith(">x\nA [ 1.000000 -0.500000 ]\n")
    w = motif_files.motif_matrices(write(tmp_path / "a.xml", MEME), "pwm", 0.1)["AC"]
    assert math.isclose(w.get("a", 0), math.log2((1.1 / 1.4) / 0.25)) and math.isclose(w.get("g", 1), math.log2((0.6 / 1.4) / 0.25))
    d = motif_files.motif_matrices(write(tmp_path / "b.xml", DREME), "ppm", 0.0, ["AY"])["AY"]
    assert d.get("t", 1) == 0.5
    with pytest.raises(ValueError):
        motif_files.read_matrix(write(tmp_path / "bad", "A 1 2\nC 1\n"))


def test_bigwig_round_trip(spark, tmp_path):
    genome = spark.createDataFrame([("chr1", 40_000), ("chr2", 305), ("chrX", 1000)], "seqname string, length long")
    dense = [("chr1", i, None if i % 7 == 3 and i < 200 else float(i % 11)) for i in range(4000)]
    sparse = [("chr2", 3, 2.5), ("chr2", 17, -1.0), ("chrX", 0, 4.0)]
    t = Track.from_rows(spark.createDataFrame(dense + sparse, "seqname string, bin long, value double"), genome, 10)
    path = str(tmp_path / "a.bw")
    bigwig.write_track(t, path, [40, 160])
    again = bigwig.read_track(spark, path)
    want = sorted(map(tuple, t.rows.select("seqname", "bin", "value").collect()), key=str)
    assert again.bin_size == 10 and sorted(map(tuple, again.rows.select("seqname", "bin", "value").collect()), key=str) == want
    assert sorted(map(tuple, bigwig.read_genome(spark, path).select("seqname", "length").collect())) == [("chr1", 40_000), ("chr2", 305), ("chrX", 1000)]
    i = bigwig.info(spark, path).first()
    values = [v for _, _, v in want if v is not None]
    assert (i.levels, i.sequences, i.bases, i.min, i.max) == ([40, 160], 3, 10 * len(values), -1.0, 10.0) and math.isclose(i["sum"], sum(values))
    some = bigwig.read_records(spark, path, "chr[12]", 100, 200).collect()
    assert {(r.seqname, r.start) for r in some} == {("chr1", 10 * b) for b in range(10, 20) if b % 7 != 3} | {("chr2", 170)}
    assert {r.kind for r in bigwig.read_records(spark, path, "chr2").collect()} == {bigwig.VARIABLE}
    zoom = {(r.seqname, r.start): (r.valid, r["sum"]) for r in bigwig.read_zoom(spark, path, 40).collect()}
    assert zoom["chr1", 0] == (3.0, 0.0 + 1 + 2) and zoom["chr2", 0] == (1.0, 2.5)
    renamed = bigwig.rename_sequences(again, "^chr", "c")
    assert {r.seqname for r in renamed.genome.collect()} == {"c1", "c2", "cX"}
    with pytest.raises(Exception, match="no bigWig"):
        bigwig.info(spark, write(tmp_path / "no.bw", "x" * 200)).collect()


def record(ref, pos, flag, name, cigar, seq, mapq=30, aux=b"", next_ref=-1, next_pos=-1):
    n = name.encode() + b"\0"
    c = b"".join(struct.pack("<I", k << 4 | bam.OPERATIONS.index(o)) for k, o in cigar)
    codes = [bam.BASES.index(x) for x in seq] + [0] * (len(seq) % 2)
    s = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    body = bam.RECORD.pack(ref, pos, len(n), mapq, 4681, len(cigar), flag, len(seq), next_ref, next_pos, 0) + n + c + s + bytes(range(len(seq))) + aux
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    text_ = b"@HD\tVN:1.0\n"
    head = b"BAM\1" + struct.pack("<i", len(text_)) + text_ + struct.pack("<i", 2)
    for n, k in (("chr1", 1000), ("chr2", 500)):
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    aux = b"NMC\x05" + b"RGZabc\0" + b"ZZBs\x02\0\0\0\x01\0\xff\xff"
    recs = [
        record(0, 10, 0, "s1", [(3, "S"), (4, "M"), (1, "D"), (2, "M")], "ACGTACGTA", aux=aux), record(0, 100, 16 + 1024, "s2", [(5, "M")], "ACGTN"), record(-1, -1, 4, "u", [], "AC"),
        record(1, 50, 1 + 2 + 32 + 64, "p", [(4, "M")], "ACGT", 20, next_ref=1, next_pos=80), record(1, 80, 1 + 2 + 16 + 128, "p", [(4, "M")], "ACGT", 40, next_ref=1, next_pos=50),
    ]
    raw = head + b"".join(recs)
    path = tmp_path / "a.bam"
    path.write_bytes(gzip.compress(raw[:60]) + gzip.compress(raw[60:]) + gzip.compress(b""))
    full = bam.read_bam(spark, str(path)).orderBy("ord").collect()
    assert [r.read_name for r in full] == ["s1", "s2", "u", "p", "p"]
    assert full[0].cigar == "3S4M1D2M" and full[0].seq == "ACGTACGTA" and full[0].qual == "".join(chr(33 + i) for i in range(9)) and full[0].aux == {"NM": "5", "RG": "abc", "ZZ": "1,-1"}
    assert "seq" not in bam.read_bam(spark, str(path), ["cigar"]).columns
    assert sorted(map(tuple, bam.read_genome(spark, str(path)).select("seqname", "length").collect())) == [("chr1", 1000), ("chr2", 500)]
    lean = bam.read_bam(spark, str(path), ["cigar", "read_name"])
    reads = sorted(map(tuple, bam.simple_reads(lean, True, True).collect()))
    assert reads == [("chr1", 10, 17, "+", 30, False, False), ("chr1", 100, 105, "-", 30, True, False), ("chr2", 50, 84, "-", 20, False, True)]
    assert bam.simple_reads(lean, False).count() == 4
    assert zlib.crc32(bam.inflate(path.read_bytes())) == zlib.crc32(raw)


def test_nan_is_null(spark):
    from spanforge.operators.track import clean

    out = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double").select(clean(F.col("v")).alias("v")).collect()
    assert [r.v for r in out] == [None, 1.0, None]


def test_fastq_in_splits(spark, tmp_path):
    """Records that splits cut anywhere are put together; a short last record is an error."""
    rows = [(f"r{i} {'x' * (i % 5)}", "ACGT" * (1 + i % 7), "@+I#" * (1 + i % 7)) for i in range(150)]
    body = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows)
    for name in ("a.fq", "b.fq"):
        (tmp_path / "in").mkdir(exist_ok=True)
        write(tmp_path / "in" / name, body)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("61", "500", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = sorted((r.line, r.header, r.sequence, r.qualities) for r in text.read_fastq(spark, str(tmp_path / "in")).collect())
            assert got == sorted(((4 * i, *x) for i, x in enumerate(rows) for _ in range(2)))
            with pytest.raises(Exception, match="bad FASTQ record"):
                text.read_fastq(spark, write(tmp_path / "c.fq", body + "@r\nAC\n")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_tools_on_alignments_and_signals(spark, tmp_path):
    from spanforge.operators import coverage as C
    from spanforge.plans import tools

    refs = [("chr1", 1000), ("chr2", 500)]
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", z) for n, z in refs)
    reads = [("s1", 0, 0, 100), ("s2", 16, 0, 400), ("s3", 0, 1, 50), ("s4", 1024, 0, 100), ("s5", 256, 0, 100), ("s6", 512, 1, 50)]
    raw = head + b"".join(record(ref, pos, flag, n, [(4, "M")], "ACGT") for n, flag, ref, pos in reads)
    (tmp_path / "a.bam").write_bytes(gzip.compress(raw))
    a = str(tmp_path / "a.bam")
    assert tools.bam_genome(spark, a).count() == 2 and tools.bam_view(spark, a, ["cigar"]).count() == 6
    assert {r.row_id for r in tools.bam_check_bin(spark, a).collect()} <= set(range(6))
    fq = {r.header: (r.mate, r.sequence) for r in tools.bam_to_fastq(spark, a).collect()}
    assert fq == {"s1": (0, "ACGT"), "s2": (0, "ACGT"), "s3": (0, "ACGT"), "s4": (0, "ACGT")}
    write(tmp_path / "a.fq", "".join(f"@{n}\nACGT\n+\nIIII\n" for n in ("s1", "s2", "s9")))
    assert tools.bam_check_fastq(spark, a, [str(tmp_path / "a.fq")]).count() > 0
    bw = str(tmp_path / "cov.bw")
    track = tools.bam_to_bigwig(spark, [a], bw, C.CoverageOptions(bin_size=10))
    tools.bam_to_bigwig(spark, [a], str(tmp_path / "more.bw"), C.CoverageOptions(bin_size=10, estimate_fraglen=True, max_delay=400, fraglen_range=(0, 400)), save_fraglen=True, save_cross_correlation=True)
    (length,) = [int(r.value) for r in spark.read.text(str(tmp_path / "a.fraglen.txt")).collect()]
    lags = {int(r.value.split("\t")[0]): float(r.value.split("\t")[1]) for r in spark.read.text(str(tmp_path / "a.fraglen.table")).collect()}
    assert set(lags) == set(range(0, 400, 10)) and lags[length] == max(lags.values())
    back = {(r.seqname, r.bin): r.value for r in bigwig.read_track(spark, bw, 10).rows.collect()}
    want = {(r.seqname, r.bin): r.value for r in track.rows.collect()}
    assert back.keys() == want.keys() and all((back[k] or 0) == pytest.approx(want[k] or 0) for k in want) and sum(v or 0 for v in want.values()) > 0
    out = str(tmp_path / "out.bw")
    tools.bigwig_nil(spark, bw, out, 10)
    assert bigwig.read_track(spark, out, 10).rows.exceptAll(bigwig.read_track(spark, bw, 10).rows).count() == 0
    tools.bigwig_quantile_normalize(spark, bw, bw, out)
    assert tools.bigwig_statistics(spark, out).first()["max"] == tools.bigwig_statistics(spark, bw).first()["max"]
    genome = write(tmp_path / "g.txt", "chr1\t1000\nchr2\t500\n")
    avoid = write(tmp_path / "avoid.bed", "chr1\t0\t900\n")
    drawn = tools.draw_genomic_regions(spark, genome, 50, 40, avoid).collect()
    assert len(drawn) == 50 and all(r.seqname == "chr2" or r.start >= 900 for r in drawn)
    gtf = write(tmp_path / "a.gtf", 'chr1\tx\texon\t5\t90\t.\t+\t.\tgene_id "g1"\nchr1\tx\texon\t200\t300\t.\t+\t.\tgene_id "g1"\n')
    assert [r.name for r in tools.gtf_to_bed(spark, gtf).collect()] == ["exon", "exon"]
    (merged,) = tools.gtf_to_bed(spark, gtf, "gene_id").collect()
    assert (merged.start, merged.end) == (5, 300)
    for n, rows in (("s1", "chr1\t0\t100\tA\t0\t.\nchr1\t300\t500\tB\t0\t.\n"), ("s2", "chr1\t50\t150\tA\t0\t.\nchr2\t0\t100\tA\t0\t.\n")):
        write(tmp_path / f"{n}.bed", rows)
    diff = tools.segmentation_differential(spark, [str(tmp_path / "s1.bed"), str(tmp_path / "s2.bed")], ["A"], [bw, bw]).collect()
    assert sorted((r.seqname, r.start, r.end, tuple(r.labels)) for r in diff) == [("chr1", 0, 150, (0, 1)), ("chr2", 0, 100, (1,))]


def test_bigwig_in_a_new_folder(spark, tmp_path):
    genome = spark.createDataFrame([("a", 40)], "seqname string, length long")
    track = Track.from_rows(spark.createDataFrame([("a", 1, 2.5)], "seqname string, bin long, value double"), genome, 10)
    bigwig.write_track(track, path := f"file:{tmp_path}/not/yet/t.bw", [20])
    assert [(r.bin, r.value) for r in bigwig.read_track(spark, path, 10).rows.where("value is not null").collect()] == [(1, 2.5)]
    assert [(r.start, r.end, r.sum) for r in bigwig.read_zoom(spark, path, 20).collect()] == [(0, 20, 2.5)]
