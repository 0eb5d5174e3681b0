"""Round trips: every writer's file is read back by its reader, with the SQL of the rows that were written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.track import Track
from ..shared import new_path
from ..sources import bigwig, text
from . import views as V
from .views import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def named(spark, d):
    return V.iv_s(spark, d).select("row_id", "seqname", "start", "end", "strand", F.concat(F.lit("name "), F.col("row_id") % 97).alias("name"), (F.col("row_id") % 1000).alias("score"))


NAMED = "select seqname, start, \"end\", strand, 'name ' || (row_id % 97) as name, row_id % 1000 as score"


@query(with_views("iv_q", 'select seqname, start, "end", strand from iv_q'))
def format_roundtrip_bed3(spark, d):
    text.write_bed(V.iv_q(spark, d), path := new_path(spark, "bed3"))
    return text.read_bed(spark, path).drop("row_id")


@query(with_views("iv_s", NAMED + " from iv_s"))
def format_roundtrip_bed6(spark, d):
    text.write_bed(named(spark, d), path := new_path(spark, "bed6"), 6, compress=True)
    return text.read_bed(spark, path, 6).drop("row_id")


@query(with_views("iv_s", NAMED + """, start + 1 as "thickStart", "end" as "thickEnd", (row_id % 256) || ',0,9' as "itemRgb" from iv_s"""))
def format_roundtrip_bed9(spark, d):
    more = {"thickStart": F.col("start") + 1, "thickEnd": F.col("end"), "itemRgb": F.concat((F.col("row_id") % 256).cast("string"), F.lit(",0,9"))}
    text.write_bed(named(spark, d).withColumns(more), path := new_path(spark, "bed9"), 9)
    return text.read_bed(spark, path, 9).drop("row_id")


@query(with_views("iv_s", "select seqname, start, \"end\", strand, row_id % 1000 as score, 'n' || (row_id % 97) as label, start / 4.0 as level, case when row_id % 3 = 0 then '' else start || ',' || (row_id % 7) end as marks from iv_s"))
def format_roundtrip_table(spark, d):
    marks = F.when(F.col("row_id") % 3 == 0, F.array().cast("array<long>")).otherwise(F.array("start", F.col("row_id") % 7))
    rows = V.iv_s(spark, d).select("row_id", "seqname", "start", "end", "strand", (F.col("row_id") % 1000).alias("score"), F.concat(F.lit("n"), F.col("row_id") % 97).alias("label"), (F.col("start") / 4).alias("level"), marks.alias("marks"))
    text.write_table_text(rows, path := new_path(spark, "table"))
    back = text.read_table(spark, path, {"score": "Int", "label": "String", "level": "Float", "marks": "Vec<Int>"})
    return back.drop("row_id").withColumn("marks", F.array_join("marks", ","))


@query(with_views("iv_s", "select seqname, start, \"end\", strand, 'made' as source, 'exon' as feature, row_id % 5 + 0.5::double as score, cast(null as bigint) as frame, 'g ' || (row_id % 31) as gene_id, row_id % 9 as exon_number from iv_s"))
def format_roundtrip_gtf(spark, d):
    more = {"source": F.lit("made"), "feature": F.lit("exon"), "score": F.col("row_id") % 5 + 0.5, "gene_id": F.concat(F.lit("g "), F.col("row_id") % 31), "exon_number": F.col("row_id") % 9}
    text.write_gtf(V.iv_s(spark, d).withColumns(more), path := new_path(spark, "gtf"))
    return text.read_gtf(spark, path, {"gene_id": "str", "exon_number": "int"}).drop("row_id")


@query(with_views("iv_s", "select seqname, start, \"end\", '*' as strand, case when row_id % 4 = 0 then null else (row_id % 1000) / 8.0 end as values from iv_s"))
def format_roundtrip_bedgraph(spark, d):
    value = F.when(F.col("row_id") % 4 != 0, (F.col("row_id") % 1000) / 8)
    text.write_bedgraph(V.iv_s(spark, d).withColumn("values", value), path := new_path(spark, "bedgraph"))
    return text.read_bedgraph(spark, path).drop("row_id")


@query(with_views("trk", "select seqname, bin, value from trk where value is not null"))
def format_roundtrip_wiggle(spark, d):
    text.write_wiggle(V.track_rows(spark, d), path := new_path(spark, "wiggle"), 10)
    return text.read_wiggle(spark, path, 10).where("value is not null")


@query(with_views("dna", "select name, sequence from dna"))
def format_roundtrip_fasta(spark, d):
    text.write_fasta(V.dna(spark, d), path := new_path(spark, "fasta"))
    return text.read_fasta(spark, path).select("name", "sequence")


@query(with_views("dna", "select name || ' x' as header, sequence, translate(sequence, 'acgt', 'I#!@') as qualities from dna where sequence <> ''"))
def format_roundtrip_fastq(spark, d):
    reads = V.dna(spark, d).where("sequence <> ''").select(F.concat("name", F.lit(" x")).alias("header"), "sequence", F.translate("sequence", "acgt", "I#!@").alias("qualities"))
    text.write_fastq(reads, path := new_path(spark, "fastq"))
    return text.read_fastq(spark, path).drop("line")


@query(with_views("genome", "select seqname, length from genome"))
def format_roundtrip_genome(spark, d):
    text.write_genome(V.genome(spark, d), path := new_path(spark, "genome"))
    return text.read_genome(spark, path).drop("ord")


@query(with_views("trk", "select seqname, bin, n as value from trk"))
def format_roundtrip_bigwig(spark, d):
    track = Track(V.track_rows(spark, d, "count"), 10, V.track_genome(spark))
    bigwig.write_track(track, path := new_path(spark, "bigwig"))
    return bigwig.read_track(spark, path, 10).rows


@query(with_views("trk", "select seqname, bin // 8 * 80 as start, bin // 8 * 80 + 80 as \"end\", cast(count(n) as double) as valid, min(n) as min, max(n) as max, sum(n) as sum, sum(n * n) as sum_squares from trk group by seqname, bin // 8 having count(n) > 0"))
def format_roundtrip_bigwig_zoom(spark, d):
    track = Track(V.track_rows(spark, d, "count"), 10, V.track_genome(spark))
    bigwig.write_track(track, path := new_path(spark, "bigwig"), zooms=[80])
    return bigwig.read_zoom(spark, path, 80)
