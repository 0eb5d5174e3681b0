"""Sequence tables (name, sequence): motifs, composition, extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import observed_over_expected_cpg

#: Bases in a piece of a long sequence.
PIECE = 1 << 16
#: Rows that Python gives back at once, and a few more.
ROWS = 1 << 15


def as_bytes(sequence: Column) -> Column:
    """One byte a letter, others than ASCII as ``?``: a piece of bytes is found at once, of text only by walking there."""
    plain = F.octet_length(sequence) == F.char_length(sequence)
    return F.when(plain, sequence).otherwise(F.regexp_replace(sequence, r"[^\x00-\x7F]", "?")).cast("binary")


def pieces(sequences: DataFrame, overlap: int, size: int = PIECE) -> DataFrame:
    """Cuts sequences into pieces of ``size`` bases, as bytes, that share ``overlap`` with the next: adds ``offset``.

    A window of up to ``overlap`` + 1 bases that starts in a piece lies in it.
    """
    own = sequences.withColumn("sequence", as_bytes(F.col("sequence")))
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("sequence") - 1, F.lit(0)), F.lit(size))
    cut = own.withColumn("offset", F.explode(starts))
    return cut.withColumn("sequence", F.substring(F.col("sequence"), F.col("offset") + 1, F.lit(size + overlap)))


def windows(sequences: DataFrame, k: int, column: str = "kmer") -> DataFrame:
    """Every window of ``k`` bases with its start in the whole sequence: adds ``at`` and ``column``."""
    cut = pieces(sequences, k - 1).where(F.octet_length("sequence") >= k)
    n = F.least(F.octet_length("sequence") - k + 1, F.lit(PIECE))
    each = cut.withColumn("_i", F.explode(F.sequence(F.lit(1), n)))
    return each.withColumn(column, F.substring(F.col("sequence"), F.col("_i"), F.lit(k)).cast("string")).withColumn("at", (F.col("offset") + F.col("_i") - 1).cast("long")).drop("_i", "offset", "sequence")


def motif_scan(sequences: DataFrame, motif: str) -> DataFrame:
    """Intervals (seqname, start, end) of a motif in either case; overlapping ones too."""
    hits = windows(sequences, len(motif), "_w").where(F.lower("_w") == motif.lower())
    return hits.select(F.col("name").alias("seqname"), F.col("at").alias("start"), (F.col("at") + len(motif)).alias("end"), F.lit("*").alias("strand"))


def unresolved(sequences: DataFrame, letters: str = "nN") -> DataFrame:
    """Maximal runs of the letters as intervals (seqname, start, end). Each sequence is searched once, where it stands."""
    pattern = f"[{letters}]+"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).finditer
        for batch in batches:
            names, texts = batch.columns
            row, start, end = [], [], []
            for i, text in enumerate(texts):
                for m in find(text.as_py() or ""):
                    row.append(i)
                    start.append(m.start())
                    end.append(m.end())
                if len(row) >= ROWS or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["seqname", "start", "end"])
                    row, start, end = [], [], []

    named = sequences.select(F.col("name").alias("seqname"), "sequence")
    schema = f"seqname {named.schema['seqname'].dataType.simpleString()}, start long, end long"
    return named.mapInArrow(run, schema).withColumn("strand", F.lit("*"))


def extract(sequences: DataFrame, regions: DataFrame, size: int = PIECE) -> DataFrame:
    """``regions`` with the bases under each as ``sequence``; what lies outside is an error, unknown names too.

    Regions meet the pieces of their sequence that they touch, so no row carries
    a whole chromosome and a long sequence is spread over tasks.
    """
    columns = regions.columns
    own = sequences.select(F.col("name").alias("seqname"), as_bytes(F.col("sequence")).alias("_s"))
    at = F.sequence(F.lit(0), F.octet_length("_s").cast("long"), F.lit(size).cast("long"))  # with a last piece for what ends at the end
    cut = own.withColumn("_at", F.explode(at)).select("seqname", (F.col("_at") / size).cast("long").alias("_piece"), F.substring(F.col("_s"), (F.col("_at") + 1).cast("int"), F.lit(size)).alias("_s"))
    valid = F.when((F.col("start") < 0) | (F.col("start") > F.col("end")), F.raise_error("range outside the sequence")).otherwise(F.col("start"))
    asked = regions.withColumn("_region", F.monotonically_increasing_id() if "row_id" not in columns else F.col("row_id")).withColumn("_all", F.struct(*columns))
    asked = asked.select("_region", "_all", "seqname", valid.alias("_from"), F.col("end").alias("_to"))
    asked = asked.withColumn("_piece", F.explode(F.expr(f"sequence(_from div {size}, greatest(_to - 1, _from) div {size})")))
    met = asked.join(cut, ["seqname", "_piece"], "left")
    first, last = F.greatest(F.col("_from") - F.col("_piece") * size, F.lit(0)), F.least(F.col("_to") - F.col("_piece") * size, F.lit(size))
    inside = F.col("_s").isNotNull() & (last <= F.octet_length("_s"))
    part = F.when(inside, F.substring(F.col("_s"), (first + 1).cast("int"), (last - first).cast("int")).cast("string")).otherwise(F.raise_error("range outside the sequence, or the sequence is missing"))
    each = met.groupBy("_region").agg(F.any_value("_all").alias("_all"), F.array_sort(F.collect_list(F.struct("_piece", part.alias("s")))).alias("_parts"))
    return each.select("_all.*", F.array_join("_parts.s", "").alias("sequence"))


def cpg(sequences: DataFrame) -> DataFrame:
    return sequences.select("name", observed_over_expected_cpg(F.col("sequence")).alias("observed_over_expected"))
