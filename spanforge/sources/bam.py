"""Alignment files (BAM): header, records with the columns that are asked for, reads and ranges."""

from __future__ import annotations

import gzip
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import cigar_length, flag_bit

OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"  # codes of the format (fixed values)
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
RECORD = struct.Struct("<iiBBHHHiiii")
COLUMNS = {"read_name": "string", "cigar": "string", "seq": "string", "qual": "string", "aux": "map<string,string>"}
FIXED = "ord long, ref_id int, seqname string, position long, bin int, mapq int, flag int, l_seq int, next_ref_id int, next_position long, tlen int"


def inflate(raw: bytes) -> bytes:
    """All members of a blocked gzip file."""
    return gzip.decompress(raw)


def header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, references (name, length), and where the records begin."""
    if data[:4] != b"BAM\1":
        raise ValueError("no BAM file")
    (n,) = struct.unpack_from("<i", data, 4)
    text, at = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
    (refs,), at = struct.unpack_from("<i", data, at), at + 4
    out = []
    for _ in range(refs):
        (k,) = struct.unpack_from("<i", data, at)
        out.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    return text, out, at


def _aux(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data):
        tag, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub = NUMBERS[chr(data[at])]
            (n,) = struct.unpack_from("<i", data, at + 1)
            value = ",".join(map(str, struct.unpack_from(f"<{n}{sub}", data, at + 5)))
            at += 5 + n * struct.calcsize(f"<{sub}")
        else:
            f = NUMBERS[kind]
            value, at = str(struct.unpack_from(f"<{f}", data, at)[0]), at + struct.calcsize(f"<{f}")
        out[tag] = value
    return out


def records(data: bytes, wanted: set[str]):
    """Tuples of the fixed columns and the wanted ones."""
    _, refs, at = header(data)
    ord_ = 0
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        ref, pos, l_name, mapq, bin_, n_cigar, flag, l_seq, next_ref, next_pos, tlen = RECORD.unpack_from(data, at + 4)
        p = at + 36
        row = [ord_, ref, refs[ref][0] if ref >= 0 else None, pos, bin_, mapq, flag, l_seq, next_ref, next_pos, tlen]
        name_at, cigar_at = p, p + l_name
        seq_at = cigar_at + 4 * n_cigar
        qual_at = seq_at + (l_seq + 1) // 2
        if "read_name" in wanted:
            row.append(data[name_at : cigar_at - 1].decode())
        if "cigar" in wanted:
            row.append("".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, cigar_at)))
        if "seq" in wanted:
            row.append("".join(BASES[b >> 4] + BASES[b & 15] for b in data[seq_at:qual_at])[:l_seq])
        if "qual" in wanted:
            q = data[qual_at : qual_at + l_seq]
            row.append("" if q[:1] == b"\xff" else "".join(chr(x + 33) for x in q))
        if "aux" in wanted:
            row.append(_aux(data[qual_at + l_seq : at + 4 + size]))
        yield tuple(row)
        ord_ += 1
        at += 4 + size


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    def run(frames):
        for f in frames:
            rows = [(n, length, i) for c in f["content"] for i, (n, length) in enumerate(header(inflate(bytes(c)))[1])]
            yield pd.DataFrame(rows, columns=["seqname", "length", "ord"])

    return _files(spark, path).mapInPandas(run, "seqname string, length long, ord long").dropDuplicates(["seqname"])


def read_bam(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records with the fixed columns and, of read_name, cigar, seq, qual and aux, those in ``columns`` (all by default)."""
    wanted = [c for c in COLUMNS if columns is None or c in columns]
    schema = FIXED + "".join(f", {c} {COLUMNS[c]}" for c in wanted)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for f in frames:
            for c in f["content"]:
                batch = []
                for r in records(inflate(bytes(c)), set(wanted)):
                    batch.append(r)
                    if len(batch) == 20_000:
                        yield pd.DataFrame(batch, columns=names)
                        batch = []
                yield pd.DataFrame(batch, columns=names)

    return _files(spark, path).mapInPandas(run, schema)


def single_reads(bam: DataFrame) -> DataFrame:
    """Mapped records as reads: (seqname, start, end, strand, mapq, duplicate, paired_end, row_id)."""
    flag = F.col("flag")
    start = F.col("position")
    return bam.where(~flag_bit(flag, "unmapped") & (F.col("ref_id") >= 0)).select(
        "seqname", start.alias("start"), (start + cigar_length(F.col("cigar"))).alias("end"), F.when(flag_bit(flag, "reverse"), "-").otherwise("+").alias("strand"),
        "mapq", flag_bit(flag, "duplicate").alias("duplicate"), F.lit(False).alias("paired_end"), F.col("ord").alias("row_id"), *[c for c in bam.columns if c in ("read_name", "flag", "seq", "qual", "cigar")],
    )


def read_pairs(bam: DataFrame) -> DataFrame:
    """Mates of proper pairs on one sequence, side by side in the order of their positions; (read_name, columns with 1 and 2)."""
    flag = F.col("flag")
    primary = flag_bit(flag, "paired") & ~flag_bit(flag, "secondary") & ~flag_bit(flag, "supplementary") & ~flag_bit(flag, "unmapped") & ~flag_bit(flag, "mate_unmapped")
    own = single_reads(bam.where(primary))
    proper = flag_bit(flag, "proper_pair")
    own = own.where(proper)
    cols = [c for c in own.columns if c != "read_name"]
    rows = F.struct("start", "row_id", *[c for c in cols if c not in ("start", "row_id")])
    two = own.groupBy("read_name").agg(F.min(rows).alias("a"), F.max(rows).alias("b"), F.count("*").alias("n")).where("n = 2 and a.seqname = b.seqname")
    return two.select("read_name", *[F.col(f"a.{c}").alias(f"{c}1") for c in cols], *[F.col(f"b.{c}").alias(f"{c}2") for c in cols])


def simple_reads(bam: DataFrame, join_pairs: bool = True, strand_specific: bool = False) -> DataFrame:
    """Reads of coverage: fragments of proper pairs where pairs are joined, and single records else."""
    columns = ["seqname", "start", "end", "strand", "mapq", "duplicate", "paired_end"]
    flag = F.col("flag")
    single = single_reads(bam if not join_pairs else bam.where(~flag_bit(flag, "paired")))
    single = single.withColumn("paired_end", flag_bit(F.col("flag"), "paired")).select(columns)
    if not join_pairs:
        return single
    p = read_pairs(bam)
    second = F.when(flag_bit(F.col("flag2"), "second_in_pair"), F.col("strand2")).otherwise(F.col("strand1"))
    fragments = p.select(
        F.col("seqname1").alias("seqname"), F.col("start1").alias("start"), F.col("end2").alias("end"), (second if strand_specific else F.lit("*")).alias("strand"),
        F.least("mapq1", "mapq2").alias("mapq"), (F.col("duplicate1") | F.col("duplicate2")).alias("duplicate"), F.lit(True).alias("paired_end"),
    )
    return single.unionByName(fragments)
