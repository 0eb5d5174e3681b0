"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters and their complements, in the same order (fixed values).
LETTERS = "ACGTMRSVWYHKDBN="
COMPLEMENTS = "TGCAKYSBWRDMHVN="


def reverse_complement(seq: Column) -> Column:
    """Reverse complement in upper case; letters outside IUPAC become N."""
    lower = LETTERS.lower()
    known = F.regexp_replace(F.translate(seq, lower, LETTERS), f"[^{LETTERS}]", "N")
    return F.translate(F.reverse(known), LETTERS, COMPLEMENTS)


def complement(seq: Column) -> Column:
    """Complement that keeps the letters' case."""
    return F.translate(seq, LETTERS + LETTERS.lower(), COMPLEMENTS + COMPLEMENTS.lower())


def revcomp(seq: Column) -> Column:
    """Reverse complement that keeps the letters' case."""
    return F.reverse(complement(seq))


def observed_over_expected_cpg(seq: Column) -> Column:
    """n(CpG) * length / (n(C) * n(G)), 0 without a CpG; letters of either case."""
    s = F.lower(seq)
    count = lambda p: F.regexp_count(s, F.lit(p))
    return F.when(count("cg") == 0, 0.0).otherwise(count("cg") * F.length(s) / (count("c") * count("g")))


def substring(seq: Column, start: Column, end: Column) -> Column:
    """Bases of [start, end); ranges outside the sequence are an error."""
    inside = (start >= 0) & (start <= end) & (end <= F.length(seq))
    return F.when(inside, F.substring(seq, (start + 1).cast("int"), (end - start).cast("int"))).otherwise(F.raise_error("range outside the sequence"))


def read_name(name: Column) -> Column:
    """First token without a leading @ and without /1 or /2."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"^\s*(\S*)", 1), "^@", ""), "/[12]$", "")


def fasta_name(header: Column) -> Column:
    """First token of a header, split at white space and bars."""
    return F.regexp_extract(header, r"[^\s|]+", 0)


def unquoted(text: Column) -> Column:
    """Trimmed, without a pair of quotes around."""
    return F.regexp_replace(F.trim(text), '^"(.*)"$', "$1")


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def ucsc_bin(start: Column, end: Column) -> Column:
    """Number of the least bin of the five-level scheme that holds [start, end)."""
    last = end - 1
    out = F.lit(0)
    # levels from the coarsest to the finest: shift, offset (fixed values)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(start, shift) == F.shiftright(last, shift), F.shiftright(start, shift) + offset).otherwise(out)
    return out.cast("int")


def phred_text(quality: Column) -> Column:
    """Quality numbers as text, 33 up."""
    return F.array_join(F.transform(quality, lambda q: F.char(q + 33)), "")


def cigar_text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda c: F.concat(c["n"].cast("string"), c["op"])), "")


def fastq_sequence(seq: Column, reverse: Column) -> Column:
    """The read as it was sequenced."""
    return F.when(reverse, reverse_complement(seq)).otherwise(seq)


def fastq_quality(quality: Column, seq: Column, reverse: Column, fill: str | None = None) -> Column:
    """Qualities in the order of sequencing; missing ones are an error or filled with one letter."""
    missing = quality.isNull() | (quality == "") | (quality == "*")
    instead = F.raise_error("qualities are missing") if fill is None else F.repeat(F.lit(fill), F.length(seq))
    return F.when(missing, instead).when(reverse, F.reverse(quality)).otherwise(quality)


def distinct_first(values: Column) -> Column:
    """An array's distinct values in the order of their first occurrence."""
    return F.array_distinct(values)
