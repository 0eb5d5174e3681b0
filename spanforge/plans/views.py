"""Interval, track, read, sequence and gene views of the plain test tables, and the same in DuckDB's SQL.

The tables hold no genomic files, so every operator runs on these views, over
all their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def iv_s(spark: SparkSession, d: str) -> DataFrame:
    """Subjects, one for each line item; the four key columns make the row_id."""
    return table(spark, d, "lineitem").select(
        F.expr("((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey").alias("row_id"),
        F.concat(F.lit("chr"), F.col("l_suppkey") % 20).alias("seqname"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("start"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("end"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
    )


def span(spark: SparkSession, d: str) -> int:
    """Ten times the number of part keys."""
    return 10 * (table(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1)


def iv_q(spark: SparkSession, d: str) -> DataFrame:
    """Queries, one for each order."""
    m = table(spark, d, "part").agg((10 * (F.max("p_partkey") + 1)).alias("m"))
    start = (F.col("o_orderkey") * 17) % F.col("m")
    return table(spark, d, "orders").crossJoin(F.broadcast(m)).select(  # one row
        F.col("o_orderkey").alias("row_id"), F.concat(F.lit("chr"), F.col("o_custkey") % 20).alias("seqname"),
        start.alias("start"), (start + 1 + F.col("o_orderkey") % 40).alias("end"), F.lit("*").alias("strand"),
    )


def genome(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").agg((10 * (F.max("p_partkey") + 1) + 100).alias("length"))
    return spark.range(20).crossJoin(F.broadcast(m)).select(F.concat(F.lit("chr"), F.col("id")).alias("seqname"), "length")


def reads(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "lineitem").select(
        F.expr("((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey").alias("row_id"),
        F.concat(F.lit("chr"), F.col("l_suppkey") % 20).alias("seqname"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("start"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("end"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        (F.col("l_linenumber") * 10).cast("int").alias("mapq"), (F.col("l_returnflag") == "R").alias("duplicate"), (F.col("l_linestatus") == "F").alias("paired_end"),
    )
    return more


def track_rows(spark: SparkSession, d: str, value: str = "sum") -> DataFrame:
    """Hourly bins of ten users' groups; bins without events have no value."""
    v = {"sum": F.round(F.sum("value"), 2), "count": F.count("*").cast("double")}[value]
    have = table(spark, d, "events").groupBy(
        F.concat(F.lit("u"), F.col("user_id") % 10).alias("seqname"), (F.floor(F.unix_timestamp("ts") / 3600) - 473352).alias("bin"),
    ).agg(v.alias("value"))
    grid = spark.range(10).select(F.concat(F.lit("u"), F.col("id")).alias("seqname"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))).alias("bin"))
    return grid.join(have, ["seqname", "bin"], "left")


def track_genome(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.concat(F.lit("u"), F.col("id")).alias("seqname"), F.lit(7200).cast("long").alias("length"))


def dna(spark: SparkSession, d: str) -> DataFrame:
    """Sequences: the letters a, c, g and t of each document's lower-cased text."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id")).alias("name"), F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("sequence"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("p_partkey") * 10
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_name").alias("names"), F.concat(F.lit("chr"), F.col("p_partkey") % 20).alias("seqname"),
        at.alias("start"), (at + 50 + F.col("p_size")).alias("end"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.struct((at + 5).alias("from"), (at + 45).alias("to")).alias("cds"),
    )


#: The views as DuckDB's SQL, to stand in a WITH clause.
SQL = {
    "iv_s": """iv_s as (select ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as row_id, 'chr' || (l_suppkey % 20) as seqname,
    l_partkey * 10 + l_linenumber as start, l_partkey * 10 + l_linenumber + cast(l_quantity as bigint) as "end", case when l_linestatus = 'O' then '+' else '-' end as strand,
    cast(l_linenumber * 10 as integer) as mapq, l_returnflag = 'R' as duplicate, l_linestatus = 'F' as paired_end from lineitem)""",
    "iv_q": """iv_q as (select o_orderkey as row_id, 'chr' || (o_custkey % 20) as seqname, (o_orderkey * 17) % m as start, (o_orderkey * 17) % m + 1 + o_orderkey % 40 as "end", '*' as strand
    from orders, (select 10 * (max(p_partkey) + 1) as m from part))""",
    "genome": """genome as (select 'chr' || i as seqname, m + 100 as length from range(20) t(i), (select 10 * (max(p_partkey) + 1) as m from part))""",
    "trk": """have as (select 'u' || (user_id % 10) as seqname, cast(floor(epoch(ts) / 3600) as bigint) - 473352 as bin, round(sum(value), 2) as value, cast(count(*) as double) as n from events group by 1, 2),
    trk as (select g.seqname, g.bin, value, n from (select 'u' || i as seqname, b as bin from range(10) t(i), range(720) u(b)) g left join have using (seqname, bin))""",
    "dna": """dna as (select doc_id as ord, 'd' || doc_id as name, regexp_replace(lower(text), '[^acgt]', '', 'g') as sequence from documents)""",
    "genes": """genes as (select p_partkey as row_id, p_name as names, 'chr' || (p_partkey % 20) as seqname, p_partkey * 10 as start, p_partkey * 10 + 50 + p_size as "end",
    case when p_size % 2 = 0 then '+' else '-' end as strand, p_partkey * 10 + 5 as cds_from, p_partkey * 10 + 45 as cds_to from part)""",
}


def with_views(names: str, sql: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names.split()) + "\n" + sql


def and_views(names: str, sql: str) -> str:
    """For queries with common table expressions of their own."""
    return "with " + ",\n".join(SQL[n] for n in names.split()) + ",\n" + sql
