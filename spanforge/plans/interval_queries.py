"""Queries of the interval operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genes as G
from ..operators import intervals as I
from ..operators import names as N
from ..operators import reads as R
from ..functions.scalar import ucsc_bin
from . import views as V
from .views import and_views, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Both engines join on blocks of positions; the SQL's are of its own width.
PAIRS = """qb as (select row_id as q_id, seqname, start as qs, "end" as qe, unnest(range(start // 64, ("end" - 1) // 64 + 1)) as b from iv_q where start < "end"),
sb as (select row_id as s_id, seqname, start as ss, "end" as se, unnest(range(start // 64, ("end" - 1) // 64 + 1)) as b from iv_s where start < "end"),
pairs as (select q_id, s_id, seqname, qs, qe, ss, se from qb join sb using (seqname, b) where qs < se and ss < qe and b = greatest(qs // 64, ss // 64))
"""


@query(and_views("iv_q iv_s", PAIRS + 'select q_id, s_id, seqname, greatest(qs, ss) as start, least(qe, se) as "end" from pairs'))
def overlap_join(spark, d):
    p = I.overlaps(V.iv_q(spark, d), V.iv_s(spark, d))
    return p.select("q_id", "s_id", "seqname", F.greatest("q_start", "s_start").alias("start"), F.least("q_end", "s_end").alias("end"))


@query(and_views("iv_q iv_s", PAIRS + "select * from iv_q where row_id in (select q_id from pairs)"))
def overlap_semi(spark, d):
    return I.overlap_semi(V.iv_q(spark, d), V.iv_s(spark, d))


@query(and_views("iv_q iv_s", PAIRS + "select * from iv_q where row_id not in (select q_id from pairs)"))
def overlap_anti(spark, d):
    return I.overlap_anti(V.iv_q(spark, d), V.iv_s(spark, d))


@query(and_views("iv_q iv_s", PAIRS + "select q_id as row_id, seqname, '*' as strand, s_id, greatest(qs, ss) as start, least(qe, se) as \"end\" from pairs"))
def intersection(spark, d):
    return I.intersection(V.iv_q(spark, d), V.iv_s(spark, d))


@query(
    and_views(
        "iv_q iv_s",
        """zero as (select q.row_id as q_id, s.row_id as s_id, 0 as distance from iv_q q join iv_s s on q.seqname = s.seqname and q.start <= s."end" and s.start <= q."end"),
l as (select q_id, s_id, gap, 0 as side from (select q.row_id as q_id, s.row_id as s_id, q.start - s."end" as gap, row_number() over (partition by q.row_id order by q.start - s."end", s.row_id) as n
  from iv_q q join iv_s s on q.seqname = s.seqname and s."end" < q.start and s."end" > q.start - 3000) where n <= 3),
r as (select q_id, s_id, gap, 1 as side from (select q.row_id as q_id, s.row_id as s_id, s.start - q."end" as gap, row_number() over (partition by q.row_id order by s.start - q."end", s.row_id) as n
  from iv_q q join iv_s s on q.seqname = s.seqname and s.start > q."end" and s.start < q."end" + 3000) where n <= 3),
b as (select *, row_number() over (partition by q_id order by gap, side, s_id) as n from (select * from l union all select * from r))
select q_id, s_id, cast(distance as bigint) as distance from zero union all select q_id, s_id, cast(case when side = 0 then gap else -gap end as bigint) from b where n <= 3""",
    )
)
def nearest_k(spark, d):
    return I.nearest(V.iv_q(spark, d), V.iv_s(spark, d), 3)


ISLANDS = """e as (select seqname, start, "end", max("end") over (partition by seqname order by start, "end" rows between unbounded preceding and 1 preceding) as upto from {0}),
m as (select *, sum(case when upto is null or start >= upto then 1 else 0 end) over (partition by seqname order by start, "end" rows unbounded preceding) as island from e)
"""


@query(and_views("iv_s", ISLANDS.format("iv_s") + "select seqname, min(start) as start, max(\"end\") as \"end\", '*' as strand from m group by seqname, island"))
def merge_ranges(spark, d):
    return I.merge(V.iv_s(spark, d))


@query(
    and_views(
        "iv_s",
        ISLANDS.format("iv_s")
        + """, r as (select seqname, min(start) as start, max("end") as "end" from m group by seqname, island),
l as (select r.seqname, r.start, r."end", bool_or(strand = '+') as p, bool_or(strand = '-') as n from r join iv_s s on r.seqname = s.seqname and s.start < r."end" and r.start < s."end" group by all)
select seqname, start, "end", case when p and n then '0,1' when p then '0' else '1' end as labels from l""",
    )
)
def merge_many_labels(spark, d):
    s = V.iv_s(spark, d)
    sets = [I.filter_strand(s, "+"), I.filter_strand(s, "-")]
    regions = I.merge_many(sets).withColumn("row_id", F.struct("seqname", "start"))
    return I.label_regions(regions, sets).select("seqname", "start", "end", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query(and_views("iv_s", ISLANDS.format("iv_s") + """, r as (select seqname, min(start) as start, max("end") as "end" from m group by seqname, island),
l as (select r.seqname, r.start, count(distinct strand) as n from r join iv_s s on r.seqname = s.seqname and s.start < r."end" and r.start < s."end" group by all)
select cast(n as integer) as n_sets, count(*) as regions, round(count(*) / (select count(*) from l), 6) as fraction from l group by n"""))
def presence_statistics(spark, d):
    from ..operators.segmentation import presence

    s = V.iv_s(spark, d)
    sets = [I.filter_strand(s, "+"), I.filter_strand(s, "-")]
    regions = I.merge_many(sets).withColumn("row_id", F.struct("seqname", "start"))
    return presence(I.label_regions(regions, sets)).withColumn("fraction", F.round("fraction", 6))


@query(with_views("iv_s genome", 'select row_id, s.seqname, start, "end", strand from iv_s s join genome g on s.seqname = g.seqname and "end" <= length - 150'))
def filter_genome(spark, d):
    g = V.genome(spark, d).withColumn("length", F.col("length") - 150)
    return I.filter_genome(V.iv_s(spark, d), g)


@query(with_views("iv_s", "select row_id, seqname, start, \"end\", strand from iv_s where strand = '-'"))
def filter_strand(spark, d):
    return I.filter_strand(V.iv_s(spark, d), "-")


@query(with_views("iv_s", "select row_id, seqname, case when strand = '-' then greatest(\"end\" - 25, 0) else start end as start, case when strand = '+' then start + 25 else \"end\" end as \"end\", strand from iv_s"))
def set_lengths(spark, d):
    return I.set_lengths(V.iv_s(spark, d), 25)


@query(with_views("iv_s", 'select row_id, seqname, greatest((start + "end") // 2 - 50, 0) as start, greatest((start + "end") // 2 - 50, 0) + 100 as "end", strand from iv_s'))
def resize_center(spark, d):
    return I.resize_center(V.iv_s(spark, d), 100)


@query(with_views("iv_q iv_s", 'select row_id, seqname, start, "end", strand from iv_s union all select row_id, seqname, start, "end", strand from iv_q'))
def append_ranges(spark, d):
    return I.append(V.iv_s(spark, d), V.iv_q(spark, d))


@query(with_views("iv_s", 'select seqname, start, "end", row_id, n from (select *, row_number() over (order by seqname desc, start desc, "end" desc, row_id) as n from iv_s) where n <= 100'))
def sort_ranges_topk(spark, d):
    from pyspark.sql import Window

    top = I.sort_ranges(V.iv_s(spark, d), "", reverse=True).limit(100)
    order = Window.orderBy(F.desc("seqname"), F.desc("start"), F.desc("end"), "row_id")  # a hundred rows
    return top.select("seqname", "start", "end", "row_id", F.row_number().over(order).cast("long").alias("n"))


@query(with_views("iv_q iv_s", """select q.row_id, q.seqname, q.start, q."end", q.strand from iv_q q anti join (select distinct o_orderkey as row_id from orders where o_orderstatus = 'F') r using (row_id)"""))
def remove_rows(spark, d):
    rows = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("row_id"))
    return I.remove(V.iv_q(spark, d), rows)


@query(with_views("iv_q", 'select row_id, seqname, start, "end", strand, cast(o as bigint) as ord from (select l_orderkey as row_id, l_linenumber as o from lineitem) r join iv_q using (row_id)'))
def subset_rows(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").cast("long").alias("ord"))
    return I.subset(V.iv_q(spark, d), rows)


@query(with_views("iv_q", 'select row_id, seqname, start, "end", strand from iv_q where row_id >= 100 and row_id < 900'))
def slice_rows(spark, d):
    return I.slice_rows(V.iv_q(spark, d), 100, 900)


# Reads ----------------------------------------------------------------------


@query(with_views("iv_s", 'select row_id, seqname, start, "end", strand, mapq, duplicate, paired_end from iv_s where not paired_end and "end" - start between 10 and 40 and not duplicate and mapq >= 30 and strand = \'+\''))
def read_filters(spark, d):
    return R.filtered(V.reads(spark, d), single_only=True, lengths=(10, 40), no_duplicates=True, mapq=30, strand="+")


@query(with_views("iv_s", """select row_id, seqname, case when not paired_end and strand = '-' then greatest("end" - 60, 0) else start end as start,
  case when not paired_end and strand = '+' then start + 60 else "end" end as "end", strand, mapq, duplicate, paired_end from iv_s"""))
def read_extend(spark, d):
    return R.extend(V.reads(spark, d), 60)


@query(with_views("iv_s", """select row_id, seqname, greatest(start + case strand when '+' then 7 else -12 end, 0) as start, greatest(start + case strand when '+' then 7 else -12 end, 0) + "end" - start as "end", strand, mapq, duplicate, paired_end from iv_s"""))
def shift_reads(spark, d):
    return R.shift(V.reads(spark, d), 7, 12)


@query(
    and_views(
        "iv_s",
        """named as (select s.*, l_orderkey as name from iv_s s join (select ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as row_id, l_orderkey from lineitem) using (row_id)),
two as (select *, row_number() over (partition by name order by start, row_id) as n, count(*) over (partition by name) as c from named),
p as (select a.name, a.seqname as s1, b.seqname as s2, a.start as a1, b.start as a2, a."end" as e1, b."end" as e2, a.mapq as m1, b.mapq as m2, a.duplicate as d1, b.duplicate as d2, b.strand as st from two a join two b on a.name = b.name and a.n = 1 and b.n = 2 and a.c = 2)
select s1 as seqname, least(a1, a2) as start, greatest(e1, e2) as "end", st as strand, least(m1, m2) as mapq, d1 or d2 as duplicate, true as paired_end from p where s1 = s2""",
    )
)
def mate_pairs(spark, d):
    names = V.table(spark, d, "lineitem").select(F.expr("((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey").alias("row_id"), F.col("l_orderkey").alias("name"))
    pairs = R.mate_pairs(V.reads(spark, d).join(names, "row_id"), "name", ["start", "row_id"])
    return R.pair_fragments(pairs, strand_specific=True)


@query(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"(l_partkey & {1 << i}) <> 0 as {n}" for i, n in enumerate(R.FLAG_BITS)) + " from lineitem"
)
def flag_bits(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in R.flag_bits(F.col("l_partkey")).items()])


@query("select o_orderkey, cast(o_orderkey % 90 + 1 + o_orderkey % 5 + o_custkey % 30 + 1 as bigint) as n from orders")
def cigar_length(spark, d):
    k = F.col("o_orderkey")
    cigar = F.concat(F.lit("5S"), k % 90 + 1, F.lit("M2I"), k % 5, F.lit("D"), F.col("o_custkey") % 30 + 1, F.lit("N3H"))
    return V.table(spark, d, "orders").select("o_orderkey", R.cigar_length(cigar).alias("n"))


@query(
    with_views(
        "iv_s",
        """select row_id, cast(case when start >> 14 = ("end" - 1) >> 14 then 4681 + (start >> 14) when start >> 17 = ("end" - 1) >> 17 then 585 + (start >> 17)
  when start >> 20 = ("end" - 1) >> 20 then 73 + (start >> 20) when start >> 23 = ("end" - 1) >> 23 then 9 + (start >> 23)
  when start >> 26 = ("end" - 1) >> 26 then 1 + (start >> 26) else 0 end as integer) as bin from iv_s""",
    )
)
def ucsc_bins(spark, d):
    return V.iv_s(spark, d).select("row_id", ucsc_bin(F.col("start"), F.col("end")).alias("bin"))


# Names ----------------------------------------------------------------------

NAMES = """a as (select cast(o_orderkey as varchar) as name, count(*) as n from orders group by 1),
f as (select cast(l_orderkey as varchar) as name, case when l_returnflag = 'R' then 0 else 1 end as i from lineitem where l_quantity > 10),
b as (select name, count(*) as n, cast(bit_or(1 << i) as bigint) as mask from f group by name),
r as (select coalesce(a.name, b.name) as name, coalesce(a.n, 0) as in_alignment, coalesce(b.n, 0) as in_files, coalesce(mask, 0) as mask from a full join b on a.name = b.name)
"""


def _names(spark, d):
    a = V.table(spark, d, "orders").select(F.concat(F.lit("@"), F.col("o_orderkey"), F.lit("/1 extra")).alias("name"))
    l = V.table(spark, d, "lineitem").where("l_quantity > 10").select(F.concat(F.lit("@"), F.col("l_orderkey"), F.lit("/2")).alias("name"), "l_returnflag")
    return a, [l.where("l_returnflag = 'R'").select("name"), l.where("l_returnflag <> 'R'").select("name")]


@query("with " + NAMES + "select * from r")
def read_name_check(spark, d):
    return N.reconcile(*_names(spark, d))


@query("with " + NAMES + "select count(*) as records, count(distinct name) as unique_names, cast((select count(*) from b where n > 1) as bigint) as repeated_names, cast((select coalesce(sum(n), 0) from b where n > 1) as bigint) as repeated_records from f")
def read_name_statistics(spark, d):
    _, files = _names(spark, d)
    return N.name_statistics(files[0].union(files[1]), "name")


@query("with " + NAMES + "select name, pos from (select r.name, o_orderkey as pos from r join orders on r.name = cast(o_orderkey as varchar) where in_files = 0) order by pos, name limit 10")
def missing_names(spark, d):
    first = V.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("pos"))
    return N.missing_examples(N.reconcile(*_names(spark, d)), first, 10, "in_files").select("name", "pos")


# Genes ----------------------------------------------------------------------


@query(
    with_views(
        "genes",
        """select seqname, start, "end", min_by(strand, row_id) as strand, string_agg(names, ',' order by row_id) as names from (
  select row_id, names, strand, seqname, greatest(case strand when '+' then start - 300 else "end" - 1 - 100 end, 0) as start, greatest(case strand when '+' then start + 101 else "end" + 300 end, 0) as "end" from genes)
group by seqname, start, "end" """,
    )
)
def promoters(spark, d):
    out = G.promoters(V.genes(spark, d), 300, 100)
    return out.select("seqname", "start", "end", "strand", F.array_join("names", ",").alias("names"))


@query(with_views("genes", "select names as name, seqname, min(start) as start, max(\"end\") as \"end\", case when count(distinct strand) > 1 then '*' else min(strand) end as strand, cast(0 as bigint) as score from genes where names <> '' group by names, seqname"))
def gtf_merge_by(spark, d):
    return G.merge_by_attribute(V.genes(spark, d), "names")


@query(
    and_views(
        "genes",
        """s as (select p_name as names, sum(l_quantity) as q from lineitem join part on l_partkey = p_partkey group by p_name),
l as (select names, max(row_id) as last from genes group by names)
select g.row_id, g.names, case when g.row_id = l.last then coalesce(s.q, 0) else 0 end as expr from genes g join l using (names) left join s using (names)""",
    )
)
def gene_expression(spark, d):
    rows = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_name", "l_quantity")
    return G.expression(V.genes(spark, d), rows, "p_name", "l_quantity").select("row_id", "names", "expr")


@query(with_views("genes", "select max_by(row_id, row_id) as row_id, names from genes group by names"))
def gene_lookup(spark, d):
    return G.last_by_name(V.genes(spark, d)).select("row_id", "names")


@query("select 200 as regions, 30 as least_width, 30 as largest_width, 0 as overlapping, 0 as outside")
def random_regions(spark, d):
    """What holds of any draw: how many regions, their widths, none on an avoided one or beyond its sequence."""
    avoid = I.filter_strand(V.iv_s(spark, d), "-")
    drawn = I.draw_regions(V.genome(spark, d), 200, 30, avoid, seed=5)
    width = F.col("end") - F.col("start")
    marks = I.overlap_semi(drawn, avoid).agg(F.count("*").alias("overlapping"))
    whole = drawn.join(V.genome(spark, d), "seqname", "left").agg(
        F.count("*").alias("regions"), F.min(width).alias("least_width"), F.max(width).alias("largest_width"), F.count_if(F.coalesce((F.col("start") < 0) | (F.col("end") > F.col("length")), F.lit(True))).alias("outside")
    )
    return whole.crossJoin(F.broadcast(marks))  # one row
