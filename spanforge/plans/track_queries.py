"""Queries of the track, coverage and rollup operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import rollup as U
from ..operators import segmentation as S
from ..operators import track as T
from . import views as V
from .views import and_views, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}

BIN = 10
#: Hours stand for ten positions each.


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def trk(spark, d, value="sum"):
    return T.Track(V.track_rows(spark, d, value), BIN, V.track_genome(spark))


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Coverage -------------------------------------------------------------------

GRID = "cells as (select g.seqname, b as bin from genome g, unnest(range(length // 50)) t(b))"


def coverage_sql(value: str, where: str = "true") -> str:
    return and_views(
        "iv_s genome",
        GRID
        + f""",
r as (select s.*, unnest(range(start // 50, ("end" - 1) // 50 + 1)) as bin from iv_s s join genome g on s.seqname = g.seqname where start // 50 < length // 50 and {where}),
c as (select seqname, bin, sum({value}) as value from r group by 1, 2)
select seqname, bin, coalesce(value, 0) as value from cells left join c using (seqname, bin)""",
    )


@query(coverage_sql("1.0::double"))
def coverage_simple(spark, d):
    return C.coverage(V.reads(spark, d), V.genome(spark, d), 50)[0].rows


@query(coverage_sql('(least("end", (bin + 1) * 50) - greatest(start, bin * 50))::double'))
def coverage_overlap(spark, d):
    return C.coverage(V.reads(spark, d), V.genome(spark, d), 50, method="overlap")[0].rows


@query(coverage_sql('(least("end", (bin + 1) * 50) - greatest(start, bin * 50)) / 50.0::double').replace("coalesce(value, 0)", "round(coalesce(value, 0), 6)"))
def coverage_mean_overlap(spark, d):
    return rounded(C.coverage(V.reads(spark, d), V.genome(spark, d), 50, method="mean overlap")[0].rows, "value")


@query(
    and_views(
        "iv_s genome",
        GRID
        + """,
e as (select seqname, duplicate, case when not paired_end and strand = '-' then greatest("end" - 60, 0) else start end as start, case when not paired_end and strand = '+' then start + 60 else "end" end as "end" from iv_s where mapq >= 20),
ok as (select e.* from e join genome g on e.seqname = g.seqname where start // 50 < length // 50),
r as (select *, unnest(range(start // 50, ("end" - 1) // 50 + 1)) as bin from ok),
c as (select seqname, bin, sum(case when duplicate then 0.0::double else 1 end) as t, sum(case when duplicate then 1.0::double else 0 end) as c from r group by 1, 2),
n as (select 1e6 / count(*) filter (not duplicate) as kt, 1e6 / count(*) filter (duplicate) as kc from ok)
select seqname, bin, round(ln((coalesce(t, 0) * kt + 1 * kt) / (coalesce(c, 0) * kc + 2 * kc) * (2 * kc) / (1 * kt)), 6) as value from cells left join c using (seqname, bin), n""",
    )
)
def coverage_normalized(spark, d):
    o = C.CoverageOptions(bin_size=50, normalize_track="cpm", filter_mapq=20, log_scale=True, pseudocounts=(1.0, 2.0))
    reads = V.reads(spark, d)
    return rounded(C.coverage_pipeline([reads.where("not duplicate")], V.genome(spark, d), o, [reads.where("duplicate")], [60], [60]).rows, "value")


@query(
    and_views(
        "iv_s genome",
        GRID
        + """,
r as (select s.*, unnest(range(start // 50, ("end" - 1) // 50 + 1)) as bin from iv_s s join genome g on s.seqname = g.seqname where start // 50 < length // 50),
c as (select seqname, bin, sum(1.0::double) as value from r group by 1, 2),
v as (select seqname, bin, coalesce(value, 0) as x, count(*) over (partition by seqname) as n from cells left join c using (seqname, bin)),
p as (select *, sum(x) over (partition by seqname order by bin) as upto from v),
w as (select p.seqname, p.bin, p.n, s, greatest(least(p.bin - s // 2, p.n - s), 0) as a, least(greatest(p.bin - s // 2, 0) + s, p.n) - 1 as z from p, (values (5), (20), (80)) t(s)),
q as (select w.*, hi.upto - coalesce(lo.upto, 0) as total, least(s, w.n) as width from w join p hi on hi.seqname = w.seqname and hi.bin = w.z left join p lo on lo.seqname = w.seqname and lo.bin = w.a - 1),
b as (select seqname, bin, n, coalesce(min_by(total / width, s) filter (total >= 40), max_by(total / width, s)) as value from q group by all)
select seqname, bin, case when bin >= 2 and bin < n - 2 then round(value, 6) end as value from b""",
    )
)
def coverage_smoothed(spark, d):
    return rounded(C.coverage(V.reads(spark, d), V.genome(spark, d), 50)[0].smooth_adaptive([20, 5, 80], 40).rows, "value")


CROSS = """x as (select seqname, bin, coalesce(value, 0) as x, coalesce(n, 0) as y from trk),
s as (select count(*) as k, avg(x) as mx, avg(y) as my, avg(x * x) as xx, avg(y * y) as yy from x),
l as (select unnest(range(0, 20)) as lag)
select cast(l.lag * 10 as bigint) as lag, round(sum((a.x - mx) * (b.y - my)) / any_value(k) / sqrt((any_value(xx) - any_value(mx) ** 2) * (any_value(yy) - any_value(my) ** 2)), 6) as y
from l, s, x a join x b on a.seqname = b.seqname where b.bin = a.bin + l.lag group by l.lag"""


@query(and_views("trk", CROSS))
def crosscorrelation(spark, d):
    return rounded(T.cross_correlation(trk(spark, d), trk(spark, d, "count"), 0, 200), "y")


@query(
    and_views(
        "iv_s genome",
        """g as (select g.seqname, b as bin from genome g, unnest(range(length // 10)) t(b)),
f as (select seqname, start // 10 as bin, count(*) as x from iv_s where strand = '+' group by 1, 2),
r as (select seqname, "end" // 10 as bin, count(*) as y from iv_s where strand = '-' group by 1, 2),
v as (select g.seqname, g.bin, coalesce(x, 0)::double as x, coalesce(y, 0)::double as y from g left join f using (seqname, bin) left join r using (seqname, bin)),
s as (select count(*) as k, avg(x) as mx, avg(y) as my, avg(x * x) as xx, avg(y * y) as yy from v),
len as (select sum("end" - start) // count(*) as n from iv_s),
l as (select unnest(range(0, 20)) as lag),
c as (select l.lag * 10 as lag, sum((a.x - mx) * (b.y - my)) / any_value(k) / sqrt((any_value(xx) - any_value(mx) ** 2) * (any_value(yy) - any_value(my) ** 2)) as y
  from l, s, v a join v b on a.seqname = b.seqname where b.bin = a.bin + l.lag group by l.lag)
select cast(arg_max(lag, y) as bigint) as fragment_length, round(max(y), 6) as y from c, len where lag >= (n + n // 2) // 10 * 10""",
    )
)
def fragment_length(spark, d):
    return rounded(C.fragment_length(V.reads(spark, d), V.genome(spark, d), 200, 10), "y")


# Tracks ---------------------------------------------------------------------


@query(with_views("trk", "select count(value) as valid, min(value) as min, max(value) as max, round(sum(value), 4) as sum, round(sum(value * value), 4) as sum_squares, round(sum(value) / count(value), 4) as mean, round(sum(value * value) / count(value) - (sum(value) / count(value)) ** 2, 4) as variance from trk"))
def track_summary(spark, d):
    return rounded(trk(spark, d).summary(), "sum", "sum_squares", "mean", "variance", digits=4)


@query(with_views("trk", "select seqname, max(value) as value from trk group by seqname"))
def track_reduce(spark, d):
    return trk(spark, d).reduce(F.max("value"))


@query(with_views("trk", "select seqname, round(sum(value * pow(0.5, k)), 6) as value from (select seqname, value, row_number() over (partition by seqname order by bin desc) - 1 as k from trk where value is not null) group by seqname"))
def track_fold(spark, d):
    """Each value counts half as much as the one after it."""
    return rounded(trk(spark, d).fold(lambda a, v: a if v is None or v != v else 0.5 * a + v, 0.0), "value")


@query(with_views("trk", "select seqname, bin, round(ln(value + 1), 6) as value from trk"))
def track_map(spark, d):
    return rounded(trk(spark, d).map(lambda v: F.ln(v + 1)).rows, "value")


@query(with_views("trk", "select seqname, bin, value from trk where seqname = 'u3' and bin >= 12 and bin < 345"))
def track_slice(spark, d):
    return trk(spark, d).slice("u3", 125, 3459)


@query(with_views("trk", "select seqname, bin, value from trk where seqname in ('u1', 'u4')"))
def track_filter_genome(spark, d):
    return trk(spark, d).filter_genome(F.col("seqname").isin("u1", "u4")).rows


@query(with_views("trk", "select seqname, bin, round(avg(value) over (partition by seqname order by bin rows between 3 preceding and 2 following), 6) as value from trk"))
def window_mean(spark, d):
    return rounded(trk(spark, d).window_map(6, F.avg).rows, "value")


@query(with_views("trk", "select seqname, bin, round(max(value) over w - min(n) over w, 6) as value from trk window w as (partition by seqname order by bin rows between 2 preceding and 2 following)"))
def window_multi(spark, d):
    return rounded(T.window_map_list([trk(spark, d), trk(spark, d, "count")], 5, lambda v: v[0](F.max) - v[1](F.min)).rows, "value")


@query(with_views("trk", "select seqname, bin, round(median(value) over (partition by seqname order by bin rows between 2 preceding and 2 following), 6) as value from trk"))
def window_python(spark, d):
    """A median in Python over each window."""
    import statistics

    return rounded(trk(spark, d).window_apply(5, lambda v: statistics.median([x for x in v if x is not None]) if any(x is not None for x in v) else float("nan")).rows, "value")


@query(with_views("trk", "select seqname, bin, round(value / n, 6) as value from trk"))
def map_list(spark, d):
    return rounded(T.map_list([trk(spark, d), trk(spark, d, "count")], lambda v: F.try_divide(v[0], v[1])).rows, "value")


@query(with_views("trk", "select seqname, bin, round(case when seqname = 'u1' then value + bin * 10 else coalesce(n, 0) end, 6) as value from trk"))
def track_udf(spark, d):
    import math

    def plugin(seqname, position, values):
        v = [0.0 if x is None or math.isnan(x) else x for x in values]
        if seqname == "u1":
            return values[0] + position if v[0] else float("nan")
        return v[1]

    return rounded(T.map_udf([trk(spark, d), trk(spark, d, "count")], plugin).rows, "value")


@query(
    and_views(
        "trk",
        """t as (select seqname, bin, n as value from trk),
m as (select *, sum(case when value is null or p is null or value <> p then 1 else 0 end) over (partition by seqname order by bin) as run from (select *, lag(value) over (partition by seqname order by bin) as p from t))
select seqname, min(bin) * 10 as start, (max(bin) + 1) * 10 as "end", '*' as strand, any_value(value) as value from m group by seqname, run""",
    )
)
def track_runs(spark, d):
    return trk(spark, d, "count").runs()


@query(
    and_views(
        "trk",
        """u as (select seqname, bin, value, n, value + n as s from trk where value > 60 and n > 1),
m as (select *, bin - row_number() over (partition by seqname order by bin) as run from u)
select seqname, min(bin) * 10 as start, (max(bin) + 1) * 10 as "end", '*' as strand, arg_max(bin, (s, -bin)) * 10 as summit, round(max(s), 6) as summit_sum from m group by seqname, run""",
    )
)
def joint_positive(spark, d):
    return rounded(T.joint_positive([trk(spark, d), trk(spark, d, "count")], [60.0, 1.0]).drop("values"), "summit_sum")


HISTOGRAM = """r as (select min(value) as lo, (max(value) - min(value)) / 25 as w from trk),
c as (select least(cast(floor((value - lo) / w) as bigint), 24) as i, count(*) as n from trk, r where value is not null group by 1),
h as (select i, lo + i * w as x, coalesce(n, 0) as n from range(25) t(i) left join c using (i), r)
"""


@query(and_views("trk", HISTOGRAM + "select round(x, 6) as x, n as count from h"))
def histogram(spark, d):
    return rounded(trk(spark, d).histogram(25), "x")


@query(and_views("trk", HISTOGRAM + "select round(x, 6) as x, cast(sum(n) over (order by i) as bigint) as count from h"))
def histogram_cumulative(spark, d):
    return rounded(trk(spark, d).histogram(25, cumulative=True), "x")


@query(with_views("trk", "select n as x, count(*) as count from trk where n is not null group by n"))
def histogram_exact(spark, d):
    return trk(spark, d, "count").histogram(0)


@query(with_views("trk", "select value, count(*) as count, cast(sum(count(*)) over (order by value) as bigint) as cumulative from trk where value is not null group by value"))
def distribution(spark, d):
    return trk(spark, d).distribution()


@query(with_views("trk", "select seqname, bin, case when value is not null then round(q, 6) end as value from (select seqname, bin, value, cume_dist() over (partition by value is null order by value) as q from trk)"))
def quantile_transform(spark, d):
    return rounded(trk(spark, d).to_quantiles().rows, "value")


@query(
    and_views(
        "trk",
        """a as (select value as v, sum(count(*)) over (order by value) as f, (select count(value) from trk) as k from trk where value is not null group by value),
b as (select n as v, sum(count(*)) over (order by n) as f, (select count(n) from trk) as k from trk where n is not null group by n),
m as (select a.v, case when a.v = (select min(v) from a) then (select min(v) from b) else (select min(b.v) from b where b.v > (select min(v) from b) and b.f * a.k >= a.f * b.k) end as w from a)
select seqname, bin, coalesce(w, value) as value from trk left join m on m.v = trk.value""",
    )
)
def quantile_normalize(spark, d):
    return trk(spark, d).quantile_normalize(trk(spark, d, "count")).rows


# Rollups --------------------------------------------------------------------

STATS = "count(value) as valid, min(value) as min, max(value) as max, round(sum(value), 4) as sum, round(sum(value * value), 4) as sum_squares"


def _rollups(spark, d):
    return U.Rollups.build(trk(spark, d), [40, 120, 480])


@query(with_views("trk", f"select seqname, bin // 24 * 240 as start, bin // 24 * 240 + 240 as \"end\", {STATS} from trk where value is not null and regexp_full_match(seqname, 'u[1-5]') and bin * 10 >= 480 and bin * 10 + 10 <= 5040 group by 1, 2"))
def rollup_query(spark, d):
    return rounded(_rollups(spark, d).query("u[1-5]", 500, 5000, 240), "sum", "sum_squares", digits=4)


@query(with_views("trk", f"select seqname, bin // 7 * 70 as start, bin // 7 * 70 + 70 as \"end\", {STATS} from trk where value is not null and seqname = 'u2' and bin * 10 >= 490 and bin * 10 + 10 <= 5040 group by 1, 2"))
def rollup_query_raw(spark, d):
    return rounded(_rollups(spark, d).query("u2", 500, 5000, 70), "sum", "sum_squares", digits=4)


@query(with_views("trk", "select c.i as nth, coalesce(round(v, 6), -1) as value from range(56) c(i) left join (select (bin * 10 - 240) // 120 as i, avg(value) as v from trk where value is not null and seqname = 'u3' and bin >= 24 and bin * 10 + 10 <= 6960 group by 1) using (i)"))
def slice_query(spark, d):
    return rounded(_rollups(spark, d).slice("u3", 240, 6960, "mean", 120, 0, -1.0), "value")


@query(
    and_views(
        "trk",
        """h as (select (bin * 10 - 240) // 120 as i, count(value) as k, sum(value) as s, max(value) as m from trk where value is not null and seqname = 'u3' and bin >= 24 and bin * 10 + 10 <= 6960 group by 1),
c as (select c.i, k, s, m from range(56) c(i) left join h using (i))
select i as nth, round(sum(s) over w / sum(k) over w, 6) as value from c window w as (order by i rows between 1 preceding and 1 following)""",
    )
)
def slice_overlap(spark, d):
    return rounded(_rollups(spark, d).slice("u3", 240, 6960, "mean", 120, 1), "value")


SUMMARY_SQL = {
    "mean": "avg(value)", "max": "max(value)", "min": "min(value)", "discrete mean": "floor(avg(value)) + 0.5", "discrete max": "floor(max(value))", "discrete min": "floor(min(value))",
    "variance": "sum(value * value) / count(value) - (sum(value) / count(value)) ** 2",
}


@query(with_views("trk", "select seqname, bin // 12 as bin, " + ", ".join(f"round({s} + 1.23e-7, 6) as {n.replace(' ', '_')}" for n, s in SUMMARY_SQL.items()) + " from trk where value is not null group by 1, 2"))
def bin_summaries(spark, d):
    s = U.statistics(trk(spark, d).rows, ["seqname", F.floor(F.col("bin") / 12).cast("long").alias("bin")])
    return s.select("seqname", "bin", *[F.round(U.summary(n) + 1.23e-7, 6).alias(n.replace(" ", "_")) for n in SUMMARY_SQL])  # off the places where decimals tie


COVERAGE = GRID + """,
r as (select s.*, unnest(range(start // 50, ("end" - 1) // 50 + 1)) as bin from iv_s s join genome g on s.seqname = g.seqname where start // 50 < length // 50),
c as (select seqname, bin, sum(1.0::double) as value from r group by 1, 2),
cov as (select seqname, bin, coalesce(value, 0) as value from cells left join c using (seqname, bin)),
"""


def _cover(spark, d):
    return C.coverage(V.reads(spark, d), V.genome(spark, d), 50)[0]


def _wide(spark, d):
    return V.iv_q(spark, d).withColumn("end", F.col("start") + 330 + F.col("row_id") % 70)


WIDE = """wide as (select row_id, seqname, start, start + 330 + row_id % 70 as "end", strand from iv_q),
cut as (select w.row_id, w.seqname, w.start, w."end", unnest(range((w.start + 49) // 50, w."end" // 50)) as bin from wide w),
"""


@query(and_views("iv_s iv_q genome", COVERAGE + WIDE + """h as (select row_id, (bin * 50 - start) // 100 as nth, max(value) as v from cut join cov using (seqname, bin) group by 1, 2),
n as (select row_id, unnest(range(("end" - start) // 100)) as nth from wide)
select n.row_id, n.nth, v as value from n left join h using (row_id, nth)"""))
def extract_regions(spark, d):
    return U.extract_regions(_wide(spark, d), _cover(spark, d), "max", 100)


@query(and_views("iv_s iv_q genome", COVERAGE + WIDE + "h as (select row_id, avg(value) as v from cut join cov using (seqname, bin) group by 1) select row_id, round(v, 6) as score from wide left join h using (row_id)"))
def region_scores(spark, d):
    return rounded(U.region_score(_wide(spark, d), _cover(spark, d)), "score")


@query(and_views("iv_s iv_q genome", COVERAGE + WIDE + """h as (select row_id, (bin * 50 - start) // 50 as nth, avg(value) as v from cut join cov using (seqname, bin) group by 1, 2),
p as (select w.seqname, (w.start + nth * 50) // 50 as bin, arg_max(v, row_id) as value from h join wide w using (row_id) where nth < ("end" - start) // 50 group by 1, 2)
select seqname, bin, value from cells left join p using (seqname, bin)"""))
def region_track(spark, d):
    return U.region_track(_wide(spark, d), _cover(spark, d)).rows


@query(
    and_views(
        "iv_s genome",
        COVERAGE
        + """sets as (select seqname, start, "end", cast(row_id % 3 as integer) as k from iv_s where row_id % 3 >= 0),
e as (select seqname, start, "end", max("end") over (partition by seqname order by start, "end" rows between unbounded preceding and 1 preceding) as upto from sets),
m as (select *, sum(case when upto is null or start >= upto then 1 else 0 end) over (partition by seqname order by start, "end" rows unbounded preceding) as island from e),
reg as (select seqname, min(start) as start, max("end") as "end" from m group by seqname, island),
lab as (select reg.seqname, reg.start, reg."end", list_sort(list(distinct k)) as labels from reg join sets s on reg.seqname = s.seqname and s.start < reg."end" and reg.start < s."end" group by all),
sc as (select lab.seqname, lab.start, t.k, max(value * (t.k + 1)) as s from lab cross join (values (0), (1), (2)) t(k) left join (select *, bin * 50 as at from cov) c on c.seqname = lab.seqname and c.at >= lab.start and c.at + 50 <= lab."end" group by all),
f as (select l.seqname, l.start, any_value(labels) as labels, any_value("end") as "end", sum(case when list_contains(labels, k) then coalesce(s, 0) else 0 end) as p, sum(case when list_contains(labels, k) then 0 else coalesce(s, 0) end) as n, len(any_value(labels)) as np from lab l join sc using (seqname, start) group by l.seqname, l.start)
select seqname, start, "end", array_to_string(labels, ',') as labels, round(case when np < 3 then ln((p + 1) / np) - ln((n + 1) / (3 - np)) end, 6) as score from f""",
    )
)
def differential_score(spark, d):
    s = V.iv_s(spark, d)
    sets = [s.where(F.col("row_id") % 3 == i) for i in range(3)]
    tracks = [_cover(spark, d).map(lambda v, i=i: v * (i + 1)) for i in range(3)]
    out = S.differential(sets, tracks)
    return rounded(out.select("seqname", "start", "end", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), "score"), "score")


@query(
    and_views(
        "iv_q genome",
        """s as (select *, 's' || (row_id % 7) as name from iv_q),
st as (select name, row_number() over (order by min(row_id)) as state from s where name <> 's0' group by name union all select 's0', 0),
g as (select g.seqname, b as bin from genome g, unnest(range(length // 10)) t(b)),
c as (select seqname, p // 10 as bin, arg_max(state, row_id) as state from (select s.seqname, s.row_id, state, unnest(range(start, "end", 10)) as p from s join st using (name)) group by 1, 2)
select g.seqname, g.bin, cast(coalesce(state, 0) as double) as value from g left join c using (seqname, bin)""",
    )
)
def segmentation_track(spark, d):
    segments = V.iv_q(spark, d).withColumn("name", F.concat(F.lit("s"), F.col("row_id") % 7))
    return S.states_to_track(segments, V.genome(spark, d), 10, "s0")[0].rows


_COLOURS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(S.palette(7)))


@query(
    and_views(
        "iv_q genome",
        f"""seg as (select *, 's' || (row_id % 7) as name from iv_q),
states as (select name, row_number() over (order by min(row_id)) as state from seg where name <> 's0' group by name union all select 's0', 0),
cells as (select seqname, cast(floor(p / 10) as bigint) as bin, max_by(state, row_id) as state from (select seqname, row_id, name, unnest(range(start, "end", 10)) as p from seg) join states using (name) group by 1, 2),
bins as (select seqname, bin, coalesce(state, 0) as state from (select seqname, unnest(range(length // 10)) as bin from genome) left join cells using (seqname, bin)),
runs as (select *, bin - row_number() over (partition by seqname, state order by bin) as run from bins),
colours(k, colour) as (values {_COLOURS})
select seqname, min(bin) * 10 as start, max(bin) * 10 + 10 as "end", case when state = 0 then 'none' else cast(state as varchar) end as name, cast(100 * state as bigint) as score, '.' as strand,
  min(bin) * 10 as "thickStart", max(bin) * 10 + 10 as "thickEnd", colour as "itemRgb" from runs join colours on k = state group by seqname, state, run, colour""",
    )
)
def segmentation_rows(spark, d):
    segments = V.iv_q(spark, d).withColumn("name", F.concat(F.lit("s"), F.col("row_id") % 7))
    track, _ = S.states_to_track(segments, V.genome(spark, d), 10, "s0")
    return S.track_to_segments(track, {0: "none"}, dict(enumerate(S.palette(7))), track)


@query(
    "with recursive "
    + with_views(
        "trk",
        """,
r as (select seqname, bin * 10 as a, bin * 10 + 10 as z, value as v from trk where value is not null),
w as (select seqname, min(a) as s from r group by seqname union all select w.seqname, (select min(a) from r where r.seqname = w.seqname and r.a >= w.s + 70) as s from w where w.s is not null),
g as (select w.seqname, w.s, r.a, r.z, r.v, r.a - lag(r.z) over (partition by w.seqname, w.s order by r.a) as gap from w join r on r.seqname = w.seqname and r.a >= w.s and r.a < w.s + 70)
select seqname, s as start, max(z) as "end", cast(count(*) + coalesce(sum(gap), 0) as double) as valid, min(case when gap > 0 then least(v, 0) else v end) as min, max(case when gap > 0 then greatest(v, 0) else v end) as max,
  round(sum(v), 6) as sum, round(sum(v * v), 4) as sum_squares from g group by seqname, s""",
    ).removeprefix("with ").replace("\n,\n", ",\n")
)
def packed_records(spark, d):
    rows = trk(spark, d).rows.where("value is not null").select("seqname", (F.col("bin") * 10).alias("start"), (F.col("bin") * 10 + 10).alias("end"), "value")
    return U.adjacent_records(rows, 70).withColumns({"sum": F.round("sum", 6), "sum_squares": F.round("sum_squares", 4)})


