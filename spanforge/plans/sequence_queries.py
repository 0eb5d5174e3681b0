"""Queries of the sequence, k-mer and motif operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import kmers as K
from ..operators import motifs as M
from ..operators import sequences as Q
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


@query("select doc_id, translate(reverse(regexp_replace(translate(text, 'acgtmrsvwyhkdbn', 'ACGTMRSVWYHKDBN'), '[^ACGTMRSVWYHKDBN=]', 'N', 'g')), 'ACGTMRSVWYHKDBN=', 'TGCAKYSBWRDMHVN=') as sequence from documents")
def revcomp(spark, d):
    return V.table(spark, d, "documents").select("doc_id", scalar.reverse_complement(F.col("text")).alias("sequence"))


@query(with_views("dna", "select name as seqname, cast(i - 1 as bigint) as start, cast(i + 3 as bigint) as \"end\", '*' as strand from dna, unnest(range(1, length(sequence) - 2)) t(i) where substr(sequence, i, 4) = 'tata'"))
def motif_scan(spark, d):
    return Q.motif_scan(V.dna(spark, d), "TaTa")


@query(
    and_views(
        "dna",
        """n as (select name, length(sequence) as n, len(regexp_extract_all(sequence, 'cg')) as cg, len(regexp_extract_all(sequence, 'c')) as c, len(regexp_extract_all(sequence, 'g')) as g from dna)
select name, round(case when cg = 0 then 0 else cg * n / (c * g)::double end, 6) as observed_over_expected from n""",
    )
)
def cpg_oe(spark, d):
    return Q.cpg(V.dna(spark, d)).withColumn("observed_over_expected", F.round("observed_over_expected", 6))


@query(
    """with t as (select 'd' || doc_id as seqname, text, regexp_extract_all(text, '[nN]+') as m, regexp_split_to_array(text, '[nN]+') as g from documents),
e as (select seqname, i, length(m[i]) as n, sum(length(g[i]) + length(m[i])) over (partition by seqname order by i) as e from t, unnest(range(1, len(m) + 1)) u(i))
select seqname, cast(e - n as bigint) as start, cast(e as bigint) as "end", '*' as strand from e where n > 0"""
)
def unresolved_runs(spark, d):
    texts = V.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("name"), F.col("text").alias("sequence"))
    return Q.unresolved(texts)


@query(with_views("dna", "select ord, name as seqname, length(sequence) // 3 as start, length(sequence) // 3 + length(sequence) // 2 as \"end\", substr(sequence, length(sequence) // 3 + 1, length(sequence) // 2) as sequence from dna"))
def extract_sequence(spark, d):
    s = V.dna(spark, d)
    n = F.length("sequence")
    regions = s.select("ord", F.col("name").alias("seqname"), F.floor(n / 3).alias("start"), (F.floor(n / 3) + F.floor(n / 2)).alias("end"))
    return Q.extract(s.drop("ord"), regions)


KMERS = "w as (select name, {k} as k, substr(sequence, i, {k}) as s from dna, unnest(range(1, length(sequence) - {k} + 2)) t(i)), c as (select name, k, least(s, translate(reverse(s), 'acgt', 'tgca')) as kmer from w)\n"


@query(and_views("dna", KMERS.format(k=6) + "select name, k, kmer, count(*) as count from c group by all"))
def kmer_count(spark, d):
    return K.count_kmers(V.dna(spark, d), K.Relation(6, 6))


@query(and_views("dna", KMERS.format(k=3) + "select name, k, kmer, cast(1 as bigint) as count from c group by all"))
def kmer_presence(spark, d):
    return K.count_kmers(V.dna(spark, d), K.Relation(3, 3), binary=True)


@query(
    and_views(
        "dna",
        """w as (select name, k, substr(sequence, i, k) as s from dna, (values (2), (3)) v(k), unnest(range(1, length(sequence) - k + 2)) t(i)),
m as (select name, k, s, translate(s, 'acgt', 'tgca') as c from w),
x as (select name, k, least(s, c, reverse(s), reverse(c)) as kmer from m)
select name, k, kmer, kmer || '|' || translate(kmer, 'acgt', 'tgca') || '|' || reverse(kmer) || '|' || translate(reverse(kmer), 'acgt', 'tgca') as label, count(*) as count from x group by all""",
    )
)
def kmer_classes(spark, d):
    r = K.Relation(2, 3, complement=True, reverse=True, revcomp=True)
    return K.count_kmers(V.dna(spark, d), r).withColumn("label", K.class_label(F.col("kmer"), r))


@query(
    and_views(
        "dna",
        KMERS.format(k=3)
        + """, n as (select name, k, kmer, count(*) as count from c group by all)
select a.name, 3 as k, b.kmer, coalesce(n.count, 0) as count from dna a cross join (select distinct kmer from n) b left join n on n.name = a.name and n.kmer = b.kmer""",
    )
)
def kmer_dense(spark, d):
    s = V.dna(spark, d)
    return K.dense_counts(K.count_kmers(s, K.Relation(3, 3)), s)


REFERENCE = "acgtttgacatgacctagga"


@query(
    and_views(
        "dna",
        f"""rw as (select substr('{REFERENCE}', i, 3) as s from unnest(range(1, {len(REFERENCE)} - 1)) t(i)),
r as (select least(s, translate(reverse(s), 'acgt', 'tgca')) as kmer, count(*) as x from rw group by 1),
w as (select name, st as start, substr(sequence, st + 1, {len(REFERENCE)}) as t from dna, unnest(range(0, length(sequence) - {len(REFERENCE)} - 1, 2)) u(st) where length(sequence) - {len(REFERENCE)} >= 2),
c as (select name, start, least(substr(t, i, 3), translate(reverse(substr(t, i, 3)), 'acgt', 'tgca')) as kmer, count(*) as y from w, unnest(range(1, {len(REFERENCE)} - 1)) v(i) group by all)
select name, cast(start as integer) as start, round(sum(coalesce(x, 0) * y) / sqrt((select sum(x * x) from r)) / sqrt(sum(y * y)), 6) as similarity from c left join r using (kmer) group by name, start""",
    )
)
def kmer_similarity(spark, d):
    return K.similarities(V.dna(spark, d), REFERENCE, K.Relation(3, 3)).withColumn("similarity", F.round("similarity", 6))


@query(
    and_views(
        "dna",
        """w as (select name, substr(sequence, i, 3) as s from dna, unnest(range(1, length(sequence) - 1)) t(i)),
v as (select name, unnest([s, substr(s, 1, 1) || 'n' || substr(s, 3, 1)]) as s from w),
c as (select name, s, translate(reverse(s), 'acgtn', 'tgcan') as r from v)
select name, 3 as k, case when translate(s, 'acgtn', '01234') <= translate(r, 'acgtn', '01234') then s else r end as kmer, count(*) as count from c group by all""",
    )
)
def kmer_ambiguous(spark, d):
    return K.count_kmers(V.dna(spark, d), K.Relation(3, 3, alphabet="gapped"))


@query(
    and_views(
        "dna",
        """w as (select name, substr(sequence, i, 3) as s from dna, unnest(range(1, length(sequence) - 1)) t(i)),
g as (select unnest(['aca', 'acc', 'acg', 'act']) as s, 'acn' as p union all select 'gat', 'atc'),
h as (select s, p from g union select translate(reverse(s), 'acgt', 'tgca'), p from g)
select name, 3 as k, p as kmer, count(*) as count from w join h using (s) group by all""",
    )
)
def kmer_given(spark, d):
    return K.count_given(V.dna(spark, d), K.Relation(3, 3, alphabet="gapped"), ["acn", "gat"])


@query()
def kmer_graph(spark, d):
    nodes, edges = K.graph(spark, ["at", "tc", "gctc", "gcta", "annnc", "atnnc", "anntc", "anctc", "angtc", "agctc", "aagntc", "aagctc", "agctca"], K.Relation(2, 6, alphabet="gapped"))
    return edges.join(nodes.select(F.col("kmer").alias("upper"), "cluster"), "upper")


MATRIX = M.Matrix({"a": [-0.5, 1.25, -1.0, 0.25], "c": [1.5, -0.75, 0.5, -0.25], "g": [-1.25, -0.5, 1.75, -1.5], "t": [0.25, -1.0, -0.5, 1.0]})
WEIGHTS = "m(j, b, f, r) as (values " + ", ".join(f"({j}, '{b}', {f!r}::double, {r!r}::double)" for j, b, f, r in MATRIX.rows()) + ")"
SCORES = WEIGHTS + f""",
s as (select name, i - 1 as place, sum(f) as f, sum(r) as r from dna, unnest(range(1, length(sequence) - {len(MATRIX)} + 2)) t(i), m where substr(sequence, i + j - 1, 1) = b group by all)
"""


@query(and_views("dna", SCORES + "select dna.name, max(f) as forward, max(r) as reverse, greatest(max(f), max(r)) as best from dna left join s using (name) group by dna.name"))
def pwm_max(spark, d):
    return M.max_scores(V.dna(spark, d), MATRIX)


@query(and_views("dna", SCORES + "select dna.name, round(ln(sum(exp(f))) - ln(count(f)), 6) as forward, round(ln(sum(exp(r))) - ln(count(r)), 6) as reverse, round(ln(sum(exp(f)) + sum(exp(r))) - ln(2 * count(f)), 6) as both from dna join s using (name) group by dna.name union all select name, null, null, null from dna where length(sequence) < 4"))
def pwm_mean(spark, d):
    out = M.mean_scores(V.dna(spark, d), MATRIX)
    return out.select("name", *[F.round(c, 6).alias(c) for c in ("forward", "reverse", "both")])


@query(and_views("dna", SCORES + "select name as seqname, place // 25 as bin, round((sum(f) + sum(r)) / (2 * count(*)), 6) as value from s group by 1, 2"))
def pwm_binned(spark, d):
    return M.binned_scores(V.dna(spark, d), MATRIX, 25, "mean").withColumn("value", F.round("value", 6))


@query(
    and_views("dna", "cut as (select name || ':5:20' as name, substr(sequence, 6, 15) as sequence from dna where length(sequence) > 20),\n" + SCORES.replace("from dna,", "from cut,")
    + "select cut.name, max(f) as forward, max(r) as reverse, greatest(max(f), max(r)) as best from cut left join s using (name) group by cut.name")
)
def pwm_regions(spark, d):
    """The best score of each region, extracted from its sequence."""
    s = V.dna(spark, d)
    regions = s.where(F.length("sequence") > 20).select(F.col("name").alias("seqname"), F.lit(5).cast("long").alias("start"), F.lit(20).cast("long").alias("end"))
    cut = Q.extract(s, regions).select(F.concat_ws(":", "seqname", "start", "end").alias("name"), "sequence")
    return M.max_scores(cut, MATRIX)
