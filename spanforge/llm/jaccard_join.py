"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles
is at least ``similarity``. Equal sets are one class from the start. If two
sets x and y link, they share at least o(x) = ceil(similarity * |x|) shingles,
so for every l the first |x| - o(x) + l shingles of x, in any order that all
documents keep, hold at least l of the shared ones, and so do y's.

1. Shingles are ordered by hash. Each class gives its prefix for l about one
   twentieth of its size, and stays only if l of these are in another's prefix.
2. Of the classes that stay whole sets are counted. Shingles that one class has
   alone are dropped, and classes that keep less than o(x); the rest are ordered
   by frequency. Each class picks the l, and by it the length of its prefix, with
   the least estimated cost of candidates; a pair needs min(l(x), l(y)) matches.
3. Every prefix shingle has a leader, and in some turns classes are verified
   against leaders that they meet most. A group of near copies becomes one
   component with work in proportion to its size.
4. Between components every pair with enough matches, at places that leave enough
   shingles to be shared, is verified, in blocks of bounded size,
   until a link is found. Within a component nothing is left to do.

Documents without words have no shingles and are linked with nothing; fewer
words than a shingle are one shingle. Null and empty texts are such documents.
Repeated rows are equal documents with one component. Rows without a doc_id keep
their components but name none. An empty table gives none, and other columns are
not read. Classes and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import release, remove, temporary, write_table
from .common import map_rows, row_key
from .shingles import shingle_sets

SHINGLE = 5
SIMILARITY = (75, 100)
LEADERS = 4
TURNS = 3
BLOCK = 256
#: Cost of verifying a candidate against that of meeting it, for the choice of l.
VERIFY_COST = 8


def least_shared(n: int) -> int:
    """Shingles that a set of ``n`` shares at least with any that links to it."""
    return -(-SIMILARITY[0] * n // SIMILARITY[1])


def matches_asked(n: int) -> int:
    return 1 + n // 20


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row), n (distinct shingles), cls, and the prefix of each class's first document in a task."""

    def make():
        seen: set[int] = set()

        def each(cols):
            out = {"doc_id": cols[0], "key": cols[2], "n": [], "cls": [], "prefix": []}
            for tokens in shingle_sets(cols[1], SHINGLE):
                n, cls = len(tokens), class_of(tokens)
                out["n"].append(n)
                out["cls"].append(cls)
                if n and cls not in seen:
                    # a partner may be larger by 1 / similarity and ask for as many matches more
                    out["prefix"].append(tokens[: n - least_shared(n) + matches_asked(n * SIMILARITY[1] // SIMILARITY[0])].view(np.int64))
                    seen.add(cls)
                else:
                    out["prefix"].append(None)
            return out

        return each

    return map_rows(docs.select("doc_id", "text", row_key().alias("key")), make, StructType.fromDDL("doc_id long, key long, n long, cls long, prefix array<long>"))


def staying(sketched: DataFrame) -> DataFrame:
    """cls and rep (its least row key) of the classes that stay after step 1."""
    classes = sketched.where("n > 0").groupBy("cls").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.count("prefix").alias("given"))
    o = F.ceil(F.col("n") * SIMILARITY[0] / SIMILARITY[1])
    asked = F.expr("n div 20 + 1")
    postings = sketched.where("prefix is not null").select("cls", F.explode(F.slice("prefix", 1, (F.col("n") - o + asked).cast("int"))).alias("token"))
    whole = sketched.where("prefix is not null").select("cls", F.explode("prefix").alias("token"))
    shared = whole.groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("token")
    shared, _ = write_table(shared, "shared-tokens")  # read anew, so that a join on a frequent token can be split
    met = postings.join(shared, "token").groupBy("cls").agg(F.count("*").alias("met"))
    return met.join(classes, "cls").where(F.expr("met >= given * (n div 20 + 1)")).select("cls", "rep")


def whole_sets(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """cls, n and tokens of the classes that stay, from the texts of their representatives."""

    def make():
        def each(cols):
            out = {"cls": [], "n": [], "tokens": []}
            for cls, tokens in zip(cols[0], shingle_sets(cols[1], SHINGLE), strict=True):
                if class_of(tokens) == cls:  # another row may have the same key
                    out["cls"].append(cls)
                    out["n"].append(len(tokens))
                    out["tokens"].append(tokens.view(np.int64))
            return out

        return each

    # what stays grows with the input, so it is never broadcast
    texts = docs.select(row_key().alias("rep"), "text").join(stay.hint("merge"), "rep").select("cls", "text")
    return map_rows(texts, make, StructType.fromDDL("cls long, n long, tokens array<long>")).dropDuplicates(["cls"])


def reduced(sets: DataFrame) -> DataFrame:
    """cls, n, tokens without those that one class has alone, and their counts, the rarest first, of the classes that can still link."""
    postings = sets.select("cls", "n", F.explode("tokens").alias("token"))
    counts = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    counts, _ = write_table(counts, "token-counts")
    own = postings.join(counts, "token").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    return own.where(F.size("t") >= F.ceil(F.col("n") * SIMILARITY[0] / SIMILARITY[1])).select("cls", "n", F.col("t.token").alias("tokens"), F.col("t.df").alias("dfs"))


def with_prefixes(sets: DataFrame) -> DataFrame:
    """Adds ``asked`` (l) and ``prefix`` to the reduced sets, l by the least estimated cost.

    Meeting a prefix costs the classes that share its tokens, and more matches
    leave fewer of them to verify.
    """
    o = f"cast(ceil(n * {SIMILARITY[0]} / {SIMILARITY[1]}) as int)"
    ways = []
    for asked in (1, 2, 4, 8, 16):
        take = f"greatest(size(tokens) - {o} + {asked}, 0)"
        scan = f"aggregate(slice(dfs, 1, {take}), 0L, (a, d) -> a + d - 1)"
        ways.append(f"if({asked} <= least({o}, n div 20 + 1), named_struct('cost', {scan} * {1 + VERIFY_COST / asked**2}D, 'asked', {asked}), null)")
    best = sets.withColumn("best", F.expr(f"array_min(array_compact(array({', '.join(ways)})))"))
    prefix = F.expr(f"slice(tokens, 1, size(tokens) - {o} + best.asked)")
    return best.select("cls", "n", F.col("best.asked").alias("asked"), prefix.alias("prefix"), "tokens", F.size("tokens").alias("r"))


def _blocks(count: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK), F.lit(1)).cast("int")


def verified(sets: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """For each class on the ``right`` of a ``job`` its first link (a, b) with each block on the ``left``.

    Both have job and cls. A job's sides are cut into blocks of about BLOCK
    classes, and each pair of blocks is a task of its own.
    """
    jobs = left.groupBy("job").agg(_blocks(F.count("*")).alias("ls")).join(right.groupBy("job").agg(_blocks(F.count("*")).alias("rs")), "job")
    own = sets.select("cls", "n", "tokens")
    dealt = lambda side, n, other: (
        side.join(jobs, "job").withColumn("own", F.pmod(F.xxhash64("cls"), n)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).join(own, "cls")
    )
    lefts = dealt(left, "ls", "rs").select("job", F.col("own").cast("int").alias("l"), F.col("other").alias("r"), "cls", "n", "tokens")
    rights = dealt(right, "rs", "ls").select(F.col("job").alias("of_job"), F.col("other").alias("of_l"), F.col("own").cast("int").alias("of_r"), F.col("cls").alias("of_cls"), F.col("n").alias("of_n"), F.col("tokens").alias("of_tokens"))

    def pairs(lf, rf):
        import pandas as pd

        out = []
        if len(lf) and len(rf):
            lists = [np.asarray(t, np.int64) for t in lf["tokens"]]
            token = np.concatenate(lists)
            owner = np.repeat(np.arange(len(lf)), [len(t) for t in lists])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            ln, lc = lf["n"].to_numpy(), lf["cls"].to_numpy()
            for cls, n, tokens in zip(rf["of_cls"].tolist(), rf["of_n"].tolist(), rf["of_tokens"], strict=True):
                t = np.asarray(tokens, np.int64)
                a, b = np.searchsorted(token, t, "left"), np.searchsorted(token, t, "right")
                k = b - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
                shared = np.bincount(owner[at], minlength=len(lf))
                linked = np.flatnonzero((SIMILARITY[1] * shared >= SIMILARITY[0] * (ln + n - shared)) & (lc != cls))
                out += [(int(lc[i]), cls) for i in linked[:1]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return lefts.groupBy("job", "l", "r").cogroup(rights.groupBy("of_job", "of_l", "of_r")).applyInPandas(pairs, "a long, b long")


def aligned(x: str, y: str) -> Column:
    """Whether two sets that share a token at these places can share enough.

    ``p`` is the most tokens before it and ``q`` the most after it, and the
    shared ones are on the same side in both.
    """
    return F.expr(f"{SIMILARITY[0]} * ({x}n + {y}n) <= {sum(SIMILARITY)} * (least({x}p, {y}p) + 1 + least({x}q, {y}q))")


def placed_prefixes(sets: DataFrame, *columns: str) -> DataFrame:
    """A row for each prefix token, with the tokens before (p) and after it (q) in the reduced set."""
    return sets.select(*columns, "n", "r", F.posexplode("prefix").alias("p", "token")).withColumn("q", F.col("r") - 1 - F.col("p"))


def led(sets: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Candidates (cls, leader) in different components: each class with the leaders that it meets most.

    In the first turn those with the fewest tokens of their own lead, which are
    nearest to what a group was copied from; later ones are drawn.
    """
    own = sets.join(labels, "cls")
    postings = placed_prefixes(own, "cls", "component")
    drawn = F.xxhash64("cls", F.pmod(F.xxhash64("token", F.lit(turn)), F.lit(LEADERS)), F.lit(turn))
    rank = F.struct((F.col("n") - F.col("r")) / F.col("n"), "cls") if turn == 0 else F.struct(drawn, "cls")
    tops = postings.groupBy("token").agg(F.min_by(F.struct("cls", "component", "n", "p", "q"), rank).alias("top"), F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    leaders = tops.select("token", F.col("top.cls").alias("leader"), F.col("top.component").alias("of"), F.col("top.n").alias("ln"), F.col("top.p").alias("lp"), F.col("top.q").alias("lq"))
    mine = postings.withColumnsRenamed({c: f"m{c}" for c in "npq"})
    met = mine.join(leaders, "token").where((F.col("component") != F.col("of")) & aligned("m", "l")).groupBy("cls", "leader").agg(F.count("*").alias("met"))
    best = Window.partitionBy("cls").orderBy(F.desc("met"), F.xxhash64("leader"))
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= (1 if turn == 0 else LEADERS)).select("cls", "leader")


def linked_leaders(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (a, b) that link."""
    own = sets.select("cls", "n", "tokens")
    lead = own.select(F.col("cls").alias("leader"), F.col("n").alias("ln"), F.col("tokens").alias("lt"))
    both = candidates.join(own, "cls").join(lead, "leader").withColumn("shared", F.size(F.array_intersect("tokens", "lt")))
    return both.where(F.expr(f"{SIMILARITY[1]} * shared >= {SIMILARITY[0]} * (n + ln - shared)")).select(F.col("cls").alias("a"), F.col("leader").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """cls and component (its least cls) of every class in ``links`` (a, b)."""
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges, edge_path = write_table(both, "links")
    labels, path = write_table(edges.groupBy(F.col("a").alias("cls")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("cls").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["cls"] == near["a"]).select("cls", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        up = labels.select(F.col("cls").alias("to"), F.col("component").alias("above"))
        jumped = step.join(up, "to").select("cls", F.least("to", "above").alias("component"), "was")
        new, new_path = write_table(jumped, "labels")
        changed = new.where("component <> was").limit(1).count()
        remove(spark, path)
        labels, path = new.select("cls", "component"), new_path
        if not changed:
            remove(spark, edge_path)
            return labels


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (cls, component) with the components that ``links`` (a, b) join made one."""
    of = lambda c: labels.select(F.col("cls").alias(c), F.col("component").alias(f"{c}_of"))
    joined = links.join(of("a"), "a").join(of("b"), "b").where("a_of <> b_of").select(F.col("a_of").alias("a"), F.col("b_of").alias("b"))
    up = components(joined).select(F.col("cls").alias("component"), F.col("component").alias("above"))
    new, _ = write_table(labels.join(up, "component", "left").select("cls", F.coalesce("above", "component").alias("component")), "contracted")
    return new


def between(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (job, small) of components that still may link, the larger one the job."""
    own = sets.join(labels, "cls")
    sizes = own.groupBy("component").agg(F.count("*").alias("size"), F.min("asked").alias("asked"))
    postings = placed_prefixes(own, "component").groupBy("component", "token").agg(F.min("n").alias("n"), F.max("p").alias("p"), F.max("q").alias("q"))
    open_tokens = postings.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    some = postings.join(open_tokens, "token")
    x, y = (some.select("token", F.col("component").alias(c), *[F.col(v).alias(f"{c}{v}") for v in "npq"]) for c in "xy")
    pairs = x.join(y, "token").where((F.col("x") < F.col("y")) & aligned("x", "y")).groupBy("x", "y").agg(F.count("*").alias("met"))
    sx = sizes.select(F.col("component").alias("x"), F.col("size").alias("nx"), F.col("asked").alias("ax"))
    sy = sizes.select(F.col("component").alias("y"), F.col("size").alias("ny"), F.col("asked").alias("ay"))
    enough = pairs.join(sx, "x").join(sy, "y").where("met >= least(ax, ay)")
    return enough.select(F.expr("if(nx >= ny, x, y)").alias("job"), F.expr("if(nx >= ny, y, x)").alias("small"))


def link_classes(docs: DataFrame, sketched: DataFrame, sketch_path: str) -> DataFrame:
    """cls and component of every class that may link with another; the sketch is deleted when it is read."""
    spark = docs.sparkSession
    with temporary(spark):
        stay, _ = write_table(staying(sketched), "staying", keep=True)
    remove(spark, sketch_path)  # the prefixes are the larger part of it
    release(spark)
    full, full_path = write_table(whole_sets(docs, stay), "sets")
    with temporary(spark):
        kept, kept_path = write_table(reduced(full), "reduced", keep=True)
    remove(spark, full_path)
    release(spark)
    sets, _ = write_table(with_prefixes(kept), "prefixes")
    remove(spark, kept_path)

    labels = sets.select("cls", F.col("cls").alias("component"))
    for turn in range(TURNS):
        candidates, _ = write_table(led(sets, labels, turn), "candidates")
        found, _ = write_table(linked_leaders(sets, candidates), "links")
        labels = contracted(labels, found)
        release(spark)
    pairs, _ = write_table(between(sets, labels), "pairs")
    release(spark)
    # a job's members, and as its queries the classes of the smaller ones
    larger = pairs.select("job").distinct().join(labels.withColumnRenamed("component", "job"), "job").select("job", "cls")
    smaller = pairs.join(labels.withColumnRenamed("component", "small"), "small").select("job", "cls")
    found, _ = write_table(verified(sets, larger, smaller), "links")
    return contracted(labels, found)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id of its component) for each row of ``docs`` (doc_id, text)."""
    sketched, path = write_table(sketch(docs), "sketch")
    of_rows, _ = write_table(sketched.select("doc_id", "n", "cls"), "classes")
    labels = link_classes(docs, sketched, path)
    own = of_rows.withColumn("row_cls", F.when(F.col("n") > 0, F.col("cls")))
    named = own.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    grouped = named.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = grouped.join(least, "component").select(F.col("cls").alias("row_cls"), "component_id")
    out = own.join(of_class, "row_cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: The rows of op7 in DuckDB's SQL.
SQL = r"""
with recursive d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct r, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as g from d, unnest(range(1, greatest(len(w) - 3, 2))) u(i) where len(w) > 0),
n as (select r, count(*) as n from s group by r),
c as (select g from s group by g having count(*) > 1),
k as (select * from s semi join c using (g)),
p as (select a.r as x, b.r as y, count(*) as m from k a join k b on a.g = b.g and a.r < b.r group by 1, 2),
e as materialized (select x, y from p join n a on a.r = x join n b on b.r = y where 100 * m >= 75 * (a.n + b.n - m)),
t as materialized (select x, y from e union all select y, x from e),
reach as (select r, r as z from n union select reach.r, t.y from reach join t on t.x = reach.z),
m as (select reach.r, min(d.doc_id) as component from reach join d on d.r = reach.z group by reach.r)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, case when n.n is null then doc_id else component end as component_id from d left join n using (r) left join m using (r)
"""
