"""Multipart credential linking, in DataFrame operations only.

Patterns find parts of credentials in whole texts: the base ones are reported
always, the weak ones (identifiers, loose secrets, endpoints) only where parts
that complement them start within ``scope`` code points in the same document:
a loose secret beside an identifier, an identifier beside a secret, an endpoint
beside both. Parts are interval-joined on (document, block of ``scope`` code
points), so a group holds what starts within one block and no group grows with
the input. A weak part that overlaps a base span is left to it.

A text's places come from the lengths of its matches and of what lies between
them, summed over the document, so that a text is read once and doesn't move.

Parts have no greatest length. Null and empty texts have no spans. Repeated
rows, and rows without a doc_id, are searched each for itself;
an empty table gives none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import write_table

SCOPE = 300
SPAN = "row long, doc_id long, kind string, role string, start long, end long"


class Pattern:
    """A kind of part: its role, pattern, the group and test that a match must pass, and what texts must hold to be searched."""

    def __init__(self, kind: str, role: str, pattern: str, group: int = 0, test=None, needs: tuple[str, ...] = ()):
        self.kind, self.role, self.pattern, self.group, self.test, self.needs = kind, role, pattern, group, test, needs

    def matches(self, text: Column) -> Column:
        """Of each match in order: what lies between it and the one before, its length, whether it passes."""
        met = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        tested = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(self.group)) if self.group else met
        between = F.slice(F.split(text, self.pattern, -1), 1, F.size(met))

        def part(s: Column, i: Column) -> Column:
            holds = self.test(s["x"]) if self.test else F.lit(True)
            return F.struct(F.lit(self.kind).alias("kind"), i.alias("nth"), F.length(s["gap"]).alias("gap"), F.length(s["m"]).alias("length"), holds.alias("holds"))

        some = text.rlike(self.pattern)
        for n, need in enumerate(self.needs):
            has = F.contains(text, F.lit(need)) if n == 0 else has | F.contains(text, F.lit(need))
        parts = F.transform(F.arrays_zip(met.alias("m"), tested.alias("x"), between.alias("gap")), part)
        return F.when((has & some) if self.needs else some, parts).otherwise(F.array().cast("array<struct<kind:string,nth:int,gap:int,length:int,holds:boolean>>"))


def _mixed(x: Column) -> Column:
    return x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]")


#: The base patterns (fixed values); longer least lengths in a pattern stand for a test where a dropped match can hide no other.
BASE = (
    Pattern("assign", "secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, lambda x: F.length(x) >= 6, (":", "=")),
    Pattern("access", "identifier", r"AKIA[A-Z0-9]{16,}", needs=("AKIA",)),
    Pattern("hex", "secret", r"[0-9a-f]{24,}"),
)
#: What stands for a part of a credential only among others.
WEAK = (
    Pattern("identifier", "identifier", r"""(?i:client_?id|user_?name|user_?id|user|login|account|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", needs=(":", "=")),
    Pattern("loose", "secret", r"[A-Za-z0-9+/_=-]{20,}", test=_mixed),
    Pattern("endpoint", "endpoint", r"""(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]{2,})://[^\x20\x09-\x0D"'<>]{3,}""", needs=("://",)),
)
KINDS = [p.kind for p in (*BASE, *WEAK)]
#: Roles that must start within the scope of a weak part for it to be reported.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}


def found_parts(docs: DataFrame) -> DataFrame:
    """A row for each match in each document, one without a match for a document that has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*[p.matches(text) for p in (*BASE, *WEAK)]).alias("parts"))
    return own.select("row", "doc_id", F.explode_outer("parts").alias("p")).select("row", "doc_id", "p.*")


def placed(parts: DataFrame) -> DataFrame:
    """The parts' spans in code points, without those that fail their test."""
    before = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.where("kind is not null").withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before))
    role = F.create_map(*[F.lit(x) for p in (*BASE, *WEAK) for x in (p.kind, p.role)])
    return ends.where("holds").select("row", "doc_id", "kind", role[F.col("kind")].alias("role"), (F.col("end") - F.col("length")).alias("start"), "end")


def _in_blocks(spans: DataFrame, scope: int, low: str, high: str) -> DataFrame:
    """``spans`` once for each block of ``scope`` code points from ``low`` to ``high``."""
    return spans.withColumn("block", F.explode(F.expr(f"sequence(({low}) div {scope}, ({high}) div {scope})")))


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that overlap no base span and have their complements within ``scope``."""
    is_base = F.col("kind").isin([p.kind for p in BASE])
    base, weak = spans.where(is_base), spans.where(~is_base)
    taken = _in_blocks(base.select("row", F.col("start").alias("from"), F.col("end").alias("to")), scope, "`from`", "to - 1")
    free = _in_blocks(weak, scope, "start", "end - 1").join(taken, ["row", "block"], "left").withColumn("over", (F.col("start") < F.col("to")) & (F.col("from") < F.col("end")))
    free = free.groupBy("row", "doc_id", "kind", "role", "start", "end").agg(F.max(F.coalesce("over", F.lit(False))).alias("over")).where("not over").drop("over")

    parts = base.unionByName(free)
    out = None
    for role, needed in COMPLEMENTS.items():
        left = free.where(F.col("role") == role)
        for other in needed:
            there = parts.where(F.col("role") == other).select("row", (F.col("start")).alias("at"))
            near = _in_blocks(there.distinct(), scope, f"greatest(at - {scope}, 0)", f"at + {scope}")
            own = left.withColumn("block", F.expr(f"start div {scope}"))
            left = own.join(near, (own["row"] == near["row"]) & (own["block"] == near["block"]) & (F.abs(own["start"] - near["at"]) <= scope), "left_semi").drop("block")
        out = left if out is None else out.unionByName(left)
    return out


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): counts and digest of the base spans, and all spans."""
    parts, _ = write_table(found_parts(docs), "credential-parts")
    spans, _ = write_table(placed(parts), "credential-spans")
    base = spans.where(F.col("kind").isin([p.kind for p in BASE]))
    rows = parts.where("coalesce(nth, 0) = 0").select("row", "doc_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("order"), "end", "kind"))
    each = rows.unionByName(base).unionByName(linked(spans, scope)).groupBy("row", "doc_id").agg(
        *[F.count_if(F.col("kind") == p.kind).alias(f"n_{p.kind}") for p in BASE], F.array_sort(F.collect_list(span)).alias("all")
    )
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    strict = F.filter("all", lambda s: s["order"] <= len(BASE))
    return each.select("doc_id", *[f"n_{p.kind}" for p in BASE], F.sha2(text(strict), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))


def _sql() -> str:
    """The same rows in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    tests = {"assign": "length(x) >= 6", "loose": "regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Z]') and regexp_matches(x, '[a-z]')"}
    met = "\n  union all ".join(
        f"select r, {q(p.kind)} as kind, {q(p.role)} as role, {n} as ord, {'true' if n < len(BASE) else 'false'} as base, regexp_extract_all(t, {q(p.pattern)}) as m, regexp_extract_all(t, {q(p.pattern)}, {p.group}) as x, regexp_split_to_array(t, {q(p.pattern)}) as g from d"
        for n, p in enumerate((*BASE, *WEAK))
    )
    test = " ".join(f"when kind = {q(k)} then {t}" for k, t in tests.items())
    near = lambda role: f"exists (select 1 from parts p where p.r = f.r and p.role = {q(role)} and abs(p.s - f.s) <= {SCOPE})"
    want = " or ".join(f"f.role = {q(role)} and " + " and ".join(map(near, needed)) for role, needed in COMPLEMENTS.items())
    return f"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
met as (
  {met}),
each as (select r, kind, role, ord, base, i, length(g[i]) as gap, length(m[i]) as n, x[i] as x from met, unnest(range(1, len(m) + 1)) as u(i)),
ends as (select *, sum(gap + n) over (partition by r, kind order by i) as e from each),
spans as materialized (select r, kind, role, ord, base, cast(e - n as bigint) as s, cast(e as bigint) as e from ends where case {test} else true end),
free as (select * from spans w where not base and not exists (select 1 from spans b where b.base and b.r = w.r and b.s < w.e and w.s < b.e)),
parts as (select * from spans where base union all select * from free),
kept as (select * from spans where base union all select * from free f where {want})
select doc_id, {', '.join(f"count(*) filter (kind = {q(p.kind)}) as n_{p.kind}" for p in BASE)},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (base), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, ord, e), '') as spans
from d left join kept using (r) group by r, doc_id
"""


SQL = _sql()
