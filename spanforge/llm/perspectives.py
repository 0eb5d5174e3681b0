"""Chat formatting by multi-party perspective rotation, in DataFrame operations.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant, all others as users under their names, and system
turns as they are. Masks mark the assistant's words and end marks, in code
points from the start of the row's text.

A dialogue is cut into parts of ``PART_TURNS`` turns, so that one conversation
with any share of all rows is never gathered in one place: turns are sorted over
range partitions, counted there, and numbered by the counts of the partitions before.

Turns are ordered by turn, then role and text; repeated rows are turns of their
own. A null text is empty, a null role is an unnamed user and no participant, a
null conversation is one conversation, and null turns come first. Marks inside a
text are broken with a space. A conversation of system turns alone gives no row,
neither does an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import write_table

PART_TURNS = 64
SYSTEM = "system"
UNNAMED = "unknown"
END = "<|end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``nth``, the turns before in the conversation."""
    order = ["turn", "role", "text"]
    ranged = turns.select("conv_id", *order).repartitionByRange("conv_id", *order).withColumn("place", F.spark_partition_id())
    kept, _ = write_table(ranged, "turns")
    counts = kept.groupBy("conv_id", "place").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    prior = counts.select(F.col("conv_id").alias("of"), F.col("place").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("prior"))
    own = kept.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "place").orderBy(*order)) - 1)
    met = own.join(prior, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")))
    return met.select("conv_id", *order, (F.col("prior") + F.col("own")).alias("nth"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """A row for each conversation, participant and part: text, masks ('start:end,...') and what they cover."""
    speakers = turns.where((F.col("role").isNotNull()) & (F.col("role") != SYSTEM)).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    each = numbered(turns).join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    name = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user:"), F.coalesce("role", F.lit(UNNAMED))))
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    head, body = F.concat(F.lit("<|"), safe(name), F.lit("|>\n")), F.concat(safe(F.coalesce("text", F.lit(""))), F.lit(END))
    lines = each.select("conv_id", "perspective", F.floor(F.col("nth") / part_turns).alias("part"), "nth", own.alias("own"), head.alias("head"), body.alias("body"))
    upto = Window.partitionBy("conv_id", "perspective", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = lines.withColumn("end", F.sum(F.length("head") + F.length("body") + 1).over(upto) - 1)
    mask = F.when(F.col("own"), F.struct("nth", (F.col("end") - F.length("body")).alias("start"), "end"))
    parts = ends.groupBy("conv_id", "perspective", "part").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("nth", F.concat("head", "body", F.lit("\n")).alias("line")))).alias("lines"),
        F.array_sort(F.collect_list(mask)).alias("masks"),
    )
    return parts.select(
        "conv_id", "perspective", "part", "n_turns", F.array_join("lines.line", "").alias("text"),
        F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",").alias("masks"),
        F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"]).alias("n_trained"),
    )


#: The same rows for op8 in DuckDB's SQL.
SQL = """
with t as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as nth from conversations),
s as (select distinct conv_id as of, role as perspective from conversations where role <> 'system'),
l as (
  select t.conv_id, perspective, nth // 64 as part, nth, coalesce(role = perspective, false) as own,
    '<|' || replace(case when coalesce(role = perspective, false) then 'assistant' when role = 'system' then 'system' else 'user:' || coalesce(role, 'unknown') end, '<|', '< |') || '|>' || chr(10) as head,
    replace(coalesce(text, ''), '<|', '< |') || '<|end|>' as body
  from t join s on t.conv_id is not distinct from s.of),
e as (select *, sum(length(head) + length(body) + 1) over (partition by conv_id, perspective, part order by nth) - 1 as e from l)
select conv_id, perspective, cast(part as bigint) as part, count(*) as n_turns, string_agg(head || body || chr(10), '' order by nth) as text,
  coalesce(string_agg((e - length(body)) || ':' || e, ',' order by nth) filter (own), '') as masks,
  cast(coalesce(sum(length(body)) filter (own), 0) as bigint) as n_trained
from e group by conv_id, perspective, part
"""
