"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed, word hashes are folded into hashes of ``GRAM`` words, and a
window of 10 words is marked by the least hash of its ``SPAN`` grams. Windows
in a row with one mark are one fingerprint (about 0.29 a word), which carries
its mark and a hash of each of its windows. Equal windows have equal marks, so
every shared span of ten words is met. Fingerprints of ``docs`` and ``items``
are joined on the mark, each hit is extended to its windows, which are joined
on their own hash, and overlapping windows grow into spans of hit words. A
window is told apart by mark and hash, 128 bits together.

An item of fewer than ten words is one window of all its words, and documents
are fingerprinted once more for each such length that occurs.

Null and empty texts have no words: such a document is clean, such an item has
no window. Rows that repeat an item's id and text count once; repeated
documents, also without a doc_id, are judged each for itself. The windows of
items without an item_id count as hit, but name no item. Empty tables give
clean documents or none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import write_table

GRAM = 5
SPAN = 6
WINDOW = GRAM + SPAN - 1
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the items that may be broadcast, about 100 bytes each; more are shuffled.
BROADCAST_WINDOWS = 250_000


def words(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), NOT_WORD), lambda x: x != "")


def _folded(df: DataFrame, out: str, a: str, b: str, shift: int, f: str) -> DataFrame:
    """``out[i] = f(a[i], b[i + shift])`` over as many i as b has."""
    n = f"greatest(size({b}) - {shift}, 0)"
    return df.withColumn(out, F.expr(f"zip_with(slice({a}, 1, {n}), slice({b}, {shift + 1}, {n}), (x, y) -> {f}(x, y))"))


def fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``runs`` (length, at, mark, windows): for each of the ``lengths`` the windows of so many
    ``words``, those in a row with one mark together, from place ``at`` on."""
    grams = {min(n, GRAM) for n in lengths}
    spans = {n - GRAM + 1 for n in lengths if n > GRAM}
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    # out, its two parts, where the second begins, how they are put together, whether it is asked for
    for out, a, b, shift, f, asked in (
        ("h2", "h1", "h1", 1, "xxhash64", max(grams, default=0) > 1), ("h3", "h2", "h1", 2, "xxhash64", 3 in grams),
        ("h4", "h2", "h2", 2, "xxhash64", max(grams, default=0) > 3), ("h5", "h4", "h1", 4, "xxhash64", 5 in grams),
        ("m2", "h5", "h5", 1, "least", max(spans, default=0) > 1), ("m4", "m2", "m2", 2, "least", max(spans, default=0) > 3),
    ):
        if asked:
            df = _folded(df, out, a, b, shift, f)
    runs = []
    for n in lengths:
        mark = whole = f"h{min(n, GRAM)}"
        if n > GRAM:
            span, (mark, whole) = n - GRAM + 1, (f"mark{n}", f"whole{n}")
            half = 4 if span > 3 else 2
            df = _folded(df, whole, "h5", "h5", span - 1, "xxhash64")
            df = _folded(df, mark, f"m{half}", f"m{half}", span - half, "least") if span > half else df.withColumn(mark, F.col(f"m{half}"))
        df = df.withColumn(f"first{n}", F.expr(f"array_compact(transform({mark}, (x, i) -> if(i > 0 and {mark}[i - 1] = x, null, i)))"))
        last = f"if(k + 1 < size(first{n}), first{n}[k + 1], size({mark}))"
        runs.append(F.expr(f"transform(first{n}, (at, k) -> named_struct('length', {n}, 'at', at, 'mark', {mark}[at], 'windows', slice({whole}, at + 1, {last} - at)))"))
    return df.withColumn("runs", F.concat(*runs) if runs else F.array().cast("array<struct<length:int,at:int,mark:bigint,windows:array<bigint>>>"))


def item_windows(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """A row for each window of each item: item_id, length, mark, window (its hash); and the lengths that occur."""
    own = items.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0").withColumn("length", F.least(F.size("words"), F.lit(WINDOW)))
    lengths = sorted(r.length for r in own.select("length").distinct().collect())  # at most WINDOW rows
    each = fingerprints(own, lengths).select("item_id", "length", F.explode(F.filter("runs", lambda r: r["length"] == F.col("length"))).alias("run"))
    windows = each.select("item_id", "length", "run.mark", F.explode("run.windows").alias("window")).distinct()
    return write_table(windows, "item-windows")[0], lengths


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) what it shares with ``items`` (item_id, text).

    doc_id, n_words, n_hit (words in a shared window), n_items, items_sha256
    (of the items' ids, sorted as strings), item_ids, contaminated.
    """
    windows, lengths = item_windows(items)
    way = "broadcast" if windows.count() <= broadcast_windows else "merge"
    marks = windows.select("mark").distinct().withColumn("known", F.lit(True)).hint(way)
    by_window = windows.groupBy("length", "window").agg(F.collect_set("item_id").alias("found")).hint(way)

    # rows are numbered where they are read, so that a task that runs again gives the same numbers
    own = fingerprints(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words")), lengths)
    # one more row stands for the document itself; its mark, which meets nothing, spreads such rows over partitions
    itself = F.struct(F.lit(0).alias("length"), F.lit(-1).alias("at"), F.xxhash64("row").alias("mark"), F.array(F.xxhash64("row")).alias("windows"))
    each = own.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(F.array(itself), "runs")).alias("run")).select("row", "doc_id", "n_words", "run.*")
    met = each.join(marks, "mark", "left").where("known or at < 0")
    extended = met.select("row", "doc_id", "n_words", "length", "at", F.posexplode("windows").alias("nth", "window")).join(by_window, ["length", "window"], "left")
    by_row = extended.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("found").isNotNull(), F.struct((F.col("at") + F.col("nth")).alias("at"), "length")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("item_ids"),
    )
    covered = "aggregate(spans, struct(0 as e, 0L as n), (a, s) -> struct(greatest(a.e, s.at + s.length) as e, a.n + greatest(0, s.at + s.length - greatest(a.e, s.at)) as n), a -> a.n)"
    return by_row.select(
        "doc_id", "n_words", F.expr(covered).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        "item_ids", (F.size("spans") > 0).alias("contaminated"),
    )


def contaminated_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contaminated rows of ``decontaminate``."""
    return decontaminate(docs, items).where("contaminated")


#: The same rows for op10 in DuckDB's SQL.
SQL = r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from b, unnest(range(1, len(w) - least(len(w), 10) + 2)) as t(i) where len(w) > 0),
lengths as (select distinct n from bw),
dw as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from d, lengths, unnest(range(1, len(w) - n + 2)) as t(i)),
hits as (select dw.r, dw.n, dw.i, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
places as (select r, count(distinct p) as n_hit from hits, unnest(range(i, i + n)) as t(p) group by r),
items as (select r, count(distinct item_id) as n_items, sha256(coalesce(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)), '')) as items_sha256 from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (r) left join items using (r)
"""
