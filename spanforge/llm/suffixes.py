"""Repeated passages by sparse suffix arrays.

A suffix is kept where the hash of its first ``KEY`` words is the least of
``SPARSE`` consecutive ones, so every passage of ``PASSAGE`` = KEY + SPARSE - 1
words keeps the same suffix wherever it stands. Suffixes whose first words
occur in one document only are dropped. The others are sorted over range
partitions, by their first words and what follows. A passage around a kept
suffix begins i words before it, i from 0 to SPARSE - 1, so each suffix has
SPARSE passages, and each of them is hashed and looked for among all suffixes
of the same first words: in the task for those that stand in one partition,
else by a join on the hash, to which a task gives of each passage only what it
couldn't settle itself. Nothing is capped, and the kept suffixes of a longer
passage lie so close that what one doesn't reach is reached from the next.

Words are those of the shingles (A-Z lower-cased). A passage counts when two
documents share at least PASSAGE words in a row. Documents of equal words are
one class: all their words repeat when they are long enough, and one of them
stands for all in the sort, so exact copies cost nothing there.

Null, empty and short texts have no such passage. Repeated rows repeat each
other. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import release, remove, write_table
from .common import map_rows, row_key
from .shingles import grams, word_hashes

KEY = 20
SPARSE = 31
PASSAGE = KEY + SPARSE - 1
REACH = SPARSE - 1
#: Suffixes of one key that are held at once; the passages of more are met by a join.
RUN = 10_000
#: Suffixes in a partition of the sort, at least.
SORTED_ROWS = 2000


def kept_places(keys: np.ndarray) -> np.ndarray:
    """Where the key is the last least one of some window of SPARSE keys."""
    if len(keys) < SPARSE:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(keys, SPARSE)[:, ::-1]
    return np.unique(np.arange(len(windows)) + SPARSE - 1 - windows.argmin(1))


def class_of(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def _each_words(texts):
    h, at = word_hashes(texts)
    g = grams(h, KEY)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield h[a:b], g[a : max(a, b - KEY + 1)]


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, row (its key), n_words, cls, and the keys and places of each class's first document in a task."""

    def make():
        seen: set[int] = set()

        def each(cols):
            out = {"doc_id": cols[0], "row": cols[2], "n_words": [], "cls": [], "keys": [], "places": []}
            for words, keys in _each_words(cols[1]):
                cls = class_of(words)
                out["n_words"].append(len(words))
                out["cls"].append(cls)
                new = len(words) >= PASSAGE and cls not in seen
                at = kept_places(keys) if new else None
                out["keys"].append(keys[at].view(np.int64) if new else None)
                out["places"].append(at.astype(np.int32) if new else None)
                seen.add(cls)
            return out

        return each

    return map_rows(docs.select("doc_id", "text", row_key().alias("row")), make, StructType.fromDDL("doc_id long, row long, n_words long, cls long, keys array<long>, places array<int>"))


SUFFIX = "key long, cls long, places array<int>, before binary, after binary"


def suffixes(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The suffixes that may repeat in another class, with REACH words to each side as 32-bit hashes, the nearest first."""
    each = sketched.where("keys is not null").select("cls", F.explode(F.arrays_zip("keys", "places")).alias("s")).select("cls", F.col("s.keys").alias("key"), F.col("s.places").alias("place"))
    shared = each.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("key")
    shared, _ = write_table(shared, "suffix-keys")  # read anew, so that a join on a frequent key can be split
    places = each.join(shared, "key").groupBy("cls").agg(F.array_sort(F.collect_set("place")).alias("places"))
    rep = sketched.where("keys is not null").groupBy("cls").agg(F.min("row").alias("row"))
    asked = places.join(rep, "cls")

    def make():
        edge = np.zeros(REACH, np.uint32)

        def each_doc(cols):
            out = {k: [] for k in ("key", "cls", "places", "before", "after")}
            for cls, places, (words, keys) in zip(cols[0], cols[1], _each_words(cols[2]), strict=True):
                if class_of(words) != cls:  # another row may have the same key
                    continue
                short = np.concatenate([edge, (words & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1), edge])
                at = np.asarray(places)
                # big-endian, so that bytes sort as the words do
                before = short[at[:, None] + np.arange(REACH - 1, -1, -1)].astype(">u4")
                after = short[at[:, None] + REACH + KEY + np.arange(REACH)].astype(">u4")
                same: dict[tuple, list[int]] = {}
                for p, k, b, a in zip(places, keys[at].view(np.int64).tolist(), before, after, strict=True):
                    same.setdefault((k, b.tobytes(), a.tobytes()), []).append(p)
                for (k, b, a), ps in same.items():
                    for name, v in zip(out, (k, cls, ps, b, a), strict=True):
                        out[name].append(v)
            return out

        return each_doc

    # what is asked for grows with the input, so it is never broadcast
    texts = docs.select(row_key().alias("row"), "text").join(asked.hint("merge"), "row").select("cls", "places", "text")
    return map_rows(texts, make, StructType.fromDDL(SUFFIX)).dropDuplicates(["key", "cls", "before", "after"])


def _prefixes(words: np.ndarray) -> np.ndarray:
    """A hash of the first 0, 1, ... REACH words, row by row."""
    h = np.zeros((len(words), REACH + 1), np.uint64)
    for j in range(REACH):
        x = (h[:, j] ^ words[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h[:, j + 1] = x ^ (x >> np.uint64(29))
    return h


def signatures(key: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and i from 0 to REACH a hash of the passage that begins i words before the key, and whether the text reaches so far."""
    left, right = _prefixes(before), _prefixes(after)[:, ::-1]
    i = np.arange(REACH + 1)
    x = left * np.uint64(0xBF58476D1CE4E5B9) + right * np.uint64(0x94D049BB133111EB) + key.astype(np.int64).view(np.uint64)[:, None] + i.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    holds = (i <= (before != 0).sum(1)[:, None]) & (REACH - i <= (after != 0).sum(1)[:, None])  # zeros are edges
    return x ^ (x >> np.uint64(32)), holds


def marked(signs: np.ndarray, holds: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where a row's passage stands in another class too; and the signatures of these passages with two of their classes."""
    marks = np.zeros(signs.shape, bool)
    at = np.flatnonzero(holds)
    if not len(at):
        return marks, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = signs.ravel()[at]
    order = np.argsort(s)
    s, at = s[order], at[order]
    c = cls[at // signs.shape[1]]
    first = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
    low, high = np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)
    more = low < high
    marks.ravel()[at] = np.repeat(more, np.diff(np.append(first, len(s))))
    return marks, s[first][more], low[more], high[more]


SPAN = "cls long, start int, end int"


def _spans(batch: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
    """Spans (cls, start, end) of passages that two classes of these rows share.

    Where the rows are not the ``whole`` runs of their keys, also the other
    passages' spans with their signature, and each shared passage's signature
    with two of its classes and no span.
    """
    fixed = lambda n: np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint32).reshape(batch.num_rows, REACH)
    cls, listed = batch.column("cls").to_numpy(), batch.column("places")
    lengths = listed.value_lengths().to_numpy()
    row, place = np.repeat(np.arange(batch.num_rows), lengths), listed.flatten().to_numpy()
    signs, holds = signatures(batch.column("key").to_numpy(), fixed("before"), fixed("after"))
    marks, shared, low, high = marked(signs, holds, cls)

    some = marks.any(1)[row]
    r, p = row[some], place[some]
    # both ends' passages hold the key, so what lies between them repeats too
    cols = [[cls[r], p - (REACH - marks[:, ::-1].argmax(1)[r]), p + PASSAGE - marks.argmax(1)[r], np.zeros(len(r), np.uint64), np.zeros(len(r), bool), np.ones(len(r), bool)]]
    if not whole:
        n, i = np.nonzero((holds & ~marks)[row])
        cols.append([cls[row[n]], place[n] - i, place[n] + PASSAGE - i, signs[row[n], i], np.ones(len(n), bool), np.ones(len(n), bool)])
        for c in (low, high):
            cols.append([c, np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), shared, np.ones(len(c), bool), np.zeros(len(c), bool)])
    cls, start, end, sign, signed, placed = (np.concatenate(x) for x in zip(*cols, strict=True))
    values = (pa.array(cls, pa.int64()), pa.array(start.astype(np.int32), mask=~placed), pa.array(end.astype(np.int32), mask=~placed), pa.array(sign.view(np.int64), mask=~signed))
    return pa.RecordBatch.from_arrays(list(values), names=["cls", "start", "end", "sign"])


def shared_spans(found: DataFrame, parts: int) -> DataFrame:
    """Spans (cls, start, end) that suffixes of one key share across classes."""

    def run(batches):
        # the first and last run of equal keys may go on in another partition
        rest, opened = None, True
        for b in batches:
            if not b.num_rows:
                continue
            both = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            key = both.column("key").to_numpy()
            begins = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
            rest = both
            if begins:
                at = begins[0] if opened else 0
                if at:
                    yield _spans(both.slice(0, at), False)
                if at < begins[-1]:
                    yield _spans(both.slice(at, begins[-1] - at), True)
                rest, opened = both.slice(begins[-1]), False
            if rest.num_rows >= RUN:
                yield _spans(rest, False)
                rest, opened = None, True
        if rest is not None:
            yield _spans(rest, False)
        pa.default_memory_pool().release_unused()  # the worker lives on

    order = ("key", "after", "before", "cls", "places")
    ranged = found.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done, _ = write_table(ranged.mapInArrow(run, StructType.fromDDL(SPAN + ", sign long")), "suffix-spans")
    signed = done.where("sign is not null")
    shared = signed.groupBy("sign").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("sign")
    there = signed.where("start is not null").join(shared, "sign", "left_semi")
    return done.where("sign is null").select("cls", "start", "end").unionByName(there.select("cls", "start", "end"))


def merged(spans: DataFrame) -> DataFrame:
    """cls and its spans, united."""
    each = spans.groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))

    def make():
        def unite(cols):
            out = []
            for spans in cols[1]:
                own: list[list[int]] = []
                for s in spans:
                    if own and s["start"] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], s["end"])
                    else:
                        own.append([s["start"], s["end"]])
                out.append(own)
            return {"cls": cols[0], "spans": out}

        return unite

    return map_rows(each, make, StructType.fromDDL("cls long, spans array<array<int>>"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) the words that stand in passages shared with another row.

    doc_id, n_words, n_repeated, n_passages, and the passages as 'start:end,...' in words.
    """
    sketched, _ = write_table(sketch(docs), "suffix-sketch")
    found, path = write_table(suffixes(docs, sketched), "suffixes")
    release(docs.sparkSession)
    n = found.count()
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // SORTED_ROWS))
    united, _ = write_table(merged(shared_spans(found, parts)), "passages")
    remove(docs.sparkSession, path)

    own = sketched.select("doc_id", "n_words", "cls")
    copies = own.groupBy("cls").agg(F.count("*").alias("copies"))
    of_class = copies.join(united, "cls", "left")
    out = own.join(of_class, "cls")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= PASSAGE)
    spans_of = F.when(whole, F.array(F.array(F.lit(0), F.col("n_words").cast("int")))).otherwise(F.coalesce("spans", F.array().cast("array<array<int>>")))
    return out.withColumn("s", spans_of).select(
        "doc_id", "n_words", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0]).alias("n_repeated"), F.size("s").cast("long").alias("n_passages"),
        F.array_join(F.transform("s", lambda x: F.concat_ws(":", x[0], x[1])), ",").alias("passages"),
    )


#: The rows of op6 in DuckDB's SQL.
SQL = r"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
v as materialized (select r, i, md5(array_to_string(w[i:i + 49], ' ')) as g from d, unnest(range(1, len(w) - 48)) u(i)),
c as (select g from v group by g having min(r) < max(r)),
o as (select r, i, lag(i) over (partition by r order by i) as p from v semi join c using (g)),
s as (select *, sum(case when p is null or i > p + 50 then 1 else 0 end) over (partition by r order by i) as k from o),
x as (select r, k, min(i) - 1 as a, max(i) + 49 as z from s group by r, k),
a as (select r, sum(z - a) as n, count(*) as m, string_agg(a || ':' || z, ',' order by a) as t from x group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(n as bigint) as n_repeated, m as n_passages, t as passages from d join a using (r)
"""
