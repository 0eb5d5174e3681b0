"""Rule-based quality filter as a short-circuit cascade.

Every rule says whether a document is rejected. On a sample of about
``SAMPLE_ROWS`` rows, measured where they are read, the cost of each statistic
and the documents that each set of rules rejects are found. Next in order is
always the rule with most rejections per second: of documents that the rules
before it left, at the cost of statistics that they didn't read. A document that
one rule rejects is not looked at by later ones. The order changes the work
and never the verdict, so the sample decides nothing about the result.

Null and empty texts have no words, fail the base rule of 50 words, and are
rejected. Repeated rows and ties are judged each for itself; a table without
rows gives none, and other columns are not read.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SAMPLE_ROWS = 2000


class Text:
    """Statistics of a text, each computed once and only when a rule asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that the text holds twice or more."""
        if self.n_words < 4:
            return 0
        ids: dict[str, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in self.words), np.int64, self.n_words)
        _, pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, which, counts = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = counts[which] > 1
        hit = np.zeros(self.n_words, bool)
        for k in range(3):
            hit[k : self.n_words - 2 + k] |= again
        return int(hit.sum())

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def capitals(self) -> int:
        return sum(map(str.isupper, self.text))


#: Rejections; the first two are the base rules, whose limits the contract fixes.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < MIN_WORDS,
    "repeated_trigrams": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
    "symbols": lambda t: 100 * t.n_symbols > 6 * t.word_chars,
    "duplicate_lines": lambda t: len(t.lines) >= 4 and 100 * t.n_dup_lines > 50 * len(t.lines),
    "capitals": lambda t: t.letters >= 40 and 100 * t.capitals > 50 * t.letters,
    "word_length": lambda t: t.word_chars > 20 * t.n_words or t.word_chars < 2 * t.n_words,
}
BASE = ("few_words", "repeated_trigrams")


#: The statistics of a Text that each rule reads, in the order in which they build on each other.
READS = {
    "few_words": ("words", "n_words"),
    "repeated_trigrams": ("words", "n_words", "n_repeat_words"),
    "symbols": ("n_symbols", "words", "word_chars"),
    "duplicate_lines": ("lines", "n_dup_lines"),
    "capitals": ("letters", "capitals"),
    "word_length": ("words", "n_words", "word_chars"),
}
STATISTICS = tuple(dict.fromkeys(s for k in READS.values() for s in k))
#: What the base counts need anyway.
COUNTED = tuple(s for s in STATISTICS if s not in ("letters", "capitals"))


def measured(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Over about ``sample_rows`` documents: the seconds of each statistic (name), and how many documents
    are rejected by just the rules whose bits ``rejecting`` has."""
    n = docs.count()
    part = docs.select("text").sample(min(1.0, sample_rows / max(n, 1)), seed=7)

    def make():
        def each(cols):
            spent, rejecting = dict.fromkeys(STATISTICS, 0.0), Counter()
            for text in cols[0]:
                t = Text(text)
                for s in STATISTICS:
                    began = time.perf_counter()
                    getattr(t, s)
                    spent[s] += time.perf_counter() - began
                rejecting[sum(rule(t) << i for i, rule in enumerate(RULES.values()))] += 1
            k, m = len(spent), len(rejecting)
            return {"name": [*spent, *[None] * m], "seconds": [*spent.values(), *[None] * m], "rejecting": [*[None] * k, *rejecting], "rows": [*[None] * k, *rejecting.values()]}

        return each

    each = map_rows(part, make, StructType.fromDDL("name string, seconds double, rejecting long, rows long"))
    return each.groupBy("name", "rejecting").agg(F.sum("seconds").alias("seconds"), F.sum("rows").alias("rows"))


def ordered(seconds: dict[str, float], rejecting: dict[int, int], known: tuple[str, ...] = ()) -> list[str]:
    """The rules, next always the one with most rejections per second: of documents that the rules before it
    left, and counting only the statistics that nothing before it has read."""
    order: list[str] = []
    known, left = set(known), dict(rejecting)
    bit = {k: 1 << i for i, k in enumerate(RULES)}
    while len(order) < len(RULES):
        cost = {k: 1e-9 + sum(seconds.get(s, 0.0) for s in READS[k] if s not in known) for k in RULES if k not in order}
        caught = {k: sum(n for mask, n in left.items() if mask & bit[k]) for k in cost}
        best = min(cost, key=lambda k: (-caught[k] / cost[k], cost[k], k))
        order.append(best)
        known.update(READS[best])
        left = {mask: n for mask, n in left.items() if not mask & bit[best]}
    return order


def cascade_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[str]:
    """The rules in the order that the sample gives; what is ``known`` anyway costs nothing."""
    found = measured(docs, sample_rows).collect()  # a row for each statistic and each set of rules
    return ordered({r.name: r.seconds for r in found if r.name}, {r.rejecting: r.rows for r in found if not r.name}, known)


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string, rules_run long"


def apply_rules(docs: DataFrame, order: list[str] | None = None, statistics: bool = True) -> DataFrame:
    """Verdict of the cascade for each row of ``docs`` (doc_id, text).

    ``rejected_by`` names the rule that ended the cascade and ``rules_run``
    counts those that ran. With ``statistics`` the base counts are given for
    every row; without, they are null and rules that didn't run cost nothing.
    """
    order = order or cascade_order(docs, known=COUNTED if statistics else ())

    def make():
        def each(cols):
            rows = []
            for doc, text in zip(*cols, strict=True):
                t = Text(text)
                by, run = None, 0
                for k in order:
                    run += 1
                    if RULES[k](t):
                        by = k
                        break
                if statistics:
                    failed = any(RULES[k](t) for k in BASE)
                    rows.append((doc, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, by is None, by, run))
                else:
                    rows.append((doc, *[None] * 6, by is None, by, run))
            return dict(zip(names, zip(*rows, strict=True), strict=True))

        return each

    schema = StructType.fromDDL(VERDICT)
    names = schema.names
    return map_rows(docs.select("doc_id", "text"), make, schema)


#: The rows of op9 in DuckDB's SQL.
SQL = r"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from d, unnest(range(1, len(w) - 1)) u(i)),
o as (select r, i from (select *, count(*) over (partition by r, g) as c from g) where c > 1),
p as (select r, count(distinct i + k) as n from o, (values (0), (1), (2)) v(k) group by r),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
s as (
  select d.r, doc_id, len(w) as n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as c, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as y,
    len(l) as k, len(l) - len(list_distinct(l)) as u, coalesce(p.n, 0) as q, len(regexp_extract_all(t, '\p{L}')) as a, len(regexp_extract_all(t, '\p{Lu}')) as b
  from d join l using (r) left join p using (r)),
v as (select *, n < 50 or 100 * q > 50 * n as f from s)
select doc_id, cast(n as bigint) as n_words, cast(c as bigint) as word_chars, cast(y as bigint) as n_symbols, cast(u as bigint) as n_dup_lines, cast(q as bigint) as n_repeat_words, f as base_failed,
  not (f or 100 * y > 6 * c or k >= 4 and 100 * u > 50 * k or a >= 40 and 100 * b > 50 * a or c > 20 * n or c < 2 * n) as kept
from v
"""
