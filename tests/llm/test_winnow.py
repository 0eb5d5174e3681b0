import hashlib
import random
import re

import duckdb
import pytest

from spanforge.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1):
            if n:
                windows.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [item])
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= got
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def got(out):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()), key=str)


@pytest.mark.parametrize("ways", [{}, {"broadcast_windows": 0}])
def test_random_texts(spark, ways):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "é", "d-d"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 5, 9, 10, 12, 30]))) for i in range(12)] + [(3, None), (None, text(10))]
    items += items[:2]
    docs = [(i, text(rng.randrange(60))) for i in range(60)] + [(60, None), (61, ""), (62, "x " + items[-1][1] + " Y!" + (items[4][1] or ""))]
    docs += docs[:3] + [(None, docs[7][1]), (None, items[-1][1]), (None, None)]
    out = winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **ways)
    assert got(out) == brute(docs, items)


def test_tables_and_sql(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(x[-1] for x in want)
    assert got(winnow.decontaminate(docs, items)) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as from '{d}/{t}.parquet'")
    assert sorted(con.sql(winnow.SQL).fetchall(), key=str) == want


def test_odd_rows(spark, odd_docs, no_docs):
    items = odd_docs.selectExpr("doc_id + 100 as item_id", "text", "name")
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(winnow.decontaminate(odd_docs, items)) == want
    assert winnow.decontaminate(no_docs, items).count() == 0
    assert not any(r.contaminated for r in winnow.decontaminate(odd_docs, items.limit(0)).collect())


@pytest.mark.parametrize("ways", [{}, {"broadcast_windows": 0}])
def test_many_marks(spark, ways):
    """More than 5000 marks, an item without an id and passages that stand at any place."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"v{rng.randrange(4000)}" for _ in range(n))
    items = [(i, text(400)) for i in range(60)] + [(None, text(40)), (None, "just six words of an item"), (900, "one two three")]
    whole = [(t or "").split() for _, t in items]
    docs = []
    for i in range(80):
        w = whole[rng.randrange(len(whole))]
        at, n = rng.randrange(len(w)), rng.choice([2, 8, 9, 10, 11, 25])
        docs.append((i, f"{text(rng.randrange(80))} {' '.join(w[at : at + n])} {text(rng.randrange(80))}"))
    docs += [(80, "x just six words of an item y"), (81, "here one two three there")]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    windows, lengths = winnow.item_windows(items_df)
    assert windows.select("mark").distinct().count() > 5000 and lengths == [3, 6, 10]
    out = winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items_df, **ways)
    want = brute(docs, items)
    assert got(out) == want and sum(x[-1] and not x[3] for x in want) >= 1


def test_marks_are_selected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(winnow.words(winnow.F.col("text")).alias("words"))
    r = winnow.fingerprints(docs, [10]).selectExpr("sum(size(words)) w", "sum(size(runs)) n").first()
    assert r.n < 0.4 * r.w
