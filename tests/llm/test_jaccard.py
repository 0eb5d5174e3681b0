import random
import re
import time

import pytest

from spanforge.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t):
    w = WORD.findall((t or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = {}
    for d, t in docs:
        sets.setdefault(shingles(t), []).append(d)
    keys = [s for s in sets if s]
    label = {s: s for s in keys}

    def root(s):
        while label[s] is not s:
            s = label[s]
        return s

    index = {}
    for s in keys:
        near = {}
        for g in s:
            for o in index.get(g, ()):
                near[o] = near.get(o, 0) + 1
            index.setdefault(g, []).append(s)
        for o, k in near.items():
            if 100 * k >= 75 * (len(s) + len(o) - k):
                label[root(s)] = root(o)
    least = {}
    for s in keys:
        least[root(s)] = min(least.get(root(s), 1 << 60), *sets[s])
    return sorted((d, len(s), least[root(s)] if s else d) for d, t in docs for s in [shingles(t)])


def got(out):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())


def family(r, size, words, edits, start):
    base = [f"w{r.randrange(10_000)}" for _ in range(words)]
    for i in range(size):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10_000)}"
        yield start + i, " ".join(w)


@pytest.mark.parametrize("block", [256, 4])
def test_random_families(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = random.Random(block)
    docs = [*family(r, 60, 120, 9, 1000), *family(r, 40, 30, 3, 2000), *family(r, 40, 8, 2, 3000), *family(r, 6, 400, 30, 4000)]
    line = "this very common line stands in many of the documents that are here"
    docs += [(5000 + i, line + " " + " ".join(f"q{r.randrange(1000)}" for _ in range(r.randrange(20)))) for i in range(60)]
    docs += [(6000 + i, line) for i in range(30)] + [(7000, None), (7001, ""), (7002, "a B"), (7003, "A b"), (7004, "\n")]
    docs += docs[:5]
    r.shuffle(docs)
    want = brute(docs)
    assert len({c for _, _, c in want}) < len(docs) - 80
    assert got(jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == want


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(jaccard_join.jaccard_components(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd_docs, no_docs):
    assert got(jaccard_join.jaccard_components(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_rows_without_doc_id(spark):
    base = "one two three four five six seven eight nine ten eleven twelve " * 2
    docs = [(None, base), (None, base), (3, base + "x"), (None, "alone in the world of words")]
    out = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 3), (0, 3), (3, 3)]


def test_rows_without_ids(spark):
    """Rows without an id meet by their texts, not each with every class."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(40))) for i in range(2500)]
    docs += [(10_000 + i, t + " end") for i, t in docs[:1250]]
    took = []
    for shape in (docs, [(None, t) for _, t in docs]):
        began = time.time()
        got = jaccard_join.jaccard_components(spark.createDataFrame(shape, "doc_id long, text string").repartition(4)).collect()
        took.append(time.time() - began)
        assert len(got) == len(docs)
        if shape is docs:
            assert sum(r.component_id != r.doc_id for r in got) == 1250
    assert took[1] < 2 * took[0] + 5
