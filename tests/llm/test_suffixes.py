import random
import re

import pytest

from spanforge.llm import suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, size=50):
    words = [WORD.findall((t or "").translate(UPPER)) for _, t in docs]
    where = {}
    for i, w in enumerate(words):
        for p in range(len(w) - size + 1):
            where.setdefault(tuple(w[p : p + size]), set()).add(i)
    out = []
    for i, (d, _) in enumerate(docs):
        w, spans = words[i], []
        for p in range(len(w) - size + 1):
            if len(where[tuple(w[p : p + size])]) > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + size
                else:
                    spans.append([p, p + size])
        out.append((d, len(w), sum(e - s for s, e in spans), len(spans), ",".join(f"{s}:{e}" for s, e in spans)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_repeated, r.n_passages, r.passages) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [2000, 20])
def test_planted_passages(spark, monkeypatch, rows):
    monkeypatch.setattr(suffixes, "SORTED_ROWS", rows)
    r = random.Random(4)
    word = lambda: f"w{r.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 120, 300)]
    docs = []
    for i in range(160):
        w = [word() for _ in range(r.randrange(200))]
        for _ in range(r.randrange(3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        docs.append((i, " ".join(w)))
    base = [word() for _ in range(600)]
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(600)] = word()
        docs.append((500 + i, " ".join(w)))
    docs += [(900, " ".join(passages[2])), (901, " ".join(passages[2])), (902, "la " * 300), (903, "la " * 120 + "b"), (904, None), (905, "")]
    docs += docs[:4]
    out = got(suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    assert out == brute(docs)


@pytest.mark.parametrize("rows, run", [(2000, 10_000), (20, 10_000), (2000, 30)])
def test_a_frequent_line_between_many_lead_ins_and_endings(spark, monkeypatch, rows, run):
    monkeypatch.setattr(suffixes, "SORTED_ROWS", rows)
    monkeypatch.setattr(suffixes, "RUN", run, raising=False)
    r = random.Random(7)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    line, leads, ends = some(40), [some(5) for _ in range(14)], [some(5) for _ in range(14)]
    docs = []
    for a in leads:
        for z in ends:
            if r.random() < 0.7:
                docs += [" ".join(some(r.randrange(30, 40)) + a + line + z + some(r.randrange(30, 40))) for _ in range(r.choice([1, 2]))]
    r.shuffle(docs)
    docs = list(enumerate(docs))
    want = brute(docs)
    assert 50 < sum(w[3] == 1 for w in want) < len(docs)
    assert got(suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == want


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out, want = got(suffixes.repeated_passages(docs)), brute([(r.doc_id, r.text) for r in docs.collect()])
    assert out == want and sum(w[2] > 0 for w in want) > 50


def test_odd_rows(spark, odd_docs, no_docs):
    assert got(suffixes.repeated_passages(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert suffixes.repeated_passages(no_docs).count() == 0
