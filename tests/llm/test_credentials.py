import hashlib
import random
import re

import duckdb
import pandas as pd

from spanforge.llm import credentials

BASE = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
ALL = ["assign", "access", "hex", "identifier", "loose", "endpoint"]


def brute(text):
    text = text or ""
    base = []
    for k, p in BASE.items():
        for m in re.finditer(p, text, re.I if k == "assign" else 0):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[k]():
                base.append((k, *m.span(), {"access": "identifier"}.get(k, "secret")))
    free = []
    for p in credentials.WEAK:
        for m in re.finditer(p.pattern, text):
            x = m[0]
            ok = p.kind != "loose" or len(x) <= 64 and re.search("[0-9]", x) and re.search("[A-Z]", x) and re.search("[a-z]", x)
            if ok and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
                free.append((p.kind, *m.span(), p.role))
    parts = base + free
    near = lambda f, role: any(r == role and abs(s - f[1]) <= credentials.SCOPE for _, s, _, r in parts)
    kept = base + [f for f in free if all(near(f, r) for r in credentials.COMPLEMENTS[f[3]])]
    text_of = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e, _ in sorted(spans, key=lambda t: (t[1], ALL.index(t[0]), t[2])))
    return *(sum(b[0] == k for b in base) for k in BASE), hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(kept)


PIECES = ["token = \"{h}\"", "Password: hunter22", "api_key=ab", "secret=token: abcdefgh", "AKIA{a}", "AKIASHORT", "{h}", "user: alice", "client_id={a}", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "https://db.example.com/x", "é word", "a fact", "\n", "0123456789abcdefABCDEF0123"]


def texts(n):
    r = random.Random(5)
    for _ in range(n):
        t = []
        for _ in range(r.randrange(14)):
            p = r.choice(PIECES).replace("{h}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([20, 23, 24, 40])))).replace("{a}", "".join(r.choice("ABC0123") for _ in range(r.choice([15, 16, 20]))))
            t.append(p + r.choice([" ", ", ", "\"", " " * r.choice([1, 100, 299, 300, 400])]))
        yield "".join(t)


def rows(out):
    return sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in out.collect())


def test_random_texts_and_sql(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([*enumerate(texts(150)), (900, None)], "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    documents = pd.DataFrame([(r.doc_id, r.text) for r in docs.collect()], columns=["doc_id", "text"]).astype({"text": "object"})
    want = sorted((d, *brute(t)) for d, t in documents.itertuples(index=False))
    assert {k for w in want for k in ALL if f"{k}:" in w[-1]} == set(ALL)
    assert rows(credentials.find_secrets(docs)) == want
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.sql(credentials.SQL).fetchall()) == want
    assert credentials.find_secrets(no_docs).count() == 0


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert sum(w[1] for w in want) > 5
    assert rows(credentials.find_secrets(docs)) == want
