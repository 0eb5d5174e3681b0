import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 14 <= len(d) <= 19 and sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0, "phone": 10 <= len(d) <= 15}
            if ok[k]:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=3000, deadline=None)
@given(text=st.text(alphabet="ab.@-+%_ 0123456789()é\n", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=1000, deadline=None)
@given(text=st.text(alphabet="01 -", min_size=14, max_size=40))
def test_base_cards(text):
    assert pii.base_spans(text) == brute(text)


def test_model_tells_personal_data_from_numbers():
    m = pii.model()
    x, y, _ = pii.examples(3000, 99)
    p = m.trees.predict(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.97
    found = lambda t: [(k, t[s:e]) for k, s, e in m.spans(t)[1]]
    assert found("write to jane.doe (at) example (dot) org today") == [("email", "jane.doe (at) example (dot) org")]
    assert found("my ssn is 123-45-6789 ok") == [("ssn", "123-45-6789")]
    assert found("call: (555) 123-4567 now") == [("phone", "(555) 123-4567")]
    assert found("iban DE89 3704 0044 0532 0130 00") == [("iban", "DE89 3704 0044 0532 0130 00")]
    for clean in ("item 9807915762804490 is sold", "version 1.22.3 of 2024-01-05 at 10:22:33", "look at the dot on page 12", "lot 123 456 789", "4040549990366438 in a row"):
        assert found(clean) == [], clean


def test_clean_documents_stay_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in docs.collect():
        base, spans = pii.model().spans(r.text)
        assert base == brute(r.text)
        assert spans == base


def test_digests_and_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.union(spark.createDataFrame([(50, "é mail a.b@c.de, +1 (212) 555-7713; 10.0.0.1; 4539578763621486", None, None, None, None, None)], odd_docs.schema))
    out = pii.find_pii(docs).collect()
    assert len(out) == docs.count()
    for r, t in ((r, t) for r in out for t in [{x.doc_id: x.text for x in docs.collect()}[r.doc_id] or ""]):
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    (r,) = [r for r in out if r.doc_id == 50]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.spans == "email:7:15,phone:17:34,ip:36:44,card:46:62"
    red = {x.doc_id: x for x in pii.redact(docs).collect()}
    assert red[50].text == "é mail [EMAIL], [PHONE]; [IP]; [CARD]" and red[2].text is None and red[1].name == "x"
    assert pii.find_pii(no_docs).count() == 0


def test_long_runs_take_no_quadratic_time():
    for t in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" * 150_000, "+1" * 100_000, "1." * 100_000, "A" * 300_000, ":" * 100_000, "a at " * 50_000):
        pii.model().spans(t)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    from spanforge.llm.boosting import Boosted

    b = Boosted().fit(x[:1000], y[:1000])
    assert ((b.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95


def test_ties_and_rows_without_ids(spark):
    """A batch gives what its texts give one by one, in any order; rows without an id are judged too."""
    m = pii.model()
    texts = ["call: (555) 123-4567 now", None, "ssn 123-45-6789, ssn 123-45-6789", "", "mail a.b@c.de", "call: (555) 123-4567 now"]
    assert m.spans_of(texts) == [m.spans(t) for t in texts] == m.spans_of(texts[::-1])[::-1]
    out = pii.find_pii(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.spans for r in out) == sorted(pii.joined(m.spans(t)[1]) for t in texts)


def letters(seed):
    """Letters, forms and records in other words and layouts than the trees have learned from, with the kinds put into them."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: r.choice(["mara", "j.olsen", "pat_99", "li-wei", "o.brandt", "info", "s.garcia"])
    host = lambda: r.choice(["northwind", "acme-labs", "uni-bonn", "mairie"]) + r.choice([" dot ", "(dot)", " [dot] "]) + r.choice(["com", "de", "fr"])

    def card():
        while True:
            d = r.choice("3456") + n(15)
            if pii.luhn(d):
                return r.choice("./").join(d[i : i + 4] for i in range(0, 16, 4))

    def iban():
        country, rest = r.choice(["DE", "AT", "BE"]), n(r.choice([18, 16, 12]))
        s = f"{country}{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}{rest}"
        s = " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s
        return iban() if pii.base_spans(s) else s  # what a base pattern takes is no candidate

    made = {
        "email": lambda: (r.choice(["You can reach me under ", "Our contact: ", "Please write to "]), name() + r.choice([" at ", "(at)", " [at] "]) + host()),
        "ip": lambda: (r.choice(["The server answered from ", "Login from host "]), "2001:db8::" + ":".join(f"{r.randrange(1, 1 << 16):x}" for _ in range(3))),
        "card": lambda: (r.choice(["Paid by credit card ", "Charge my visa "]), card()),
        "phone": lambda: (r.choice(["Please call ", "Tel. ", "Our fax: "]), r.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)} {n(3)} {n(4)}"])),
        "ssn": lambda: (r.choice(["His social security number is ", "SSN: "]), f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"),
        "iban": lambda: (r.choice(["Transfer it to ", "Our bank account is "]), iban()),
    }
    plain = [
        lambda: f"Order {n(9)} left on {r.randint(1, 28)}.{r.randint(1, 12)}.20{n(2)}.", lambda: f"The score was {n(2)}-{n(2)} after {n(3)} minutes.", lambda: f"See pages {n(3)}-{n(3)} of volume {n(1)}.",
        lambda: f"We sold {n(3)} {n(3)} units in {r.randint(1990, 2024)}.", lambda: "They met at noon. The dot is red.", lambda: f"Part {n(4)}-{n(4)} fits model {n(3)}.{n(2)}.", lambda: f"The train leaves at {r.randint(0, 23):02d}:{n(1)}5:00.",
    ]
    for _ in range(700):
        text, want = "", []
        for _ in range(r.randint(1, 4)):
            if r.random() < 0.4:
                kind = r.choice(list(made))
                lead, body = made[kind]()
                want.append((kind, len(text) + len(lead), len(text) + len(lead) + len(body)))
                text += lead + body + r.choice([". ", ", thanks. ", "\n"])
            else:
                text += r.choice(plain)() + " "
        yield text, want


def test_precision_and_recall_by_kind():
    """Figures for the README, on texts that another generator has made."""
    right, found, there = ({k: 0 for k in pii.KINDS} for _ in range(3))
    made = list(letters(4))
    for (_, want), (_, spans) in zip(made, pii.model().spans_of([t for t, _ in made]), strict=True):
        for k in pii.KINDS:
            got, true = {s for s in spans if s[0] == k}, {s for s in want if s[0] == k}
            right[k], found[k], there[k] = right[k] + len(got & true), found[k] + len(got), there[k] + len(true)
    figures = {k: (round(right[k] / max(1, found[k]), 3), round(right[k] / there[k], 3)) for k in pii.KINDS}
    print("precision and recall by kind", figures)
    assert sum(right.values()) / sum(found.values()) > 0.95 and sum(right.values()) / sum(there.values()) > 0.8
