"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans. Boosted trees score each from
its format (lengths, groups, separators, check digits) and its context (words
and characters around it). A kind's threshold is calibrated on held-out rows to
the wanted precision; the best-scoring spans above it are kept where they don't
overlap. The strict base patterns stand whatever the scores say: a candidate
that overlaps one is left to it.

The trees learn from sentences that are made here from a fixed seed, with
personal data in many spellings and numbers that only look like it. Their count
is a parameter and nothing of the corpus is sampled.

Null and empty texts have no spans. Every row is judged for itself, with or
without a doc_id, so repeated rows give equal results; of candidates with equal
scores the first, then the longer one stands. An empty table gives none. Only the text is
read, and for redaction all other columns pass unchanged.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .boosting import Boosted
from .common import column_of, map_rows

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Base kinds in the order in which equal starts are listed; then the kinds that only the model finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. The @ ends every run of local characters, so each is tried once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        start = at - (len(run) - len(run.rstrip(LOCAL)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans (kind, start, end), by start and then kind."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


# Candidates -----------------------------------------------------------------

AT = r"(?: ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) |@)"
DOT = r"(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) |\.)"
#: Generators: kind, what a text must hold, pattern. Bounded repeats keep every scan linear.
GENERATORS = (
    ("email", re.compile(r"\b(?:at|AT)\b[\])}]?|@"), re.compile(rf"(?<![\w.])[A-Za-z0-9][\w.+-]{{0,63}}{AT}[A-Za-z0-9][\w-]{{0,62}}(?:{DOT}[A-Za-z][\w-]{{1,30}}){{1,4}}", re.A)),
    ("ip", re.compile(":"), re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}|:)(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![\w:])", re.A)),
    ("card", DIGIT, re.compile(r"(?<![\w.])[0-9](?:[ ./-]?[0-9]){12,18}(?![\w])", re.A)),
    ("phone", DIGIT, re.compile(r"(?<![\w.])(?:00)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?!\w)", re.A)),
    ("ssn", DIGIT, re.compile(r"(?<![\w.-])[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}(?![\w-])", re.A)),
    ("iban", DIGIT, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)),
)
#: Words that stand by personal data of a kind, in lower case (fixed values).
CUES = {
    "email": {"email", "mail", "e-mail", "contact", "write", "correo", "courriel", "reach", "send"},
    "ip": {"ip", "ipv6", "host", "server", "address", "login"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "tarjeta", "carte", "karte", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "teléfono", "téléphone", "ring"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "konto", "cuenta", "compte", "bank", "transfer"},
}
CUE_WORD = re.compile(r"[^\W\d_][\w-]*")
AROUND = 40


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    digits = None
    for kind, needs, pattern in GENERATORS:
        if needs is DIGIT:
            digits = bool(DIGIT.search(text)) if digits is None else digits
            if not digits:
                continue
        elif not needs.search(text):
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def mod97(s: str) -> bool:
    return s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = "".join(DIGIT.findall(span))
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    cues = CUE_WORD.findall(before.lower())[-4:]
    near = CUE_WORD.findall(after.lower())[:2]
    other = set().union(*(v for k, v in CUES.items() if k != kind))
    # the last word that speaks of this kind, and what stands between it and the span
    said = next((m for m in reversed(list(CUE_WORD.finditer(before.lower()))) if m[0] in CUES[kind]), None)
    between = before[said.end() :] if said else ""
    flat = re.sub(r"[ ./-]", "", span)
    return [
        *(float(kind == k) for k in KINDS),
        len(span), len(digits), len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        len(set(groups)), len(set(digits)), float(luhn(digits)) if 13 <= len(digits) <= 19 else -1.0,
        float(kind == "iban" and mod97(flat)), span.count(" "), span.count("-"), span.count("."), span.count("/"), span.count("("), span.count(":"),
        float(bool(re.search(r"[\[({]", span))), float("@" in span), sum(c.isalpha() for c in span) / len(span),
        float(any(c in CUES[kind] for c in cues)), float(bool(cues) and cues[-1] in CUES[kind]), float(any(c in other for c in cues)), float(any(c in CUES[kind] for c in near)),
        float(before.rstrip().endswith(":")), float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after),
        float(digits[:1] == "0"), float(kind == "ssn" and (digits[:3] in ("000", "666") or digits[:1] == "9")), float("::" in span),
        math.log1p(sum(c.isdigit() for c in before + after)), float(len(between)) if said else -1.0, float(bool(DIGIT.search(between))), float(len(CUE_WORD.findall(between))) if said else -1.0,
    ]


# Training -------------------------------------------------------------------

FILLER = "the of and in this with are order part total code version section page row value item lot batch serial ref number ticket chapter build result year".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def _grouped(r: random.Random, digits: str, sizes: list[int], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(out)


def _with_luhn(r: random.Random, n: int, holds: bool) -> str:
    while True:
        d = str(r.randint(1, 9)) + _digits(r, n - 1)
        if luhn(d) == holds:
            return d


def _iban(r: random.Random, holds: bool) -> str:
    country, rest = r.choice(["DE", "FR", "ES", "GB", "NL"]), _digits(r, r.choice([14, 18, 20]))
    check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
    return f"{country}{(check + (0 if holds else r.randint(1, 90))) % 100:02d}{rest}"


def _true(r: random.Random, kind: str) -> str:
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 9)))
    if kind == "email":
        at, dot = r.choice([("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot "), (" AT ", " DOT "), ("(at)", ".")])
        return f"{word()}{r.choice(['', '.' + word()])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk'])}"
    if kind == "ip":
        full = [f"{r.randrange(1 << 16):x}" for _ in range(8)]
        return ":".join(full) if r.random() < 0.5 else "2001:db8::" + ":".join(full[: r.randint(1, 4)])
    if kind == "card":
        return _grouped(r, _with_luhn(r, 16, True), [4, 4, 4, 4], r.choice([".", "/"]))
    if kind == "phone":
        d = _digits(r, 12)
        return r.choice([f"({d[:3]}) {d[3:6]}-{d[6:10]}", f"{d[:3]}-{d[3:6]}-{d[6:10]}", f"{d[:3]}.{d[3:6]}.{d[6:10]}", f"00{r.choice(['49', '33', '34'])} {d[:3]} {d[3:6]} {d[6:10]}", f"0{d[:3]} {d[3:6]} {d[6:10]}", f"0{d[0]} {d[1:3]} {d[3:5]} {d[5:7]} {d[7:9]}"])
    if kind == "ssn":
        return f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    s = _iban(r, True)
    return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def _false(r: random.Random) -> str:
    n = _digits
    return r.choice([
        lambda: _with_luhn(r, r.randint(13, 19), False), lambda: _grouped(r, _with_luhn(r, 16, False), [4, 4, 4, 4], r.choice([" ", "-", ".", "/"])),
        lambda: n(r, r.randint(2, 19)), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", lambda: f"{n(r, 1)}.{n(r, 2)}.{n(r, 1)}",
        lambda: f"{n(r, 3)} {n(r, 3)} {n(r, 3)}", lambda: f"{n(r, 4)} {n(r, 4)}", lambda: f"{n(r, 2)}-{n(r, 3)}", lambda: f"{n(r, 3)}.{n(r, 3)}.{n(r, 3)}", lambda: f"{r.choice('0123456789')}:{n(r, 2)}:{n(r, 1)}",
        lambda: f"look at the dot in {n(r, 2)}", lambda: f"{r.choice(FILLER)} at {r.choice(FILLER)}.{r.choice(FILLER)}", lambda: f"{r.choice(FILLER)} at {r.choice(FILLER)} dot {r.choice(FILLER)}", lambda: _iban(r, False),
        lambda: f"978-{n(r, 1)}-{n(r, 4)}-{n(r, 4)}-{n(r, 1)}", lambda: f"{n(r, 3)}-{n(r, 2)}-{n(r, 4)}", lambda: f"{n(r, 3)}-{n(r, 3)}-{n(r, 4)}", lambda: f"{n(r, 5)}-{n(r, 4)}",
        lambda: f"{n(r, 2)} {n(r, 2)} {n(r, 2)}", lambda: " ".join(n(r, r.randint(1, 4)) for _ in range(r.randint(3, 7))),
    ])()


def examples(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kind numbers of candidates in made sentences."""
    r = random.Random(seed)
    x, y, kinds = [], [], []
    words = lambda n: " ".join(r.choice(FILLER) for _ in range(n))
    while len(x) < rows:
        text, hits = "", set()
        for _ in range(r.choice([1, 1, 2, 3])):  # items in a row, so that a cue may belong to the one before
            kind = r.choice(KINDS)
            real = r.random() < 0.5
            # shapes that numbers share are personal only beside a word that says so
            cue = r.choice(sorted(CUES[kind])) if real and (kind in ("phone", "ssn", "card", "ip") or r.random() < 0.5) else ""
            cue = r.choice([str, str.capitalize, str.upper])(cue)
            text += f"{words(r.randint(0, 5))} {cue}{r.choice(['', '', ':', '.', ' is', ' number', ' number is', ' from', ' to']) if cue else ''} "
            body = _true(r, kind) if real else _false(r)
            if real:
                hits.add((kind, len(text), len(text) + len(body)))
            text += body + r.choice([" ", ". ", ", ", "\n"])
        text += words(r.randint(0, 5))
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(float(c in hits))
            kinds.append(KINDS.index(c[0]))
    return np.asarray(x, float), np.asarray(y), np.asarray(kinds)


class Model:
    """Trees and for each kind the score from which a candidate is personal data."""

    def __init__(self, rows: int = 6000, precision: float = 0.995, seed: int = 11):
        x, y, _ = examples(rows, seed)
        self.trees = Boosted().fit(x, y)
        x, y, kinds = examples(rows, seed + 1)
        p = self.trees.predict(x)
        self.threshold = {}
        for k, kind in enumerate(KINDS):
            own = np.argsort(-p[kinds == k], kind="stable")
            score, hit = p[kinds == k][own], y[kinds == k][own]
            # half-way below the lowest score down to which the wanted share is right, and never below one half
            right = np.cumsum(hit) / np.arange(1, len(hit) + 1)
            good = np.flatnonzero((right >= precision) & np.append(score[1:] < score[:-1], True))
            self.threshold[kind] = max(0.5, float(score[good[-1]] + np.append(score, 0.0)[good[-1] + 1]) / 2) if len(good) else 2.0

    def spans_of(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """Of each text its base spans and all its spans, in order; the trees see all candidates at once."""
        texts = [t or "" for t in texts]
        bases = [base_spans(t) for t in texts]
        free = [[c for c in candidates(t) if not any(c[1] < e and s < c[2] for _, s, e in base)] for t, base in zip(texts, bases, strict=True)]
        x = [features(t, *c) for t, cs in zip(texts, free, strict=True) for c in cs]
        scores = iter(self.trees.predict(np.asarray(x, float)).tolist() if x else [])
        out = []
        for base, cs in zip(bases, free, strict=True):
            added: list[tuple[str, int, int]] = []
            # equal scores go to the span that begins first, then to the longer one, then to the kind listed first
            for score, c in sorted(((next(scores), c) for c in cs), key=lambda t: (-t[0], t[1][1], -t[1][2], KINDS.index(t[1][0]))):
                if score >= self.threshold[c[0]] and not any(c[1] < e and s < c[2] for _, s, e in added):
                    added.append(c)
            out.append((base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))))
        return out

    def spans(self, text: str | None) -> tuple[list, list]:
        return self.spans_of([text])[0]


@functools.cache
def model(rows: int = 6000) -> Model:
    return Model(rows)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, trained: Model | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): counts and digest of the base spans, and all spans."""
    trained = trained or model()
    schema = StructType.fromDDL(FOUND)

    def make():
        def each(cols):
            rows = []
            for doc, (base, spans) in zip(cols[0], trained.spans_of(cols[1]), strict=True):
                rows.append((doc, *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            return dict(zip(schema.names, zip(*rows, strict=True), strict=True))

        return each

    return map_rows(docs.select("doc_id", "text"), make, schema)


def redact(docs: DataFrame, text: str = "text", trained: Model | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; null stays null."""
    trained = trained or model()

    def clean(texts: list[str | None]) -> list[str | None]:
        done: list[str | None] = []
        for s, (_, spans) in zip(texts, trained.spans_of(texts), strict=True):
            out, at = [], 0
            for kind, start, end in spans:
                if start >= at:
                    out += [s[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
            done.append(None if s is None else "".join([*out, s[at:]]))
        return done

    redacted = column_of(clean, "string", pa.string())
    return docs.withColumn(text, redacted(text))
