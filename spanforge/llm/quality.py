"""Quality classifier: regularised quadratic discriminant analysis.

A document is a vector of transformed statistics of its text (lengths, shares
of character classes, repetition). Each class is a Gaussian whose covariance is
shrunk towards the pooled one and that towards a multiple of the identity; its
Cholesky factor is kept with the model. A score is the difference of the two
Mahalanobis log densities, put on a probability scale by a logistic fit on the
training rows.

The moments are sums over all training rows, so the fit needs no sample. A row
is a training row if the crc32 of its doc_id (as text) mod 3 is not 1 and it
has a label 0 or 1. Labels, language, source and doc_id are no features.

Null and empty texts have the statistics of no words, and a score. Repeated
documents are scored each for itself, and repeated labels count each. Where
one of the classes has no training row all scores are 0.5. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import write_table
from .common import column_of, map_rows
from .rules import Text

#: Names of the statistics, in the order of ``statistics``.
STATISTICS = "words mean_word spread_word distinct symbols capitals digits marks shouts repeats dup_lines line_words foreign entropy odd_words".split()


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text; shares go through the arcsine of the root, counts through the logarithm."""
    t = Text(text)
    n, chars = t.n_words, max(1, t.word_chars)
    share = lambda a, b: math.asin(math.sqrt(min(1.0, a / b))) if b else 0.0
    lengths = np.fromiter(map(len, t.words), float, n) if n else np.zeros(1)
    seen = Counter(t.text)
    kinds: Counter = Counter()
    for c, k in seen.items():
        kinds["capital"] += k * c.isupper()
        kinds["letter"] += k * c.isalpha()
        kinds["digit"] += k * c.isdigit()
        kinds["foreign"] += k * (c > "\x7f")
        kinds["mark"] += k * (c in ".,;:")
        kinds["shout"] += k * (c in "!?")
    total = max(1, len(t.text))
    p = np.fromiter(seen.values(), float, len(seen)) / total
    odd = sum(1 for w in t.words if not w[-1].isalnum() and w[-1] not in ".,;:!?\"')")
    return [
        math.log1p(n), math.log1p(t.word_chars / n if n else 0), math.log1p(float(lengths.std())), share(len(set(t.words)), n),
        share(t.n_symbols, chars), share(kinds["capital"], kinds["letter"]), share(kinds["digit"], chars), share(kinds["mark"], chars), share(kinds["shout"], chars),
        share(t.n_repeat_words, n), share(t.n_dup_lines, len(t.lines)), math.log1p(n / max(1, len(t.lines))), share(kinds["foreign"], total),
        float(-(p * np.log(p)).sum()) if len(p) else 0.0, share(odd, n),
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


#: The column of a document's statistics.
VECTOR = "_statistics"


def with_statistics(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the columns ``kept``, which don't leave the JVM, and the statistics of each text as one array."""

    of = column_of(lambda texts: [statistics(t) for t in texts], "array<double>", pa.list_(pa.float64()))
    return docs.select("doc_id", *(k for k in kept if k != "doc_id"), of("text").alias(VECTOR))


@dataclass
class Gaussian:
    mean: np.ndarray
    #: Cholesky factor of the covariance, its inverse, and the constant of the log density.
    factor: np.ndarray
    inverse: np.ndarray
    constant: float

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray) -> Gaussian:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, factor, np.linalg.inv(factor), -float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return self.constant - 0.5 * (z * z).sum(1)


@dataclass
class Discriminant:
    center: np.ndarray
    scale: np.ndarray
    low: Gaussian
    high: Gaussian
    slope: float = 1.0
    shift: float = 0.0

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Difference of the log densities, label 1 over label 0, per statistic."""
        z = np.clip((x - self.center) / self.scale, -12, 12)
        return (self.high.log_density(z) - self.low.log_density(z)) / len(self.center)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratio(x) + self.shift, -40, 40)))


#: Moments are summed as whole multiples of this, in two parts, so that the order of the sum changes no bit and no sum of rows overflows.
UNIT = 2.0**-40
LOW = 20


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Of each label: rows, sums, and sums of products."""
    d = len(STATISTICS)
    left, right = np.triu_indices(d)

    def make():
        def each(cols):
            out = {"quality": [], "at": [], "high": [], "low": []}
            label, x = np.asarray(cols[0]), np.asarray(cols[1], float)
            for k in np.unique(label).tolist():
                own = x[label == k]
                terms = np.concatenate([np.full((len(own), 1), UNIT), own, own[:, left] * own[:, right]], axis=1)
                total = np.rint(terms / UNIT).astype(np.int64).sum(0)
                for name, v in (("quality", [k] * len(total)), ("at", range(len(total))), ("high", (total >> LOW).tolist()), ("low", (total & ((1 << LOW) - 1)).tolist())):
                    out[name] += v
            return out

        return each

    parts = map_rows(rows.select("quality", VECTOR), make, StructType.fromDDL("quality int, at int, high long, low long"))
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("quality", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # a row for each label and sum
        found.setdefault(r.quality, {})[r["at"]] = (r.high << LOW) + r.low
    out = {}
    for k, sums in found.items():
        v = np.asarray([sums[i] * UNIT for i in range(1, len(sums))])
        m = np.zeros((d, d))
        m[left, right] = m[right, left] = v[d:]
        out[k] = (sums[0], v[:d], m)
    return out


def fit(rows: DataFrame, to_pooled: float = 0.3, to_identity: float = 0.05) -> Discriminant | None:
    """``rows``: the statistics and ``quality`` of the training rows. None where a class has no row."""
    by = moments(rows)
    if set(by) != {0, 1}:
        return None
    n = sum(b[0] for b in by.values())
    center = sum(b[1] for b in by.values()) / n
    spread = sum(b[2] for b in by.values()) / n - np.outer(center, center)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
    scale[scale < 1e-5] = 1.0
    own = {}
    for k, (rows_k, s, m) in by.items():
        mean = s / rows_k
        own[k] = ((mean - center) / scale, (m / rows_k - np.outer(mean, mean)) / np.outer(scale, scale), rows_k)
    pooled = sum(c * k for _, c, k in own.values()) / n
    d = len(center)

    def gaussian(mean, covariance, _):
        mixed = (1 - to_pooled) * covariance + to_pooled * pooled
        mixed = (1 - to_identity) * mixed + to_identity * max(np.trace(mixed) / d, 1e-6) * np.eye(d)
        return Gaussian.of(mean, mixed)

    model = Discriminant(center, scale, gaussian(*own[0]), gaussian(*own[1]))
    return calibrated(model, rows)


#: Equal steps of the squashed ratio in which training rows are counted for the logistic fit.
STEPS = 2000


def calibrated(model: Discriminant, rows: DataFrame) -> Discriminant:
    """Logistic fit of the labels on the ratio, from counts in a fixed number of steps."""

    def make():
        def each(cols):
            squashed = np.tanh(model.ratio(np.asarray(cols[1], float)) / 8)
            return {"quality": cols[0], "step": np.clip(np.round((squashed + 1) / 2 * STEPS), 1, STEPS - 1).astype(int).tolist()}

        return each

    counted = map_rows(rows.select("quality", VECTOR), make, StructType.fromDDL("quality int, step int")).groupBy("quality", "step").count().orderBy("quality", "step").collect()
    x = np.asarray([8 * np.arctanh(2 * r.step / STEPS - 1) for r in counted])
    y, w = np.asarray([float(r.quality) for r in counted]), np.asarray([float(r["count"]) for r in counted])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton, with a light pull on the slope
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        v = np.maximum(w * p * (1 - p), 1e-9)
        g = np.asarray([(w * (p - y) * x).sum() + 0.01 * a, (w * (p - y)).sum()])
        h = np.asarray([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, *kept: str) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each row of ``docs`` (doc_id, text), and its columns ``kept``.

    Kept columns go with their row from table to table, so no text is shuffled.
    """
    known, _ = write_table(with_statistics(docs, *kept), "statistics")
    taught = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")))
    model = fit(known.select("doc_id", VECTOR).join(taught, "doc_id"))

    scores = column_of(lambda vectors: model.score(np.asarray(vectors, float)).tolist() if model else [0.5] * len(vectors), "double", pa.float64())
    scored = known.withColumn(VECTOR, scores(VECTOR))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(VECTOR).alias("score"), (F.col(VECTOR) >= 0.5).cast("int").alias("predicted"), *(k for k in kept if k != "doc_id"))
