"""Position weight matrices: scores of windows on both strands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import windows

PAIRS = {"a": "t", "c": "g", "g": "c", "t": "a"}


class Matrix:
    """Weights by base (a, c, g, t) and position; driver-side and small."""

    def __init__(self, values: dict[str, list[float]]):
        self.values = {b: list(map(float, values[b])) for b in "acgt"}

    def __len__(self) -> int:
        return len(self.values["a"])

    def get(self, base: str, j: int) -> float:
        return self.values[base.lower()][j]

    def reverse_complement(self) -> Matrix:
        return Matrix({PAIRS[b]: v[::-1] for b, v in self.values.items()})

    def score(self, sequence: str, reverse: bool = False, start: float = 0.0, f=lambda a, b: a + b) -> float:
        """Left fold over the positions; n counts for nothing."""
        if len(sequence) != len(self):
            raise ValueError("sequence has another length than the matrix")
        x = start
        for j in range(len(self)):
            c = sequence[len(self) - j - 1 if reverse else j].lower()
            if c != "n":
                x = f(x, self.get(PAIRS[c] if reverse else c, j))
        return x

    def rows(self) -> list[tuple[int, str, float, float]]:
        """(place in the window from 1, base, forward weight, reverse weight)."""
        n = len(self)
        return [(j + 1, b, self.values[b][j], self.values[PAIRS[b]][n - 1 - j]) for j in range(n) for b in "acgt"]


def _weight(window: Column, j: int, by_base: dict[str, float]) -> Column:
    c = F.substring(window, j, 1)
    out = F.when(c == "n", 0.0)
    for b, w in by_base.items():
        out = out.when(c == b, w)
    return out  # other letters give no score


def scores(sequences: DataFrame, matrix: Matrix) -> DataFrame:
    """(name, at, forward, reverse): the score of every window on both strands."""
    each = windows(sequences.select("name", "sequence"), len(matrix), "_w").withColumn("_w", F.lower("_w"))
    way: dict[int, tuple[dict, dict]] = {}
    for j, b, f, r in matrix.rows():
        way.setdefault(j, ({}, {}))[0][b] = f
        way[j][1][b] = r
    total = lambda k: sum((_weight(F.col("_w"), j, w[k]) for j, w in way.items()), F.lit(0.0))
    return each.select("name", "at", total(0).alias("forward"), total(1).alias("reverse"))


def max_scores(sequences: DataFrame, matrix: Matrix) -> DataFrame:
    """(name, forward, reverse, best); null where a sequence is shorter than the matrix."""
    best = scores(sequences, matrix).groupBy("name").agg(F.max("forward").alias("forward"), F.max("reverse").alias("reverse"))
    return sequences.select("name").join(best, "name", "left").withColumn("best", F.greatest("forward", "reverse"))


def mean_scores(sequences: DataFrame, matrix: Matrix, legacy_mean: bool = False) -> DataFrame:
    """Logarithm of the mean of exp(score), per strand and over both.

    ``legacy_mean`` starts the sum at exp(0) = 1, one term too many.
    """
    extra = 1.0 if legacy_mean else 0.0
    s = scores(sequences, matrix).groupBy("name").agg(F.sum(F.exp("forward")).alias("f"), F.sum(F.exp("reverse")).alias("r"), F.count("*").alias("n"))
    log = lambda v, n: F.ln(v) - F.ln(n)
    out = s.select("name", log(F.col("f") + extra, F.col("n")).alias("forward"), log(F.col("r") + extra, F.col("n")).alias("reverse"), log(F.col("f") + F.col("r") + extra, 2 * F.col("n")).alias("both"))
    return sequences.select("name").join(out, "name", "left")


def binned_scores(sequences: DataFrame, matrix: Matrix, bin_size: int, summary: str = "max") -> DataFrame:
    """(seqname, bin, value): mean, max, min or discrete mean of both strands' scores that start in each bin."""
    each = scores(sequences, matrix).select(F.col("name").alias("seqname"), F.floor(F.col("at") / bin_size).alias("bin"), F.explode(F.array("forward", "reverse")).alias("v"))
    agg = {"mean": F.avg("v"), "max": F.max("v"), "min": F.min("v"), "discrete mean": F.floor(F.avg("v")) + 0.5}[summary]
    return each.groupBy("seqname", "bin").agg(agg.cast("double").alias("value"))


def frequencies_to_weights(frequencies: list[list[float]], background: list[float], alpha: float = 0.0) -> list[list[float]]:
    """log2 of smoothed frequencies over the background, a row a position.

    A negative ``alpha`` adds pseudocounts in proportion to the background.
    """
    out = []
    for row in frequencies:
        p = smoothed(row, alpha) if alpha >= 0 else [(x - alpha * b) / (1 - alpha) for x, b in zip(row, background, strict=True)]
        out.append([math.log2(x / b) if x > 0 else -math.inf for x, b in zip(p, background, strict=True)])
    return out


def smoothed(row: list[float], alpha: float) -> list[float]:
    return [(x + alpha) / (1 + 4 * alpha) for x in row]
