"""K-mers and their equivalence classes.

A class holds the k-mers that complement, reversal or both make of one another,
as far as these are switched on; its canonical member has the least code in the
alphabet's order, and its id is that code read as a number.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import complement, revcomp
from .sequences import as_bytes, pieces, windows

#: Letters in code order, and the bases each stands for (fixed values).
ALPHABETS = {
    "nucleotide": {"a": "a", "c": "c", "g": "g", "t": "t"},
    "gapped": {"a": "a", "c": "c", "g": "g", "t": "t", "n": "acgt"},
    "ambiguous": {"a": "a", "c": "c", "g": "g", "t": "t", "w": "at", "s": "cg", "m": "ac", "k": "gt", "r": "ag", "y": "ct", "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt"},
}
PAIRS = {"a": "t", "c": "g", "g": "c", "t": "a"}
#: Longest k-mer whose code fits a machine word.
WORD = 31
#: Pieces of sequences that are counted at once.
AT_ONCE = 256
#: Starts of windows in a piece of a sequence, and entries of windows that are compared at once.
SPAN = 1 << 13
CELLS = 1 << 20
_CODE = np.full(256, -1, np.int8)
for _i, _letter in enumerate("acgt"):
    _CODE[[ord(_letter), ord(_letter.upper())]] = _i


@dataclass(frozen=True)
class Relation:
    """K-mers of ``n`` to ``m`` letters under the transforms that are switched on."""

    n: int
    m: int
    complement: bool = False
    reverse: bool = False
    revcomp: bool = True
    alphabet: str = "nucleotide"
    max_ambiguous: int | None = None

    @cached_property
    def bases(self) -> dict[str, str]:
        return ALPHABETS[self.alphabet]

    @cached_property
    def codes(self) -> dict[str, int]:
        return {c: i for i, c in enumerate(self.bases)}

    @cached_property
    def paired(self) -> dict[str, str]:
        by_bases = {frozenset(b): c for c, b in self.bases.items()}
        return {c: by_bases[frozenset(PAIRS[x] for x in b)] for c, b in self.bases.items()}

    @cached_property
    def matching(self) -> dict[str, str]:
        """For each plain base the letters that stand for it."""
        return {x: "".join(c for c, b in self.bases.items() if x in b) for x in "acgt"}

    def wildcard(self, c: str) -> bool:
        return len(self.bases[c]) == 4

    def comp(self, s: str) -> str:
        return "".join(self.paired[c] for c in s)

    def code(self, s: str) -> int:
        out = 0
        for c in s:
            out = out * len(self.bases) + self.codes[c]
        return out

    def canonical(self, s: str) -> str:
        ways = [s, *([self.comp(s)] if self.complement else []), *([s[::-1]] if self.reverse else []), *([self.comp(s)[::-1]] if self.revcomp else [])]
        return min(ways, key=self.code)

    def label(self, s: str) -> str:
        """Members in the order itself, complement, reverse, reverse complement, joined by bars."""
        c = self.canonical(s.lower())
        return "|".join([c, *([self.comp(c)] if self.complement else []), *([c[::-1]] if self.reverse else []), *([self.comp(c)[::-1]] if self.revcomp else [])])

    def generalized(self, s: str) -> list[str]:
        """Canonical members of all classes that match ``s``; wildcards stand at neither end."""
        letters = []
        for i, c in enumerate(s):
            own = self.matching[c]
            letters.append([x for x in own if not (self.wildcard(x) and i in (0, len(s) - 1))])
        return sorted({self.canonical("".join(x)) for x in itertools.product(*letters)}, key=self.code)

    def instances(self, s: str) -> list[str]:
        """Canonical members of the plain k-mers that ``s`` stands for."""
        return sorted({self.canonical("".join(x)) for x in itertools.product(*(self.bases[c] for c in s))}, key=self.code)

    def ambiguous(self, s: str) -> int:
        return sum(len(self.bases[c]) > 1 for c in s)

    def wildcards(self, s: str) -> int:
        return sum(map(self.wildcard, s))

    def rank(self, s: str) -> int:
        return max(0, len(s) - self.wildcards(s) - 1)

    def cluster(self, s: str) -> int:
        """Places without a wildcard as bits, the first lowest."""
        return sum(1 << i for i, c in enumerate(s) if not self.wildcard(c))

    def matches(self, a: str, b: str) -> bool:
        """Whether some member of a's class stands for a window of some member of b's."""
        if len(a) > len(b):
            return False
        stands = lambda x, y: all(set(self.bases[q]) <= set(self.bases[p]) for p, q in zip(x, y, strict=True))
        return any(stands(x, y[i : i + len(x)]) for x in self.label(a).split("|") for y in self.label(b).split("|") for i in range(len(y) - len(x) + 1))

    def enumerate(self, k: int) -> list[str]:
        return ["".join(x) for x in itertools.product(self.bases, repeat=k)]

    def cylinder(self, k: int, core: str, at: int) -> list[str]:
        """All k-mers with ``core`` at a place."""
        free = self.enumerate(k - len(core))
        return [x[:at] + core + x[at:] for x in free]


def canonical(kmer: Column, relation: Relation) -> Column:
    """Canonical member in expressions, for the four-letter alphabet, whose codes sort as its letters."""
    if relation.alphabet != "nucleotide":
        raise ValueError("only the four-letter alphabet sorts as text")
    s = F.lower(kmer)
    ways = [s, *([complement(s)] if relation.complement else []), *([F.reverse(s)] if relation.reverse else []), *([revcomp(s)] if relation.revcomp else [])]
    return F.least(*ways) if len(ways) > 1 else s


def class_label(canonical_kmer: Column, relation: Relation) -> Column:
    c = canonical_kmer
    return F.concat_ws("|", c, *([complement(c)] if relation.complement else []), *([F.reverse(c)] if relation.reverse else []), *([revcomp(c)] if relation.revcomp else []))


def _codes(raw: np.ndarray, k: int, relation: Relation | None = None) -> np.ndarray:
    """The code of the plain k-mer at each place of ``raw`` (of its class under ``relation``); -1 where another letter is in it."""
    base = _CODE[raw]
    n = max(0, len(base) - k + 1)
    ahead, back, bad = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(k):
        at, to = base[j : j + n], base[k - 1 - j : k - 1 - j + n]
        bad |= at < 0
        ahead *= 4
        ahead += at
        back *= 4
        back += to
    last = 4**k - 1
    ways = [ahead]
    if relation is not None:
        ways += [last - ahead] * relation.complement + [back] * relation.reverse + [last - back] * relation.revcomp
    out = ways[0]
    for w in ways[1:]:
        out = np.minimum(out, w)
    return np.where(bad, -1, out)


def _spelled(codes: np.ndarray, k: int) -> pa.Array:
    """Codes as text."""
    each, at = np.unique(codes, return_inverse=True)
    letters = np.frombuffer(b"acgt", np.uint8)[(each[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
    return pa.array(["" if not k else bytes(x).decode() for x in letters], pa.string()).take(pa.array(at.reshape(-1), pa.int64()))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, at = np.unique(keys, return_inverse=True)
    return each, np.bincount(at.reshape(-1), weights=counts, minlength=len(each)).astype(np.int64)


def _piece_counts(sequences: DataFrame, k: int, relation: Relation | None, only: list[int] | None = None) -> DataFrame:
    """(name, codes, counts) of each piece of a sequence that has any; ``only`` has the codes that are looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if only is None else np.array(only, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                texts = part.column(1).to_pylist()
                # a letter that is no base parts the sequences
                raw = np.frombuffer(b"-".join(texts), np.uint8)
                codes = _codes(raw, k, relation)
                at = np.flatnonzero(codes >= 0 if wanted is None else (codes >= 0) & np.isin(codes, wanted))
                ends = np.cumsum([len(t) + 1 for t in texts])
                owner, codes = np.searchsorted(ends, at, "right"), codes[at]
                kinds, codes = np.unique(codes, return_inverse=True)
                keys, n = np.unique(owner * max(1, len(kinds)) + codes.reshape(-1), return_counts=True)
                owner, codes = keys // max(1, len(kinds)), kinds[keys % max(1, len(kinds))] if len(kinds) else keys
                have = np.unique(owner)
                offsets = pa.array(np.append(np.searchsorted(owner, have), len(owner)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (codes, n)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(have, pa.int64())), *lists], ["name", "codes", "counts"])

    cut = pieces(sequences.select("name", "sequence"), k - 1).where(F.octet_length("sequence") >= k).select("name", "sequence")
    return cut.mapInArrow(run, f"name {cut.schema['name'].dataType.simpleString()}, codes array<long>, counts array<long>")


def _class_counts(sequences: DataFrame, k: int, relation: Relation, binary: bool) -> DataFrame:
    """(name, kmer, count) in the four-letter alphabet: only a list for each piece is dealt by name, and pieces of one name, side by side then, are added up."""
    dealt = _piece_counts(sequences, k, relation).repartition("name").sortWithinPartitions("name")

    def given(name: pa.Array, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([name, _spelled(codes, k), pa.array(np.ones_like(counts) if binary else counts, pa.int64())], ["name", "kmer", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last name so far with its codes and counts
        kind = None

        def whole(held):
            return given(pa.array([held[0]] * len(held[1]), kind), held[1], held[2])

        for batch in batches:
            kind = batch.schema.field(0).type
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                names = part.column(0).to_pylist()
                lengths = part.column(1).value_lengths().to_numpy()
                codes, counts = (part.column(i).flatten().to_numpy() for i in (1, 2))
                group = np.cumsum([0, *(a != b for a, b in zip(names, names[1:]))])
                owner = np.repeat(group, lengths)
                if group[-1] + 1 < len(names):
                    kinds, codes = np.unique(codes, return_inverse=True)
                    keys, counts = _summed(owner * len(kinds) + codes.reshape(-1), counts)
                    owner, codes = keys // len(kinds), kinds[keys % len(kinds)]
                heads = [names[i] for i in np.flatnonzero(np.diff(group, prepend=-1))]
                if held is not None:
                    if held[0] == heads[0]:
                        own = owner == 0
                        both = _summed(np.append(held[1], codes[own]), np.append(held[2], counts[own]))
                        rest = owner > 0
                        owner, codes, counts = np.append(np.zeros(len(both[0]), np.int64), owner[rest]), np.append(both[0], codes[rest]), np.append(both[1], counts[rest])
                    else:
                        yield whole(held)
                last = owner == len(heads) - 1
                held = heads[-1], codes[last], counts[last]
                done = ~last
                if done.any():
                    yield given(pa.array(heads, kind).take(pa.array(owner[done], pa.int64())), codes[done], counts[done])
        if held is not None:
            yield whole(held)

    return dealt.mapInArrow(run, f"name {dealt.schema['name'].dataType.simpleString()}, kmer string, count long")


def count_kmers(sequences: DataFrame, relation: Relation, binary: bool = False) -> DataFrame:
    """(name, k, kmer, count): canonical member of each class with its windows; windows with other letters are left out.

    Larger alphabets count every class that matches a window.
    """
    out = None
    for k in range(relation.n, relation.m + 1):
        if relation.alphabet == "nucleotide" and k <= WORD:
            counts = _class_counts(sequences, k, relation, binary).select("name", F.lit(k).alias("k"), "kmer", "count")
            out = counts if out is None else out.unionByName(counts)
            continue
        each = windows(sequences.select("name", "sequence"), k).withColumn("kmer", F.lower("kmer")).where(F.col("kmer").rlike("^[acgt]+$"))
        if relation.alphabet == "nucleotide":
            each = each.withColumn("kmer", canonical(F.col("kmer"), relation))
        else:
            each = each.groupBy("name", "kmer").agg(F.count("*").alias("_n"))
            each = each.withColumn("kmer", F.explode(_generalized(relation)("kmer")))
            if relation.max_ambiguous is not None:
                letters = "".join(c for c, b in relation.bases.items() if len(b) > 1)
                each = each.where(F.length(F.regexp_replace("kmer", f"[^{letters}]", "")) <= relation.max_ambiguous)
        n = F.sum("_n") if "_n" in each.columns else F.count("*")
        counts = each.groupBy("name", "kmer").agg((F.lit(1).cast("long") if binary else n).alias("count")).select("name", F.lit(k).alias("k"), "kmer", "count")
        out = counts if out is None else out.unionByName(counts)
    return out


def _generalized(relation: Relation):
    @F.pandas_udf("array<string>")
    def run(kmers: pd.Series) -> pd.Series:
        memo: dict[str, list[str]] = {}
        return kmers.map(lambda s: memo.setdefault(s, None) or memo.__setitem__(s, relation.generalized(s)) or memo[s])

    return run


def count_given(sequences: DataFrame, relation: Relation, kmers: list[str]) -> DataFrame:
    """(name, k, kmer, count) of the given classes alone, each for all plain k-mers that it stands for."""
    spark = sequences.sparkSession
    rows = sorted({(len(s), plain, relation.canonical(s.lower())) for s in kmers for plain in relation.instances(relation.canonical(s.lower()))})
    given = spark.createDataFrame(rows, "k int, plain string, kmer string")
    plain = Relation(relation.n, relation.m, relation.complement, relation.reverse, relation.revcomp)
    counts = None
    for k in range(relation.n, min(relation.m, WORD) + 1):
        # only what is asked for leaves a piece
        only = [(plain.code(p), p) for p in sorted({p for n, p, _ in rows if n == k})]
        named = F.element_at(F.create_map(*[F.lit(x) for pair in only for x in pair]), F.col("c.codes")) if 0 < len(only) <= 1000 else None
        if named is None:
            each = count_kmers(sequences, Relation(k, k, relation.complement, relation.reverse, relation.revcomp)) if only else None
        else:
            found = _piece_counts(sequences, k, plain, [c for c, _ in only])
            each = found.select("name", F.explode(F.arrays_zip("codes", "counts")).alias("c")).select("name", F.lit(k).alias("k"), named.alias("kmer"), F.col("c.counts").alias("count"))
        if each is not None:
            counts = each if counts is None else counts.unionByName(each)
    if relation.m > WORD:
        each = count_kmers(sequences, Relation(max(relation.n, WORD + 1), relation.m, relation.complement, relation.reverse, relation.revcomp))
        counts = each if counts is None else counts.unionByName(each)
    if counts is None:
        return sequences.where("false").select("name", F.lit(0).alias("k"), F.lit("").alias("kmer"), F.lit(0).cast("long").alias("count"))
    counts = counts.withColumnRenamed("kmer", "plain")
    met = counts.join(F.broadcast(given) if len(rows) <= 100_000 else given, ["k", "plain"])
    return met.groupBy("name", "k", "kmer").agg(F.sum("count").alias("count"))


def dense_counts(counts: DataFrame, names: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Every name with every class of the union, or of ``classes`` (k, kmer): absent ones count 0."""
    wanted = counts.select("k", "kmer").distinct() if classes is None else classes.select("k", "kmer").distinct()
    full = names.select("name").distinct().crossJoin(wanted)  # the dense table itself is asked for
    return full.join(counts, ["name", "k", "kmer"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def graph(spark, kmers: list[str], relation: Relation) -> tuple[DataFrame, DataFrame]:
    """Nodes (k, kmer, label, rank, cluster) and edges (kmer, contains) between neighbouring layers of ranks.

    Layers are joined on positions that can contain one another before their
    members are compared.
    """
    own = sorted({relation.canonical(s.lower()) for s in kmers}, key=lambda s: (len(s), relation.code(s)))
    rows = [(len(s), s, relation.label(s), relation.rank(s), relation.cluster(s)) for s in own]
    nodes = spark.createDataFrame(rows, "k int, kmer string, label string, rank int, cluster long")
    layers = {r: i for i, r in enumerate(sorted({x[3] for x in rows}))}
    layer = spark.createDataFrame(list(layers.items()), "rank int, layer int")
    placed = nodes.join(F.broadcast(layer), "rank")  # one row a rank
    upper, lower = (placed.select(F.col("layer").alias(f"{p}_layer"), F.col("k").alias(f"{p}_k"), F.col("kmer").alias(p)) for p in ("upper", "lower"))
    @F.pandas_udf("boolean")
    def contained(low: pd.Series, up: pd.Series) -> pd.Series:
        return pd.Series([relation.matches(a, b) for a, b in zip(low, up, strict=True)])

    pairs = upper.join(lower, (F.col("upper_layer") == F.col("lower_layer") + 1) & (F.col("lower_k") <= F.col("upper_k")))
    return nodes, pairs.where(contained("lower", "upper")).select("upper", "lower")


def similarities(sequences: DataFrame, reference: str, relation: Relation, measure: str = "cosine", step: int = -1, binary: bool = False) -> DataFrame:
    """(name, start, similarity) of windows as long as the reference.

    Starts are a step apart, one tenth of the reference by default; the last
    start leaves a step before the end.
    """
    length = len(reference)
    step = max(1, length // 10) if step == -1 else step
    x = _members(reference, relation)
    if binary:
        x = dict.fromkeys(x, 1)
    a, n = sum(v * v for v in x.values()), len(x)
    size = max(1, SPAN // step) * step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[int, int], list[int]] = {}
        ids: dict[tuple[int, str], int] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                texts, offset, total = part.column(1).to_pylist(), part.column(2).to_numpy(), part.column(3).to_numpy()
                raw = np.frombuffer(b"".join(texts), np.uint8)
                base = np.cumsum([0, *map(len, texts)])
                many = np.minimum(size // step, (total - length - step - offset) // step + 1)
                owner = np.repeat(np.arange(len(texts)), many)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                starts = base[owner] + nth * step
                layers = [_classes(raw, k, relation, x, memo, ids) for k in range(relation.n, min(relation.m, length) + 1)]
                wide = max(1, sum((length - k + 1) * of.shape[1] for k, of, _ in layers))
                chunk = max(1, CELLS // wide)
                for i in range(0, len(starts), chunk):
                    own = starts[i : i + chunk]
                    dot, b = np.zeros(len(own)), np.zeros(len(own))
                    for k, of, weight in layers:
                        got = of[own[:, None] + np.arange(length - k + 1)].reshape(len(own), -1)
                        got.sort(axis=1)
                        new = np.ones(got.shape, bool)
                        new[:, 1:] = got[:, 1:] != got[:, :-1]
                        if binary:
                            y = new & (got >= 0)
                            b += y.sum(axis=1)
                        else:
                            # the n-th of equal ones adds 2 n - 1 to the square of their number
                            at = np.arange(got.shape[1], dtype=np.int32)
                            y = got >= 0
                            b += np.where(y, 2 * (at - np.maximum.accumulate(np.where(new, at, 0), axis=1)) + 1, 0).sum(axis=1)
                        dot += np.where(y, weight[got], 0).sum(axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        value = {"cosine": lambda: dot / (np.sqrt(float(a)) * np.sqrt(b)), "tanimoto": lambda: dot / (a + b - dot), "dot-product": lambda: dot / n}[measure]()
                    names = part.column(0).take(pa.array(owner[i : i + chunk], pa.int64()))
                    start = pa.array((offset[owner[i : i + chunk]] + nth[i : i + chunk] * step).astype(np.int32), pa.int32())
                    yield pa.RecordBatch.from_arrays([names, start, pa.array(value, pa.float64(), mask=~np.isfinite(value))], ["name", "start", "similarity"])

    total = F.octet_length("sequence")
    own = sequences.select("name", as_bytes(F.col("sequence")).alias("sequence")).where(total >= length + step).withColumn("total", total.cast("long"))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - length - step, F.lit(size).cast("long")))
    cut = own.select("name", "sequence", places.alias("offset"), "total")
    cut = cut.select("name", F.substring(F.col("sequence"), (F.col("offset") + 1).cast("int"), F.lit(size + length - 1)).alias("sequence"), "offset", "total")
    return cut.mapInArrow(run, f"name {cut.schema['name'].dataType.simpleString()}, start int, similarity double")


def _members(text: str, relation: Relation) -> Counter:
    """(k, class) with its windows in a short text."""
    out: Counter = Counter()
    for k in range(relation.n, relation.m + 1):
        for i in range(len(text) - k + 1):
            s = text[i : i + k].lower()
            if set(s) <= set("acgt"):
                out.update((k, c) for c in _met(s, relation))
    return out


def _met(s: str, relation: Relation) -> list[str]:
    """The classes that a plain k-mer counts for."""
    if relation.alphabet == "nucleotide":
        return [relation.canonical(s)]
    return [c for c in relation.generalized(s) if relation.max_ambiguous is None or relation.ambiguous(c) <= relation.max_ambiguous]


def _classes(raw: np.ndarray, k: int, relation: Relation, x: dict, memo: dict, ids: dict) -> tuple[int, np.ndarray, np.ndarray]:
    """k, the numbers of the classes at each place as columns (-1 for none), and each number's count in the reference ``x``."""
    if k <= WORD:
        kinds, at = np.unique(_codes(raw, k), return_inverse=True)
        spelled = [None if c < 0 else s for c, s in zip(kinds, _spelled(np.maximum(kinds, 0), k).to_pylist(), strict=True)]
    else:
        text = raw.tobytes().decode("ascii").lower()
        kinds, at = np.unique([text[i : i + k] for i in range(max(0, len(text) - k + 1))], return_inverse=True)
        spelled = [str(s) if set(s) <= set("acgt") else None for s in kinds]
    lists = []
    for s in spelled:
        if s is not None and s not in memo:
            memo[s] = [ids.setdefault((k, c), len(ids)) for c in _met(s, relation)]
        lists.append([] if s is None else memo[s])
    table = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1, np.int64)
    for i, own in enumerate(lists):
        table[i, : len(own)] = own
    # numbers of this layer alone, so that they stay short
    used, short = np.unique(table, return_inverse=True)
    short = short.reshape(table.shape) - (1 if len(used) and used[0] < 0 else 0)
    kept = used[used >= 0]
    back = {ids_: key for key, ids_ in ids.items()} if len(kept) else {}
    weight = np.array([x.get(back[i], 0) for i in kept.tolist()] + [0], np.float64)
    return k, short.astype(np.int16 if len(kept) < 1 << 15 else np.int32)[at.reshape(-1)], weight
