"""bigWig files: indexed, compressed signal with zoom levels.

Reading hands whole files to tasks through Spark's own reader, so any store
will do; a query walks the index tree and inflates only blocks in its range.
Writing encodes blocks in the executors, and the driver, which alone knows the
offsets, strings them together with the trees.
"""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import ITEMS_PER_SLOT, level_sizes, statistics
from ..operators.track import Track, clean

# Magic numbers and sizes of the format (fixed values).
MAGIC, CHROM_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BEDGRAPH, VARIABLE, FIXED = 1, 2, 3
FANOUT = 256
HEADER = struct.Struct("<IHHQQQHHQQIQ")
ZOOM_HEADER = struct.Struct("<IIQQ")
SUMMARY = struct.Struct("<Qdddd")
SECTION = struct.Struct("<IIIIIBBH")
ZOOM_RECORD = struct.Struct("<IIIIffff")


class Reader:
    """A bigWig file in memory."""

    def __init__(self, raw: bytes):
        self.raw = raw
        h = HEADER.unpack_from(raw, 0)
        if h[0] != MAGIC:
            raise ValueError("no bigWig file")
        self.version, n, self.chrom_at, self.data_at, self.index_at = h[1], h[2], h[3], h[4], h[5]
        self.summary_at, self.buffer = h[9], h[10]
        self.zooms = [ZOOM_HEADER.unpack_from(raw, 64 + 24 * i) for i in range(n)]
        self.summary = SUMMARY.unpack_from(raw, self.summary_at) if self.summary_at else None
        self.chroms = sorted(self._chroms(), key=lambda c: c[1])

    def _chroms(self) -> list[tuple[str, int, int]]:
        magic, _, key, _, _, _ = struct.unpack_from("<IIIIQQ", self.raw, self.chrom_at)
        if magic != CHROM_MAGIC:
            raise ValueError("no chromosome tree")
        out, todo = [], [self.chrom_at + 32]
        while todo:
            at = todo.pop()
            leaf, _, n = struct.unpack_from("<BBH", self.raw, at)
            for i in range(n):
                p = at + 4 + i * (key + 8)
                if leaf:
                    number, length = struct.unpack_from("<II", self.raw, p + key)
                    out.append((self.raw[p : p + key].rstrip(b"\0").decode(), number, length))
                else:
                    todo.append(struct.unpack_from("<Q", self.raw, p + key)[0])
        return out

    def blocks(self, index_at: int, chrom: int, start: int, end: int) -> Iterator[bytes]:
        """Inflated blocks whose span meets [start, end) of a sequence."""
        todo = [index_at + 48]
        while todo:
            at = todo.pop()
            leaf, _, n = struct.unpack_from("<BBH", self.raw, at)
            size = 32 if leaf else 24
            later = []
            for i in range(n):
                c0, b0, c1, b1 = struct.unpack_from("<IIII", self.raw, at + 4 + i * size)
                if (c0, b0) >= (chrom, end) or (c1, b1) <= (chrom, start):
                    continue
                if leaf:
                    offset, length = struct.unpack_from("<QQ", self.raw, at + 20 + i * size)
                    block = self.raw[offset : offset + length]
                    yield zlib.decompress(block) if self.buffer else block
                else:
                    later.append(struct.unpack_from("<Q", self.raw, at + 20 + i * size)[0])
            todo += later[::-1]

    def records(self, chrom: int, start: int, end: int) -> Iterator[tuple[int, int, float, int]]:
        """(start, end, value, kind) of raw records that meet the range."""
        for b in self.blocks(self.index_at, chrom, start, end):
            c, first, _, step, span, kind, _, n = SECTION.unpack_from(b, 0)
            if c != chrom:
                continue
            if kind == FIXED:
                items = ((first + i * step, first + i * step + span, v) for i, v in enumerate(struct.unpack_from(f"<{n}f", b, 24)))
            elif kind == VARIABLE:
                items = ((p, p + span, v) for p, v in struct.iter_unpack("<If", b[24 : 24 + 8 * n]))
            else:
                items = struct.iter_unpack("<IIf", b[24 : 24 + 12 * n])
            yield from ((s, e, v, kind) for s, e, v in items if s < end and e > start)

    def zoom_records(self, level: int, chrom: int, start: int, end: int) -> Iterator[tuple]:
        """(start, end, valid, min, max, sum, sum_squares) at a zoom level."""
        at = next(z[3] for z in self.zooms if z[0] == level)
        for b in self.blocks(at, chrom, start, end):
            yield from (r[1:] for r in ZOOM_RECORD.iter_unpack(b) if r[0] == chrom and r[1] < end and r[2] > start)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    def run(frames):
        for f in frames:
            rows = [(n, length, i) for c in f["content"] for n, i, length in Reader(bytes(c)).chroms]
            yield pd.DataFrame(rows, columns=["seqname", "length", "ord"])

    return _files(spark, path).mapInPandas(run, "seqname string, length long, ord long").dropDuplicates(["seqname"])


def read_records(spark: SparkSession, path: str, seq_regex: str = ".*", start: int = 0, end: int = (1 << 31) - 1) -> DataFrame:
    """(seqname, start, end, value, kind) of raw records in the range of sequences whose whole name matches."""

    def run(frames):
        import re

        for f in frames:
            rows = []
            for c in f["content"]:
                r = Reader(bytes(c))
                for name, number, _ in r.chroms:
                    if re.fullmatch(seq_regex, name):
                        rows += [(name, *x) for x in r.records(number, start, end)]
            yield pd.DataFrame(rows, columns=["seqname", "start", "end", "value", "kind"])

    out = _files(spark, path).mapInPandas(run, "seqname string, start long, end long, value double, kind int")
    return out.withColumn("value", clean(F.col("value")))


def read_zoom(spark: SparkSession, path: str, level: int) -> DataFrame:
    def run(frames):
        for f in frames:
            rows = []
            for c in f["content"]:
                r = Reader(bytes(c))
                for name, number, length in r.chroms:
                    rows += [(name, *x) for x in r.zoom_records(level, number, 0, length + level)]
            yield pd.DataFrame(rows, columns=["seqname", "start", "end", "valid", "min", "max", "sum", "sum_squares"])

    return _files(spark, path).mapInPandas(run, "seqname string, start long, end long, valid double, min double, max double, sum double, sum_squares double")


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: version, zoom levels, sequences, and the file's summary."""

    def run(frames):
        for f in frames:
            rows = []
            for c in f["content"]:
                r = Reader(bytes(c))
                rows.append((r.version, [z[0] for z in r.zooms], len(r.chroms), *(r.summary or (0, None, None, None, None))))
            yield pd.DataFrame(rows, columns=["version", "levels", "sequences", "bases", "min", "max", "sum", "sum_squares"])

    return _files(spark, path).mapInPandas(run, "version int, levels array<long>, sequences long, bases long, min double, max double, sum double, sum_squares double")


def read_track(spark: SparkSession, path: str, bin_size: int = 0, f: str = "mean", init: float | None = None) -> Track:
    """A dense track; without a bin size the first record's width."""
    from ..operators.rollup import summary

    records = read_records(spark, path)
    if not bin_size:
        first = records.select((F.col("end") - F.col("start")).alias("w"), "kind").first()
        if first is None or first.kind == BEDGRAPH:
            raise ValueError("bin size can't be told")
        bin_size = first.w
    bins = F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size)))
    stats = statistics(records.select("seqname", bins.alias("bin"), "value"), ["seqname", "bin"])
    return Track.from_rows(stats.select("seqname", "bin", summary(f).alias("value")), read_genome(spark, path), bin_size, init=init)


# Writing --------------------------------------------------------------------


def _raw_blocks(number: int, bins: list[int], values: list[float], size: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, section) of runs of bins: fixed steps for long runs, else variable ones."""
    runs, at = [], 0
    for i in range(1, len(bins) + 1):
        if i == len(bins) or bins[i] != bins[i - 1] + 1:
            runs.append((at, i))
            at = i
    if len(runs) * 2 <= len(bins):
        for a, z in runs:
            for i in range(a, z, ITEMS_PER_SLOT):
                j = min(z, i + ITEMS_PER_SLOT)
                s, e = bins[i] * size, (bins[j - 1] + 1) * size
                yield s, e, SECTION.pack(number, s, e, size, size, FIXED, 0, j - i) + struct.pack(f"<{j - i}f", *values[i:j])
    else:
        for i in range(0, len(bins), ITEMS_PER_SLOT):
            j = min(len(bins), i + ITEMS_PER_SLOT)
            s, e = bins[i] * size, (bins[j - 1] + 1) * size
            yield s, e, SECTION.pack(number, s, e, size, size, VARIABLE, 0, j - i) + b"".join(struct.pack("<If", b * size, v) for b, v in zip(bins[i:j], values[i:j], strict=True))


def _zoom_record(*values) -> bytes:
    return ZOOM_RECORD.pack(*values)


def _tree(items: list[tuple[int, int, int, int, int]], at: int) -> bytes:
    """Index of blocks (sequence, start, end, offset, length), to stand at offset ``at``."""
    end = items[-1][3] + items[-1][4] if items else at
    span = (items[0][0], items[0][1], items[-1][0], max(i[2] for i in items if i[0] == items[-1][0])) if items else (0, 0, 0, 0)
    head = struct.pack("<IIQIIIIQII", INDEX_MAGIC, FANOUT, len(items), *span, end, ITEMS_PER_SLOT, 0)
    groups = [items[i : i + FANOUT] for i in range(0, len(items), FANOUT)] or [[]]
    cover = lambda g: (g[0][0], g[0][1], g[-1][0], max((x[2] for x in g if x[0] == g[-1][0]), default=0)) if g else (0, 0, 0, 0)
    levels = [[(cover(g), b"".join(struct.pack("<IIIIQQ", c, s, c, e, o, n) for c, s, e, o, n in g), len(g), 1) for g in groups]]
    while len(levels[-1]) > 1:
        below, above = levels[-1], []
        for i in range(0, len(below), FANOUT):
            g = below[i : i + FANOUT]
            above.append(((*g[0][0][:2], *g[-1][0][2:]), (i, len(g)), len(g), 0))
        levels.append(above)
    # children come after their parents, level by level
    sizes = [[4 + n * (32 if leaf else 24) for _, _, n, leaf in lv] for lv in levels]
    starts, pos = {}, at + 48
    for k in range(len(levels) - 1, -1, -1):
        for i, size in enumerate(sizes[k]):
            starts[k, i] = pos
            pos += size
    out = [head]
    for k in range(len(levels) - 1, -1, -1):
        for _, body, n, leaf in levels[k]:
            out.append(struct.pack("<BBH", leaf, 0, n))
            if leaf:
                out.append(body)
            else:
                first, count = body
                out += [struct.pack("<IIIIQ", *levels[k - 1][j][0], starts[k - 1, j]) for j in range(first, first + count)]
    return b"".join(out)


def write_track(track: Track, path: str, zooms: list[int] | None = None) -> None:
    """Writes a track with its genome; without ``zooms`` the levels follow the longest sequence.

    The file is made in a folder of the driver's own and then moved to ``path``
    by Spark's file systems, which make the folders above it.
    """
    spark = track.rows.sparkSession
    jvm = spark.sparkContext._jvm
    with tempfile.TemporaryDirectory(prefix="spanforge-") as own:
        made = os.path.join(own, "track.bw")
        _write(track, made, zooms)
        to = jvm.org.apache.hadoop.fs.Path(path)
        fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if to.getParent() is not None:
            fs.mkdirs(to.getParent())
        fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file:{made}"), to)


def _write(track: Track, path: str, zooms: list[int] | None) -> None:
    size = track.bin_size
    genome = [(r.seqname, r.length) for r in track.genome.select("seqname", "length").orderBy("seqname").collect()]
    numbers = {n: i for i, (n, _) in enumerate(genome)}
    levels = level_sizes(size, max((n for _, n in genome), default=0)) if zooms is None else sorted(zooms)

    def encode(key, frame):
        frame = frame.dropna(subset=["value"]).sort_values("bin")
        blocks = _raw_blocks(numbers[key[0]], frame["bin"].tolist(), frame["value"].tolist(), size)
        return pd.DataFrame([(numbers[key[0]], s, e, len(b), zlib.compress(b)) for s, e, b in blocks], columns=["chrom", "start", "end", "plain", "block"])

    def encode_zoom(level):
        def run(key, frame):
            number, rows = numbers[key[0]], frame.sort_values("bin").itertuples(index=False)
            recs = [(b.bin * level, (b.bin + 1) * level, _zoom_record(number, b.bin * level, (b.bin + 1) * level, int(b.valid), b.min, b.max, b.sum, b.sum_squares)) for b in rows]
            out = []
            for i in range(0, len(recs), ITEMS_PER_SLOT):
                g = recs[i : i + ITEMS_PER_SLOT]
                body = b"".join(x[2] for x in g)
                out.append((number, g[0][0], g[-1][1], len(body), zlib.compress(body)))
            return pd.DataFrame(out, columns=["chrom", "start", "end", "plain", "block"])

        return run

    schema = "chrom long, start long, end long, plain long, block binary"
    total = track.summary().first()
    with open(path, "wb") as f:
        f.write(b"\0" * (64 + 24 * len(levels)))
        summary_at = f.tell()
        f.write(SUMMARY.pack((total.valid or 0) * size, total.min or 0, total.max or 0, total["sum"] or 0, total.sum_squares or 0))
        chrom_at = f.tell()
        key = max((len(n.encode()) for n, _ in genome), default=1)
        f.write(struct.pack("<IIIIQQ", CHROM_MAGIC, max(1, len(genome)), key, 8, len(genome), 0) + struct.pack("<BBH", 1, 0, len(genome)))
        for n, length in genome:
            f.write(n.encode().ljust(key, b"\0") + struct.pack("<II", numbers[n], length))
        largest = 0

        def section(blocks: DataFrame, count: str) -> tuple[int, int]:
            nonlocal largest
            data_at, items = f.tell(), []
            f.write(struct.pack(count, 0))
            for r in blocks.orderBy("chrom", "start").toLocalIterator():
                items.append((r.chrom, r.start, r.end, f.tell(), len(r.block)))
                largest = max(largest, r.plain)
                f.write(r.block)
            index_at = f.tell()
            f.write(_tree(items, index_at))
            back = f.tell()
            f.seek(data_at)
            f.write(struct.pack(count, len(items)))
            f.seek(back)
            return data_at, index_at

        data_at, index_at = section(track.rows.groupBy("seqname").applyInPandas(encode, schema), "<Q")
        heads = []
        for level in levels:
            stats = statistics(track.rows, ["seqname", F.floor(F.col("bin") * size / level).cast("long").alias("bin")])
            heads.append((level, 0, *section(stats.groupBy("seqname").applyInPandas(encode_zoom(level), schema), "<I")))
        f.write(struct.pack("<I", MAGIC))
        f.seek(0)
        f.write(HEADER.pack(MAGIC, 4, len(levels), chrom_at, data_at, index_at, 0, 0, 0, summary_at, max(largest, 1), 0))
        for h in heads:
            f.write(ZOOM_HEADER.pack(*h))


def rename_sequences(track: Track, pattern: str, replacement: str) -> Track:
    """A track whose sequence names have every match of a pattern replaced."""
    new = F.regexp_replace("seqname", pattern, replacement)
    return Track(track.rows.withColumn("seqname", new), track.bin_size, track.genome.withColumn("seqname", new), track.name)
