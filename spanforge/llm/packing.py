"""Bounded-space online packing of documents into sequences of a fixed length.

Each partition keeps ``open_windows`` windows. A document's full-length pieces
are sequences of their own; what remains goes where it leaves the least room,
and where it fits nowhere the fullest window is emitted and a new one opened.
At the end of each partition its open windows are merged with those of up to
``merge_partitions`` others in the same way, so the memory and the rows of any
task are bounded by these two numbers and not by the input.

A document's tokens are the ids of its text and an end id. Null and empty texts
have the end id alone. Repeated rows are packed each for itself; rows with the
same doc_id, or without one, stay apart by their sequences. An empty table gives no sequences.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import write_table
from .common import map_rows
from .tokens import encoded, encoder_of, tokenizer_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, fill long"


class Windows:
    """A fixed number of open windows of ``size`` ids."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.open: list[tuple[int, int]] = []  # room and window, the fullest first

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for ``length`` ids, best fit first."""
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if length < self.size and len(self.open) >= self.most:  # a full window stays not open
                self.open.pop(0)
            room, window = self.size, self.next
            self.next += 1
        if room > length:
            insort(self.open, (room - length, window))
        return window, self.size - room


def packer(path: str, end_id: int, size: int, most: int):
    from pyspark import TaskContext

    encoder = encoder_of(path)
    end = end_id.to_bytes(encoder.dtype.itemsize, "little")
    windows = Windows(size, most, TaskContext.get().partitionId() << 32)

    def each(cols: list) -> dict[str, list]:
        rows = []
        for doc, ids in zip(cols[0], encoded(cols[1], encoder), strict=True):
            ids = np.frombuffer(ids + end, encoder.dtype).astype("<u4")
            n = len(ids)
            for start in range(0, n, size):
                part = ids[start : start + size]
                rows.append((doc, start, len(part), zlib.crc32(part), n, *windows.place(len(part)), None))
        return dict(zip(COLUMNS, zip(*rows, strict=True), strict=True))

    def rest() -> dict[str, list]:
        k = len(windows.open)
        none = [None] * k
        return dict(zip(COLUMNS, [none, none, none, none, none, [w for _, w in windows.open], none, [size - room for room, _ in windows.open]], strict=True))

    return each, rest


COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    size: int = 4096,
    open_windows: int = 64,
    merge_partitions: int = 64,
) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``size`` ids.

    Returns a row for each piece of a document: doc_id, start (its document's
    ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    import pyarrow as pa

    path = tokenizer_path(tokenizer)
    schema = StructType.fromDDL(PIECES)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        as_batch = lambda got: pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
        each, rest = packer(path, end_id, size, open_windows)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                yield as_batch(each([c.to_pylist() for c in b.slice(at, 500).columns]))
        yield as_batch(rest())

    placed, _ = write_table(docs.select("doc_id", "text").mapInArrow(run, schema), "packing")
    left = placed.where("fill is not null").select("window", "fill")
    merged = merge(left, size, merge_partitions)
    pieces = placed.where("fill is null").drop("fill")
    return pieces.join(merged, "window", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("into", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def merge(left: DataFrame, size: int, partitions: int) -> DataFrame:
    """Best fit, longest first, of the windows that ``partitions`` partitions left open: (window, into, base)."""

    def best_fit(frame):
        frame = frame.sort_values(["fill", "window"], ascending=[False, True])
        room: list[tuple[int, int]] = []
        into, base = [], []
        for window, fill in zip(frame["window"].tolist(), frame["fill"].tolist(), strict=True):
            at = bisect_left(room, (fill, -1))
            free, target = room.pop(at) if at < len(room) else (size, window)
            into.append(target)
            base.append(size - free)
            if free > fill:
                insort(room, (free - fill, target))
        return frame[["window"]].assign(into=into, base=base)

    group = (F.shiftright("window", 32) / partitions).cast("long")
    return left.groupBy(group.alias("group")).applyInPandas(best_fit, "window long, into long, base long")
