"""A content-addressed store of token ids.

Writing. Each document's ids and an end id are cut into chunks where a rolling
hash over the last ``ROLL`` ids meets a mask, so equal passages give equal
chunks wherever they stand. A chunk is named by the BLAKE2 digest of its ids;
chunks are dealt out by name and kept once. A document is a recipe: its chunk
names and lengths, under a Merkle root. Recipes are sorted by doc_id over
range-partitioned segments, and the manifest has each segment's Merkle root,
its ids and the ids before it.

    chunks/     name, n_ids, ids (little-endian, 2 bytes below 65536 ids, else 4)
    documents/  segment, position, doc_id, before, n_tokens, names, lengths, root
    manifest/   segment, start, n_docs, n_tokens, root, width

Reading. ``read_back`` opens these files, recomputes the name and the CRC of
every stored chunk from its bytes, follows the recipes, and composes each
document's CRC from its chunks' (a CRC of a concatenation is a sum over GF(2)),
so that no document has to be gathered in one place. A document is verified when
its chunks' names and lengths hold, its Merkle root is that of its recipe, and
the recipes of its segment, in a row, give the root and the counts of the
manifest; none is where a whole segment lacks. ``reconstruct`` gives the ids.

Null and empty texts have the end id alone. Repeated rows are documents of
their own; rows with one doc_id stand together, ordered by root, those without one first. An empty table
gives an empty store. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import new_path, remove
from .common import map_rows, short_batches
from .tokens import UnitEncoder, encoded, encoder_of, forget, tokenizer_path

#: Ids under the rolling hash. Chunks are longer, so documents can be hashed in a row: no cut sees the one before.
ROLL = 12
NAME_BYTES = 16
#: Names that a task remembers in order not to send a chunk twice.
SEEN = 1_000_000


def meets(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places after which the hash of the last ROLL ids has zeros in its low ``bits``."""
    g = ids * np.uint32(0x9E3779B1)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x85EBCA77)
    h = g.copy()
    for j in range(1, min(ROLL, len(ids))):
        h[j:] += g[:-j] << np.uint32(2 * j)
    h ^= h >> np.uint32(16)
    return np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0) + 1


def cuts(met: list[int], n: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a document of ``n`` ids: where it was ``met``, ``least`` to ``most`` ids apart."""
    ends: list[int] = []
    last = 0
    for at in met:
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least and at < n:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    ends.append(n)
    return ends


def name_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=NAME_BYTES).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over ``leaves``; an odd node rises as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def document_root(names: bytes, ends: list[int]) -> str:
    """Merkle root over the names and lengths of a document's chunks."""
    return merkle([names[NAME_BYTES * i : NAME_BYTES * (i + 1)] + (b - a).to_bytes(8, "little", signed=True) for i, (a, b) in enumerate(zip([0, *ends], ends))]).hex()


def segment_leaves(doc_ids: list[int | None], n_tokens: list[int], roots: list[str]) -> list[bytes]:
    """What a segment's Merkle root holds of each of its documents."""
    return [f"{d} {n} {root}".encode() for d, n, root in zip(doc_ids, n_tokens, roots, strict=True)]


CUT = "kind string, name binary, n_ids long, ids binary, doc_id long, n_tokens long, names binary, ends array<int>, root string"
DOCUMENT = "kind string, position long, doc_id long, before long, n_tokens long, names binary, ends array<int>, root string, n_docs long"


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    cut_bits: int = 9,
    least: int = 64,
    most: int = 4096,
) -> str:
    """Writes ``docs`` (doc_id, text) as a store under ``path``, which all machines must reach."""
    spark = docs.sparkSession
    place = tokenizer_path(tokenizer)
    width = UnitEncoder(place).dtype.itemsize
    end = end_id.to_bytes(width, "little")
    schema = StructType.fromDDL(CUT)

    def cutter():
        encoder, seen = encoder_of(place), set()

        def each(cols):
            rows = []
            raw = list(encoded(cols[1], encoder))
            small = end.join([*raw, b""])
            to = np.cumsum([len(x) // width + 1 for x in raw])
            met = meets(np.frombuffer(small, encoder.dtype).astype(np.uint32), cut_bits)
            splits = np.searchsorted(met, to, "right").tolist()
            first = at = 0
            for doc, upto, split in zip(cols[0], to.tolist(), splits, strict=True):
                names, ends, last = [], [], 0
                for stop in cuts((met[at:split] - first).tolist(), upto - first, max(least, ROLL), most):
                    part = small[width * (first + last) : width * (first + stop)]
                    name = name_of(part)
                    names.append(name)
                    ends.append(stop)
                    if name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        rows.append(("chunks", name, stop - last, part, None, None, None, None, None))
                    last = stop
                listed = b"".join(names)
                rows.append(("recipes", None, None, None, doc, upto - first, listed, ends, document_root(listed, ends)))
                first, at = upto, split
            return dict(zip(schema.names, zip(*rows, strict=True), strict=True))

        return each

    def once(batches):
        forget()  # no task from here on tokenizes
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for kind, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(kind == "recipes" or name not in seen)
                if kind == "chunks":
                    seen.add(name)
            yield batch.filter(pa.array(keep, pa.bool_()))

    cut = map_rows(docs.select("doc_id", "text"), cutter, schema, tokenizes=True)
    dealt = cut.repartition(F.xxhash64("name", "doc_id", "root"))
    with short_batches(spark):
        dealt.mapInArrow(once, schema).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/dealt")

    recipes = spark.read.schema(schema).parquet(f"{path}/dealt").where("kind = 'recipes'").select("doc_id", "n_tokens", "names", "ends", "root")
    ordered = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    _segments(ordered).write.partitionBy("kind").parquet(f"{path}/ordered")
    _manifest(spark, path, width)
    return path


def _segments(ordered: DataFrame) -> DataFrame:
    """Numbers the rows of each sorted partition and ends it with the segment's own row."""
    schema = StructType.fromDDL("segment long, " + DOCUMENT)

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        forget()
        out = to_arrow_schema(schema)
        segment, position, before, leaves = TaskContext.get().partitionId(), 0, 0, []
        for b in batches:
            starts = []
            lengths = b.column("n_tokens").to_pylist()
            for n in lengths:
                starts.append(before)
                before += n
            k = b.num_rows
            leaves += segment_leaves(b.column("doc_id").to_pylist(), lengths, b.column("root").to_pylist())
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols |= {"segment": pa.array([segment] * k), "kind": pa.array(["documents"] * k), "position": pa.array(range(position, position + k)), "before": pa.array(starts, pa.int64()), "n_docs": pa.nulls(k, pa.int64())}
            position += k
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in out], schema=out)
        if position:
            row = {"segment": segment, "kind": "segments", "n_tokens": before, "root": merkle(leaves).hex(), "n_docs": position}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], type=f.type) for f in out], schema=out)

    return ordered.mapInArrow(run, schema)


def _manifest(spark: SparkSession, path: str, width: int) -> None:
    """One row for each segment, that is for each task that sorted recipes."""
    rows, start = [], 0
    for r in _ordered(spark, path).where("kind = 'segments'").select("segment", "n_docs", "n_tokens", "root").orderBy("segment").collect():
        rows.append((r.segment, start, r.n_docs, r.n_tokens, r.root, width))
        start += r.n_tokens
    schema = "segment long, start long, n_docs long, n_tokens long, root string, width int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/manifest")


def _ordered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("segment long, " + DOCUMENT).parquet(f"{path}/ordered")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Recipes in ascending doc_id order with ``start``, the ids of all documents before."""
    manifest = spark.read.parquet(f"{path}/manifest").select("segment", "start")
    # one manifest row for each task that sorted recipes, 16 bytes each
    own = _ordered(spark, path).where("kind = 'documents'").join(F.broadcast(manifest), "segment", "left")
    return own.select("segment", "position", "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "names", "ends", "root")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CUT).parquet(f"{path}/dealt").where("kind = 'chunks'").select("name", "n_ids", "ids")


#: Reversed polynomial of CRC-32 (a fixed value).
POLYNOMIAL = 0xEDB88320


@functools.cache
def _shift_tables(levels: int = 40) -> list[np.ndarray]:
    """For each k, what 2**k zero bytes after a message make of its CRC, by the CRC's four bytes."""
    basis = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    t = basis.copy()
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    tables = [t]
    for _ in range(levels - 1):
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


def _apply(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return t[0][crc & byte] ^ t[1][(crc >> np.uint32(8)) & byte] ^ t[2][(crc >> np.uint32(16)) & byte] ^ t[3][crc >> np.uint32(24)]


def crc_before(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each part's CRC adds to its message's where ``after`` bytes follow the part."""
    crc, tables = crc.astype(np.uint32), _shift_tables()
    for k in range(int(after.max(initial=0)).bit_length()):
        some = np.flatnonzero((after >> k) & 1)
        crc[some] = _apply(tables[k], crc[some])
    return crc


KEY = ["segment", "position", "doc_id", "start", "n_tokens", "n_parts", "root_holds"]


def parts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each document, with its length there and the ids that follow it."""
    @F.arrow_udf("string")
    def root_of(names: pa.Array, ends: pa.Array) -> pa.Array:
        forget()
        return pa.array(map(document_root, names.to_pylist(), ends.to_pylist()), pa.string())

    # roots come first, in a select of their own: beside the explosion they would be computed once for each chunk
    rooted = documents(spark, path).withColumns({"n_parts": F.size("ends"), "root_holds": root_of("names", "ends") == F.col("root")})
    own = rooted.select(*KEY, "names", F.posexplode("ends").alias("nth", "end"), "ends")
    length = F.col("end") - F.when(F.col("nth") > 0, F.expr("ends[nth - 1]")).otherwise(0)
    return own.select(*KEY, F.substring("names", F.col("nth") * NAME_BYTES + 1, F.lit(NAME_BYTES)).alias("name"), length.alias("length"), (F.col("n_tokens") - F.col("end")).alias("after"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """For each segment whether its recipes, in a row, give what the manifest says of it, and no segment lacks as a whole."""
    schema = "segment long, found_docs long, found_tokens long, found_root string, in_row boolean"

    def check(table: pa.Table) -> pa.Table:
        cols = table.sort_by("position").to_pydict()
        before = np.cumsum([0, *cols["n_tokens"]]).tolist()
        in_row = cols["position"] == list(range(table.num_rows)) and cols["before"] == before[:-1]
        root = merkle(segment_leaves(cols["doc_id"], cols["n_tokens"], cols["root"])).hex()
        return pa.table({"segment": cols["segment"][:1], "found_docs": [table.num_rows], "found_tokens": before[-1:], "found_root": [root], "in_row": [in_row]})

    # a segment is what one task has sorted and rooted, here without names and ends
    recipes = _ordered(spark, path).where("kind = 'documents'").select("segment", "position", "before", "doc_id", "n_tokens", "root")
    both = spark.read.parquet(f"{path}/manifest").join(recipes.groupBy("segment").applyInArrow(check, schema), "segment", "full_outer")
    # one row for each task that sorted recipes
    before = F.sum("n_tokens").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    there = F.min(F.expr("n_docs is not null and found_docs is not null")).over(Window.partitionBy())
    holds = F.expr("coalesce(in_row and found_docs = n_docs and found_tokens = n_tokens and found_root = root, false)")
    return both.select("segment", (holds & there & (F.col("start") == F.coalesce(before, F.lit(0)))).alias("segment_holds"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document from the store's files, and whether all its digests hold."""
    (width,) = {r.width for r in spark.read.parquet(f"{path}/manifest").select("width").distinct().collect()} or {2}

    def crcs():
        def each(cols):
            names, ids = cols
            return {
                "name": names,
                "crc": [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in ids],
                "n_ids": [len(x) // width for x in ids],
                "holds": [name_of(x) == n for x, n in zip(ids, names, strict=True)],
            }

        return each

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        forget()
        return pd.Series(crc_before(crc.to_numpy(np.int64), 4 * after.to_numpy(np.int64)).astype(np.int64))

    stored = chunks(spark, path).select("name", "ids")
    own = map_rows(stored, crcs, StructType.fromDDL("name binary, crc long, n_ids long, holds boolean"))
    met = parts(spark, path).join(own, "name", "left").select(*KEY, shifted(F.coalesce("crc", F.lit(0)), "after").alias("crc"), "n_ids", F.expr("coalesce(holds and n_ids = length, false)").alias("holds"))
    whole = met.groupBy(*KEY).agg(F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("n_met"), F.sum("n_ids").alias("n_ids"), F.min("holds").alias("holds"))
    verified = F.expr("coalesce(holds and root_holds and n_met = n_parts and n_ids = n_tokens and segment_holds, false)")
    return whole.join(F.broadcast(segments(spark, path)), "segment", "left").select("doc_id", "start", "n_tokens", "ids_crc32", verified.alias("verified"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (little-endian, as stored) of every document."""
    whole = parts(spark, path).join(chunks(spark, path).select("name", "ids"), "name").groupBy("segment", "position", "doc_id", "start")
    parted = whole.agg(F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("at"), "ids"))).alias("parts"))
    return parted.select("doc_id", "start", F.expr("aggregate(parts.ids, cast('' as binary), (a, x) -> a || x)").alias("ids"))


def token_store(docs: DataFrame, **options) -> DataFrame:
    """Writes a store into the shared folder and reads it back."""
    spark = docs.sparkSession
    return read_back(spark, write_store(docs, new_path(spark, "token-store"), **options))


def drop_store(spark: SparkSession, path: str) -> None:
    remove(spark, path)
