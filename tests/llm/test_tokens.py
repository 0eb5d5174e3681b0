import gc
import os
import time
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.readwriter import DataFrameWriter
from tokenizers import Tokenizer

from spanforge.llm import packing, token_store, tokens
from spanforge.llm.tokens import UnitEncoder, tokenizer_path
from spanforge.shared import new_path

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
PLAIN = {n: Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}  # with the library's defaults
ENCODERS = {n: UnitEncoder(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=3000, deadline=None)
@given(text=st.lists(st.sampled_from([*" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　​ ̱́̇ab'sSlIHKZ0İıŉǅΣς½²٣$%|<>.!_\\\U0001f600字ßÄ", " alpha", " ALFÄ beta", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>"]), max_size=30).map("".join))
def test_units_give_the_ids_of_the_whole_text(name, text):
    e = ENCODERS[name]
    want = [np.asarray(PLAIN[name].encode(t, add_special_tokens=False).ids, e.dtype).tobytes() for t in (text, "a " + text)]
    assert e.encode([text, "a " + text]) == want


def ids_of(rows, name, end):
    tok = Tokenizer.from_file(tokenizer_path(name))
    return [(d, [*tok.encode(t or "", add_special_tokens=False).ids, end]) for d, t in rows]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_store_reads_back_every_document(spark):
    docs = spark.read.parquet(DOCUMENTS)
    want, start = {}, 0
    for d, ids in ids_of(sorted((r.doc_id, r.text) for r in docs.collect()), "byte_bpe_50k.json", 0):
        want[d] = (start, len(ids), crc(ids), True)
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.verified) for r in token_store.token_store(docs).collect()} == want


def test_store_of_odd_rows(spark, odd_docs):
    path = token_store.write_store(odd_docs, new_path(spark, "store"), cut_bits=5, least=8, most=64)
    rows = sorted((r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id != 2) + [(2, None)]
    want = defaultdict(list)
    for d, ids in ids_of(rows, "byte_bpe_50k.json", 0):
        want[d].append(crc(ids))
    got = defaultdict(list)
    for r in token_store.read_back(spark, path).orderBy("start").collect():
        assert r.verified
        got[r.doc_id].append(r.ids_crc32)
    assert got == want
    again = defaultdict(list)
    for r in token_store.reconstruct(spark, path).collect():
        again[r.doc_id].append(crc(np.frombuffer(r.ids, "<u2")))
    assert again == want
    stored = token_store.chunks(spark, path)
    assert stored.count() == stored.select("name").distinct().count()


def test_store_notices_a_changed_chunk(spark, odd_docs, tmp_path):
    path = token_store.write_store(odd_docs, new_path(spark, "store"))
    names = token_store.chunks(spark, path).count()
    rows = [("chunks", bytes(r.name), r.n_ids, bytes(r.ids[:-1]) + b"\x01" if r.n_ids > 300 else bytes(r.ids)) for r in token_store.chunks(spark, path).collect()]
    assert len(rows) == names
    kept = spark.read.schema(token_store.CUT).parquet(f"{path}/dealt").where("kind = 'recipes'").select(*(c.split()[0] for c in token_store.CUT.split(", "))).collect()
    spark.createDataFrame(kept, token_store.CUT).unionByName(
        spark.createDataFrame(rows, "kind string, name binary, n_ids long, ids binary"), allowMissingColumns=True
    ).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/dealt")
    held = {r.doc_id: r.verified for r in token_store.read_back(spark, path).collect()}
    assert held[5] is False and held[1] is True


@pytest.mark.parametrize("damage", ["none", "removed", "swapped", "renamed", "lengths", "segment"])
def test_store_notices_changed_recipes(spark, damage):
    docs = spark.createDataFrame([(i, f"text {i} of a few words " * (i + 1)) for i in range(40)], "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several segments
    try:
        path = token_store.write_store(docs, new_path(spark, "store"), cut_bits=2, least=12, most=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = spark.read.schema("segment long, " + token_store.DOCUMENT).parquet(f"{path}/ordered")
    rows = [r.asDict() for r in table.orderBy("segment", "position").collect()]
    recipes = [r for r in rows if r["kind"] == "documents"]
    assert len({r["segment"] for r in recipes}) > 2
    a, b = [r for r in recipes if r["segment"] == recipes[-1]["segment"]][:2]
    if damage == "removed":
        rows.remove(a)
    elif damage == "swapped":  # each with its own root, and the places still follow each other
        for k in ("names", "ends", "root", "n_tokens"):
            a[k], b[k] = b[k], a[k]
        b["before"] = a["before"] + a["n_tokens"]
    elif damage == "renamed":
        a["doc_id"], b["doc_id"] = b["doc_id"], a["doc_id"]
    elif damage == "lengths":
        a["n_tokens"] += 1
    elif damage == "segment":
        rows = [r for r in rows if r["segment"] != a["segment"]]
    damaged = {r["doc_id"] for r in recipes if damage == "segment" or damage != "none" and r["segment"] == a["segment"]}
    spark.createDataFrame(rows, table.schema).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/ordered")
    held = {r.doc_id: r.verified for r in token_store.read_back(spark, path).collect()}
    assert held == {r["doc_id"]: r["doc_id"] not in damaged for r in rows if r["kind"] == "documents"}


def test_a_root_is_recomputed_once_a_document(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}x{i % 7}" for i in range(3000)))], "doc_id long, text string")
    path = token_store.write_store(docs, new_path(spark, "store"), cut_bits=3, least=12, most=32)
    parts = token_store.parts(spark, path)
    assert parts.count() > 200 and parts.select("root_holds").distinct().collect() == [(True,)]
    plan = parts._jdf.queryExecution().optimizedPlan().toString()  # what is printed below runs before
    assert plan.index("Generate") < plan.index("EvalPython")


def test_an_encoder_forgotten_is_freed():
    place = tokenizer_path("byte_bpe_50k.json")
    freed = []
    weakref.finalize(tokens.encoder_of(place), freed.append, 1)
    gc.disable()  # an encoder and its memory refer to each other
    try:
        tokens.forget()
        assert freed
    finally:
        gc.enable()


def test_tasks_after_the_tokenizing_one_forget_its_tokens(spark):
    def probe(batches):
        list(batches)
        time.sleep(0.05)
        yield pd.DataFrame({"pid": [os.getpid()], "encoders": [len(tokens._encoders)]})
        tokens.forget()

    def workers():
        return spark.range(0, 64, 1, 64).mapInPandas(probe, "pid long, encoders long").collect()

    workers()  # what other tests left
    docs = spark.createDataFrame([(i, f"text {i} of a few words " * 20) for i in range(40)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert all(r.verified for r in token_store.token_store(docs).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert not [r for r in workers() if r.encoders]


def test_the_store_is_written_in_short_batches(spark, odd_docs, monkeypatch):
    limit, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a: (seen.append((path.rsplit("/", 1)[1], int(spark.conf.get(limit)))), write(self, path, *a))[1])
    before = spark.conf.get(limit)
    path = token_store.write_store(odd_docs, new_path(spark, "store"))
    assert dict(seen)["dealt"] <= 500 and spark.conf.get(limit) == before
    assert all(r.verified for r in token_store.read_back(spark, path).collect())


def test_empty_store(spark, no_docs):
    assert token_store.token_store(no_docs).count() == 0
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("options", [{}, {"open_windows": 2, "merge_partitions": 2}])
def test_packing_keeps_every_id_once(odd_docs, options):
    out = packing.pack(odd_docs, **options).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted((d, len(ids), s, crc(ids[s : s + 4096])) for d, ids in ids_of(rows, "word_bpe_49k.json", 2) for s in range(0, len(ids), 4096))
    assert sorted((r.doc_id, r.doc_tokens, r.start, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_pads_little(spark):
    out = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    used = sum(r.length for r in out)
    assert used / 4096 / len({r.sequence_id for r in out}) > 0.98


def test_windows_emit_the_fullest():
    w = packing.Windows(10, 2, 0)
    assert [w.place(n) for n in (6, 7, 3, 5, 4, 9)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (3, 0)]
    assert sorted(w.open) == [(1, 3), (5, 2)]


def test_full_pieces_close_no_window():
    w = packing.Windows(10, 2, 0)
    w.place(4), w.place(7)
    assert w.place(10) == (2, 0) and len(w.open) == 2
    assert w.place(6) == (0, 4)


def test_rows_without_ids(spark):
    rows = [(None, "a text without an id"), (None, None), (None, "a text without an id"), (3, "and one with it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted((d, len(ids), crc(ids)) for d, ids in ids_of([(d or -1, t) for d, t in rows], "byte_bpe_50k.json", 0))
    stored = token_store.token_store(docs).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in stored) == want and all(r.verified for r in stored)
    assert sorted(r.start for r in stored)[0] == 0 and max(stored, key=lambda r: r.start).doc_id == 3
    want = sorted((d, len(ids), crc(ids)) for d, ids in ids_of([(d or -1, t) for d, t in rows], "word_bpe_49k.json", 2))
    assert sorted((r.doc_id or -1, r.doc_tokens, r.ids_crc32) for r in packing.pack(docs).collect()) == want
