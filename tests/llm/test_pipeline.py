from collections import Counter

import corpus_pipeline
from spanforge.llm import pii, quality
from tests.llm import test_jaccard, test_tokens, test_winnow

D = "/root/testdata/sf0.01"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out, _ = corpus_pipeline.write_table(stage(spark, docs, D), name)
        if name == "packing":
            want = [(d, len(ids), s, test_tokens.crc(ids[s : s + 4096])) for d, ids in test_tokens.ids_of([(r.doc_id, r.text) for r in rows.values()], "word_bpe_49k.json", 2) for s in range(0, len(ids), 4096)]
            assert sorted((r.doc_id, r.doc_tokens, r.start, r.ids_crc32) for r in out.collect()) == sorted(want)
            break
        assert out.columns == columns
        kept = {r.doc_id: r for r in out.collect()}
        assert len(kept) == out.count() and kept.keys() <= rows.keys()
        pairs = [(d, r.text) for d, r in rows.items()]
        if name == "quality":
            scores = quality.score_quality(docs, spark.read.parquet(f"{D}/labels.parquet")).collect()
            assert kept.keys() == {r.doc_id for r in scores if r.predicted} and len(kept) < len(rows)
        elif name == "near_duplicates":
            groups = Counter(c for _, _, c in test_jaccard.brute(pairs))
            assert kept.keys() == groups.keys() and len(kept) < len(rows)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            assert kept.keys() == {x[0] for x in test_winnow.brute(pairs, items) if not x[-1]} and len(kept) < len(rows)
        else:
            changed = 0
            for d, r in kept.items():
                spans = pii.model().spans(rows[d].text)[1]
                changed += bool(spans)
                assert (r.text == rows[d].text) == (not spans) and r.n_chars == len(r.text) and not pii.base_spans(r.text)
            assert kept.keys() == rows.keys() and changed
        docs, rows = out, kept


def test_odd_rows_and_empty(spark, odd_docs, no_docs):
    named = odd_docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars").union(no_docs)
    more = named.union(spark.createDataFrame([(None, "a document without a name " * 9, "en", "s", 1)], named.schema))
    for docs in (more, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs, _ = corpus_pipeline.write_table(stage(spark, docs, "/root/testdata/sf0.001"), "odd")


def test_rows_are_judged_each_for_itself(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").collect() if r.item_id is not None and len((r.text or "").split()) > 12)
    scores = quality.score_quality(docs, spark.read.parquet(f"{D}/labels.parquet"))
    good, bad = ([r.text for r in docs.join(scores.where(f"predicted = {p}"), "doc_id").orderBy("doc_id").limit(2).collect()] for p in (1, 0))
    clean = [f"{w} " + " ".join(f"{w}{i}" for i in range(60)) for w in ("oak", "elm", "ash")]

    def kept(stage, rows):
        out = stage(spark, spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], docs.schema), D)
        return sorted(((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()), key=str)

    for d in (None, -1):
        assert kept(lambda s, x, p: corpus_pipeline.quality(s, docs.unionByName(x), p).where("doc_id <=> " + ("null" if d is None else "-1")), [(d, good[0]), (d, bad[0]), (d, good[1])]) == sorted([(d, good[0]), (d, good[1])], key=str)
        assert kept(corpus_pipeline.decontamination, [(d, clean[0]), (d, clean[1] + " " + item), (d, clean[2])]) == sorted([(d, clean[0]), (d, clean[2])], key=str)
        assert kept(corpus_pipeline.near_duplicates, [(d, clean[0]), (d, clean[0]), (d, clean[0] + " x"), (7, clean[1]), (d, clean[1]), (d, clean[2])]) in (
            sorted([(d, first), (min(d or 7, 7), clean[1]), (d, clean[2])], key=str) for first in (clean[0], clean[0] + " x")
        )


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").where("doc_id is null").count() == 0
