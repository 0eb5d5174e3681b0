import zlib

import numpy as np

from spanforge.llm import quality

D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    out = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    test = [r for r in out if r.held_out]
    good, bad = ([r.score for r in test if r.quality == q] for q in (1, 0))
    kept, caught = np.mean([s >= 0.5 for s in good]), np.mean([s < 0.5 for s in bad])
    order = np.argsort(np.argsort(good + bad))
    auc = (order[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / len(good) / len(bad)
    print(f"held out: kept {kept:.4f} of label 1, caught {caught:.4f} of label 0, area {auc:.4f}")
    assert kept > 0.97 and caught > 0.9 and auc > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_labels_of_held_out_rows_change_nothing(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_odd_rows_and_missing_classes(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 1), (3, 0, 0), (4, None, 0), (5, 1, 0), (7, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.score_quality(odd_docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.score_quality(no_docs, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_factor_gives_the_density():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4, 4))
    c, m, x = a @ a.T + np.eye(4), rng.normal(size=4), rng.normal(size=(5, 4))
    want = -0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    assert np.allclose(quality.Gaussian.of(m, c).log_density(x), want)


def test_scores_are_those_of_plain_moments(spark):
    """Scores computed anew from all training rows at once, and bit for bit the same from other partitions."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    again = {r.doc_id: r.score for r in quality.score_quality(docs.repartition(7), labels.repartition(3)).collect()}
    assert got == again

    texts = {r.doc_id: r.text for r in docs.collect()}
    x = {k: np.asarray(quality.statistics(t)) for k, t in texts.items()}
    taught = [(x[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in x and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    a, y = np.asarray([v for v, _ in taught]), np.asarray([q for _, q in taught])
    scale = a.std(0)
    scale[scale < 1e-5] = 1
    z = (a - a.mean(0)) / scale
    by = {q: z[y == q] for q in (0, 1)}
    cov = {q: np.cov(v.T, bias=True) for q, v in by.items()}
    pooled = sum(cov[q] * len(by[q]) for q in (0, 1)) / len(z)

    def log_density(v, q):
        c = 0.7 * cov[q] + 0.3 * pooled
        c = 0.95 * c + 0.05 * np.trace(c) / len(c) * np.eye(len(c))
        e = v - by[q].mean(0)
        return -0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e)

    ratio = lambda v: (log_density(v, 1) - log_density(v, 0)) / v.shape[1]
    r, s, t = ratio(np.clip(z, -12, 12)), 1.0, 0.0
    for _ in range(200):  # damped Newton on all rows, where the operator counts them in steps
        p = 1 / (1 + np.exp(-np.clip(s * r + t, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.asarray([((p - y) * r).sum() + 0.01 * s, (p - y).sum()])
        h = np.asarray([[(w * r * r).sum() + 0.01, (w * r).sum()], [(w * r).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        s, t = s - step[0], t - step[1]
    want = 1 / (1 + np.exp(-np.clip(s * ratio(np.clip((np.asarray(list(x.values())) - a.mean(0)) / scale, -12, 12)) + t, -40, 40)))
    assert max(abs(got[k] - w) for k, w in zip(x, want.tolist(), strict=True)) < 0.03
