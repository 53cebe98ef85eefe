import zlib

import messy
import numpy as np
import pyarrow as pa
import pytest
from cartograph.llm import quality, toxicity
from cartograph.llm.common import read_table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize("module, column, threshold", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out_accuracy(spark, module, column, threshold):
    larger = SF.replace("0.01", "0.1")
    docs, labels = read_table(spark, larger, "documents"), read_table(spark, larger, "labels")
    out = module.classify(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    score, said, label = (np.array(c) for c in zip(*held))
    assert auc(score, label) > 0.95
    assert (said == label).mean() > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_the_held_out_fold_are_not_read(spark, module):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", *[
        f"CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic")])
    a = {r["doc_id"]: r["score"] for r in module.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in module.classify(docs, flipped).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_messy_rows_are_scored(spark, module):
    docs = messy.frame(spark)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, 1, 1), (None, 1, 1), (2, None, None), (3, 1, 0), (5, 1, 1), (6, 0, 0), (6, 0, 0)],
                                   "doc_id bigint, quality int, toxic int")
    rows = module.classify(docs, labels).collect()
    assert len(rows) == len(messy.rows())
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert module.classify(messy.empty(spark), labels).collect() == []
    no_labels = labels.where("false")
    assert {r["score"] for r in module.classify(docs, no_labels).collect()} == {0.5}


def test_accepted_keeps_columns(spark):
    docs = messy.frame(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    out = quality.accepted(docs, labels)
    assert out.schema.names == docs.schema.names


def test_prior_is_estimated_from_the_two_samples():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 6000)
    for share in (0.3, 0.6, 0.9):
        n = int(6000 * share)
        unlabelled = np.concatenate([rng.normal(2, 1, n), rng.normal(-3, 1, 6000 - n)])
        assert abs(quality.estimate_prior(positive, unlabelled) - share) < 0.05


def plain_risk(w, x_p, x_u, prior):
    """The two parts of the risk, row by row."""
    loss = lambda z: (1 - z) ** 2 / 4
    return prior * loss(x_p @ w).mean(), loss(-(x_u @ w)).mean() - prior * loss(-(x_p @ w)).mean()


def test_risk_and_gradient_equal_the_plain_ones():
    rng = np.random.default_rng(6)
    x_p, x_u = (np.hstack([rng.normal(m, 1, (n, 5)), np.ones((n, 1))]) for m, n in ((1, 40), (0, 90)))
    given = [quality.mean_moments(x.T @ x) for x in (x_p, x_u)]
    flat = (*given[0], *given[1], 0.4)
    w = rng.normal(0, 1, 6)
    assert np.allclose(quality.risk(w, *flat), plain_risk(w, x_p, x_u, 0.4))
    for part, gradient in enumerate(quality.risk_gradient(w, *flat)):
        numeric = [(plain_risk(w + e, x_p, x_u, 0.4)[part] - plain_risk(w - e, x_p, x_u, 0.4)[part]) / 2e-5
                   for e in np.eye(6) * 1e-5]
        assert np.allclose(gradient, numeric, atol=1e-6)


def test_non_negative_risk_is_not_below_that_of_any_simple_change():
    rng = np.random.default_rng(7)
    x_p = np.hstack([rng.normal(1, 1, (8, 30)), np.ones((8, 1))])          # few rows: the unbiased risk turns negative
    x_u = np.hstack([rng.normal(.5, 1, (30, 30)), np.ones((30, 1))])
    given = [quality.mean_moments(x.T @ x) for x in (x_p, x_u)]
    total = lambda w: (lambda a, b: a + max(b, 0))(*quality.risk(w, *given[0], *given[1], 0.7))
    start = np.linalg.solve(given[1][1] / 2 + quality.DECAY * np.eye(31), 0.7 * given[0][0] - given[1][0] / 2)
    assert quality.risk(start, *given[0], *given[1], 0.7)[1] < 0
    assert total(quality.fit_nnpu(*given, 0.7)) <= total(start) + 1e-9


def test_moments_cover_every_row(spark):
    docs = read_table(spark, SF, "documents").select("text", F.expr("doc_id % 3 = 0").alias("is_p"), F.expr("cast(doc_id % 2 as int)").alias("half"))
    mean, dev = quality.spread_of(docs)
    rows = docs.collect()
    x = quality.features(pa.array([r["text"] for r in rows])).astype(float)
    assert np.allclose(mean, x.mean(axis=0), atol=1e-6)
    z = quality.normal(pa.array([r["text"] for r in rows]), mean, dev).astype(float)
    for h, part in enumerate(quality.moments(docs.repartition(7), mean, dev)):
        here = np.array([r["half"] == h for r in rows])
        good = here & np.array([r["is_p"] for r in rows])
        assert np.allclose(part["u"], z[here].T @ z[here], rtol=1e-3, atol=1e-1)
        assert np.allclose(part["p"], z[good].T @ z[good], rtol=1e-3, atol=1e-1)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_an_id_with_a_third_of_all_rows(spark, module):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    hot = [r["doc_id"] for r in labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0 AND quality = 1").orderBy("doc_id").take(1)][0]
    more = docs.unionByName(docs.limit(500).withColumn("doc_id", F.lit(hot).cast("bigint")))
    rows = module.classify(more, labels).collect()
    assert len(rows) == more.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_log_count_ratios_equal_plain_counts():
    texts = pa.array(["you fool", "nice day", "fool fool"])
    doc, code = toxicity.grams(texts)
    for i, t in enumerate(texts.to_pylist()):
        spaced = f" {t} "
        plain = {spaced[k:k + n] for n in toxicity.ORDERS for k in range(len(spaced) - n + 1)}
        assert (doc == i).sum() == len(plain)          # every distinct n-gram once (no hash collision among so few)


def test_features_do_not_depend_on_chunks(monkeypatch):
    from cartograph.llm import chars

    texts = pa.array([t for _, t, *_ in messy.rows()])
    whole, pairs = quality.features(texts), toxicity.grams(texts)
    small = lambda raw, offsets, overlap, size=0: chars_chunks(raw, offsets, overlap, 977)
    chars_chunks = chars.chunks
    monkeypatch.setattr(chars, "chunks", small)
    assert np.array_equal(whole, quality.features(texts))
    for a, b in zip(pairs, toxicity.grams(texts)):
        assert np.array_equal(a, b)
