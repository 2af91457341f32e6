"""Toxicity: gradients, windows and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofcast.llm import toxicity as t
from proofcast.llm.common import held_out

SF = "/root/testdata/sf0.1"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in t._fresh(rng).items()}
    x, y = rng.normal(size=(5, 3, 2 * t.WIDTH)), np.array([1.0, 0, 1])
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = False

    def loss(x):
        states = np.concatenate([t._layer(p, d, x @ p[f"W{d}"] + p[f"b{d}"], mask, None).astype(float) for d in "fb"], axis=2)
        s = t.sigmoid(t._pool(p, states, mask)[0])
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g, dx = t._gradients(p, x, mask, y)
    for name in ("Uf", "Ub", "Wf", "Wb", "bf", "A", "c", "v", "w", "o"):
        flat = p[name].ravel()
        i = len(flat) // 2
        old = flat[i]
        flat[i] = old + 1e-2
        above = loss(x)
        flat[i] = old - 1e-2
        below = loss(x)
        flat[i] = old
        assert np.ravel(g[name])[i] == pytest.approx((above - below) / 2e-2, rel=2e-2, abs=1e-5)
    near = x.copy()
    near[2, 0, 3] += 1e-2
    assert dx[2, 0, 3] == pytest.approx((loss(near) - loss(x)) / 1e-2, rel=5e-2, abs=1e-5)


def test_windows_cover_all_words_and_overlap():
    for n in (0, 1, t.LENGTH, t.LENGTH + 1, 333):
        starts = t.starts_of(n).tolist()
        covered = {w for s in starts for w in range(s, min(s + t.LENGTH, n))}
        assert covered == set(range(n))
        assert all(b - a <= t.STEP for a, b in zip(starts, starts[1:], strict=False))


def test_batches_do_not_change_scores():
    model = t.ToxicityModel(t._fresh(np.random.default_rng(3)))
    texts = ["a few words", "one two three " * 40, "", "x", "many words of all kinds " * 300]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([x])[0] for x in texts], atol=1e-5)
    assert together[2] == 0.0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = t.fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    rows = docs.join(labels, "doc_id").where(held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    rows = rows.select("toxic", t.toxicity(F.col("text"), model).alias("s")).collect()
    toxic, clean = [r["s"] for r in rows if r["toxic"]], [r["s"] for r in rows if not r["toxic"]]
    assert len(toxic) > 50
    assert np.mean([s >= 0.3 for s in toxic]) > 0.85
    assert np.mean([s < 0.3 for s in clean]) > 0.95


def test_odd_texts_and_no_labels(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = docs_of([(1, None), (2, ""), (3, "!!"), (None, "word"), (4, "w" * 300000), (4, "w" * 300000)])
    got = docs.select("doc_id", t.toxicity(F.col("text"), t.fit_toxicity(docs, labels)).alias("s")).collect()
    assert len(got) == 6 and all(0 <= r["s"] < 0.3 for r in got)
