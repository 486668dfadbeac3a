"""The quality model comes from all labelled rows and all pairs of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import quality


def test_all_labelled_rows_are_learned_from(spark):
    n = 21_000  # more than the 20,000 that were sampled before
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int")), F.when(F.col("id") % 3 == 0, "!!! ").otherwise(""), F.hex("id")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"))
    model = quality.fit(docs, labels, F.lit(True))
    texts = [r["text"].encode() for r in docs.orderBy("doc_id").collect()]
    x = quality.features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    local = quality.fit_ranking(x, (np.arange(n) % 3 != 0).astype(int))
    assert model.centre == pytest.approx(x.mean(0), rel=1e-6) and model.spread == pytest.approx(np.where(x.std(0) > 1e-9, x.std(0), 1), rel=1e-6)
    assert np.array_equal(model.weights, local.weights) and model.threshold == local.threshold and model.slope == local.slope
    turned = quality.fit(docs.repartition(7, "text"), labels.repartition(3), F.lit(True))
    assert np.array_equal(model.weights, turned.weights) and (model.threshold, model.slope) == (turned.threshold, turned.slope)


def test_all_pairs_and_the_exact_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] - 0.5 * x[:, 2] + rng.normal(size=600) * 0.5 > -0.8).astype(int)
    m = quality.fit_ranking(x, y)
    z = np.clip((x - m.centre) / m.spread, -5, 5)
    z = np.concatenate((z, z * z), axis=1)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 8)
    w, scale = np.zeros(8), 60_000 / len(d)
    for _ in range(20):
        p = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve(scale * (d * (p * (1 - p))[:, None]).T @ d + 5 * np.eye(8), 5 * w - scale * (p @ d))
    assert m.weights == pytest.approx(w, abs=2e-3)
    assert m.threshold == pytest.approx(np.quantile(z @ m.weights, np.mean(y == 0)), abs=1e-5)
