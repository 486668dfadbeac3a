"""The language model's centroids and floors come from all training rows, and from whole texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from threadmill.llm import langid


def test_a_rare_kind_of_text_is_learned_whatever_its_share(spark):
    """2,400 rows, of which 1,500 were sampled before; the model and its floors must be those of all rows, in any order."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("the and morning market square people bread children weather".split()) for _ in range(rng.randint(4, 40))), "en") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.repartition(3), F.lit(True))
    moved = langid.fit(spark.createDataFrame([(i + 10**6, t, x) for i, t, x in rows], docs.schema).repartition(5, "text"), F.lit(True))  # other ids: another sample
    assert np.array_equal(model.idf, moved.idf) and model.languages == moved.languages
    assert np.array_equal(model.matrix, moved.matrix) and np.allclose(model.floor, moved.floor, atol=2 / 65536)


def test_one_cluster_is_the_mean_of_all_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abc defg hij klmno pq rstu".split()) for _ in range(rng.randint(3, 12))), "x") for i in range(1800)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), clusters=1)
    raw = [t.encode() for _, t, _ in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    x, half = model.vectors(langid.gram_counts(data, offsets)), langid._halves(data, offsets)
    for h in (0, 1):
        mean = x[half == h].mean(0)
        assert np.allclose(model.matrix[h], mean / np.linalg.norm(mean), atol=1e-4)


def test_pieces_cover_every_text_twice():
    rng = np.random.default_rng(2)
    sizes = [0, 3, 16, 31, 32, 100, 2000, 16384, 16385, 70_000]
    data, offsets = rng.integers(97, 123, sum(sizes)).astype(np.uint8), np.concatenate(([0], np.cumsum(sizes)))
    part, bounds, owner = langid.pieces(data, offsets)
    for d, size in enumerate(sizes):
        own = [part[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(owner == d)]
        text = data[offsets[d] : offsets[d + 1]].tobytes()
        if size < 16:
            assert not own
        else:
            assert own[-1] == text and b"".join(own[:-1]) == (text if size >= 32 else b"")
            top = min(int(np.log2(size / 16)), 9)
            assert {int(np.log2(len(p) / 16)) for p in own} >= set(range(top))
