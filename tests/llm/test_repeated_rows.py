"""Operator 1 on tables whose rows are repeated, against brute force over the distinct rows."""

import numpy as np
from pyspark.sql import functions as F

from threadmill.llm import hnsw


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[1:6] = x[0]
    times = [30 if i < 3 else 2 if i % 2 else 15 for i in range(300)]
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(times[i])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in hnsw.nearest(table, F.col("vec_id") % 50 == 0, shard_rows=400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    d64 = x.astype(np.float64)
    for q in range(0, 300, 50):
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(300), d))[:10].tolist()
