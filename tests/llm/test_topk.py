from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from peerglass.llm.topk import products, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    sound = [
        (n, i, [math.floor(256 * float(np.float32(x))) for x in v])
        for n, (i, v) in enumerate(rows)
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, q in sound:
        if i % every == 0:
            met = [(-sum(a * b for a, b in zip(q, c)), j) for m, j, c in sound if m != n and len(c) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(met)[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # ties
    rows += [(50, [0.5] * 6), (50, [0.5] * 6)]  # repeated ids
    rows += [(450, None), (500, []), (550, [None] * 6), (600, [float("nan")] * 6)]
    rows += [(None, [1.0] * 6), (700, [1.0, 2.0]), (701, [1.0, -2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    for size in (7, 64):
        got = top_k(df, F.col("vec_id") % 50 == 0, 5, block_rows=3, shard_rows=size, min_shards=4, fan_in=3)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5, 50)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    got = top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512)]
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert top_k(df, F.lit(False), 5).count() == 0


def test_products_beyond_doubles():
    q = np.array([[2.0**40, 3.0]])
    assert products(q, q).tolist() == [[2**63 - 1]]
    q = np.array([[2.0**30, 3.0]])
    assert products(q, q).tolist() == [[2**60 + 9]]
