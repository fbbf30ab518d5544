import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from lontar.llm import topk

ROWS = "vec_id long, embedding array<float>, score string, rank double"


def want(rows, k):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(q, tuple(a)) for q, a in ints if q % 100 == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints if i != q and len(b) == len(a))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("d, kind, block", [(16, "mixed", 2048), (3, "ties", 2), (64, "unit", 2048), (1, "mixed", 1)])
def test_against_all_products(spark, d, kind, block, monkeypatch):
    monkeypatch.setattr(topk, "SEED_ROWS", 20)
    r = random.Random(d)
    rows = []
    for i in range(700):
        v = [float(r.randint(-1, 1)) if kind == "ties" else r.gauss(0, 1) for _ in range(d)]
        scale = r.expovariate(1) if kind == "mixed" else 1 / max(1e-9, math.sqrt(sum(x * x for x in v))) if kind == "unit" else 1.0
        rows.append((i, [float(x * scale) for x in v]))
    rows = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]  # as 32-bit floats
    rows += [(800, None), (900, [float("nan")] * d), (1000, [None] * d), (1100, [float("inf")] * d), (None, [1.0] * d), (1200, [0.5]), (1201, [0.25]), rows[3], rows[200], (1300, [0.0] * d), (1400, [])]
    df = spark.createDataFrame([(*x, "clash", 0.5) for x in rows], ROWS).repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=10, query_block=block)
    assert sorted(tuple(x) for x in got.collect()) == want(rows, 10)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], "", 0.0), (1, [2.0], "", 0.0)], ROWS)
    assert [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert topk.top_k(df, F.col("vec_id") < 0).collect() == []


def test_bounds_prune_and_large_values():
    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.normal(size=(2000, 32)) * np.geomspace(8, 0.1, 32) * 1024).astype(np.int64)
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    search = topk.Search(np.arange(4), x[:4], turn, 10)
    exact = x @ x[:4].T
    least = np.sort(exact, axis=0)[-10].astype(float)
    row, query = search.pairs(x, least)
    found = set(zip(row.tolist(), query.tolist(), strict=True))
    assert found >= set(zip(*(a.tolist() for a in np.nonzero(exact >= least)), strict=True)) and len(found) < 2000
    big = np.array([[1 << 40, 1 << 40]])
    assert topk.exact(big, big).tolist() == [(1 << 63) - 1]
    assert topk.exact(np.array([[1 << 32, -3]]), np.array([[1 << 30, 7]])).tolist() == [(1 << 62) - 21]
