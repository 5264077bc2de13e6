"""Exact search against plain loops over Python's integers."""

import math

import numpy as np
import pytest

from corpusloom.llm import exact_search

SCHEMA = "vec_id long, embedding array<float>, Score string, query_id int, rank double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], SCHEMA)


def brute(rows, every, k):
    fits = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v)
    kept = [(i, [math.floor(64.0 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and fits(v)]
    queries = {}
    for i, v in kept:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, x in queries.items():
        scores = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(x, v)))), i) for i, v in kept if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def check(spark, rows, every, k, **how):
    df = table(spark, rows)
    found = exact_search.search(df.repartition(3), df.filter(f"vec_id % {every} = 0"), k=k, **how)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, found.collect()))
    assert got == brute(rows, every, k)
    return got


@pytest.mark.parametrize("shape", ["spread", "ties", "sparse"])
def test_equals_plain_loops(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    if shape == "ties":
        x = rng.integers(0, 2, (400, 6)) / 64
    if shape == "sparse":
        x = np.where(rng.random((400, 6)) < 0.8, 0, x)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    whole = check(spark, rows, 5, 7)
    assert check(spark, rows, 5, 7, query_block=10, lanes=9, slice_rows=13) == whole  # many blocks, lanes and slices


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [i / 9, -i / 7]) for i in range(12)] + [(4, [9.0, 9.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (20, []), (21, []), (22, [1.0]), (24, [1.0, 2.0, 3.0]), (26, [0.0, 0.0])]
    check(spark, rows + [(None, [1.0, 1.0]), (30, None), (32, [1.0, None]), (33, [nan]), (34, [inf, 0.0])], 2, 5)
    check(spark, [(i, [0.5] * 3) for i in range(200)], 20, 20)  # all equal
    check(spark, rows[:3], 2, 20)  # fewer candidates than k
    assert check(spark, [(20, [1.0])], 20, 20) == []
    assert exact_search.top_products(table(spark, [])).count() == 0


def test_large_components_and_many_queries(spark):
    rng = np.random.default_rng(4)
    check(spark, [(i, v) for i, v in enumerate((rng.normal(size=(60, 3)) * 1e6).tolist())], 3, 5)  # 64 bits
    check(spark, [(i, v) for i, v in enumerate((rng.normal(size=(40, 3)) * 1e30).tolist())], 3, 5)  # beyond them: the nearest long
    parted, n = exact_search.in_blocks(table(spark, [(i, [1.0] * 8) for i in range(1000)]).select("vec_id", "embedding"), 100, 400)
    assert n >= 20 and parted.groupBy("block").count().agg({"count": "max"}).first()[0] <= 100
