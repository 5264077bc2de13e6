"""Nearest vectors of dense groups and full blocks against brute force."""

import numpy as np
import pytest

from corpusloom.llm import ann


def table(spark, x):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")


def found_and_recall(rows, x, queries, k=20):
    """{query: vec_ids by rank}, and its share of brute force's."""
    x = x.astype(np.float32).astype(float)
    got, hits = {}, 0
    for r in rows.collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    got = {q: [v[n] for n in sorted(v)] for q, v in got.items()}
    assert set(got) == set(queries)
    for q in queries:
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        hits += len(set(got[q]) & set(np.lexsort((np.arange(len(x)), -score))[:k].tolist()))
    return got, hits / (k * len(queries))


@pytest.mark.parametrize("noise", [0.0, 0.001, 0.03])
def test_a_group_of_near_copies(spark, noise):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] + noise * rng.normal(size=(1000, 64))  # far more than are ranked exactly
    index, book = ann.build_index(table(spark, x))
    queries = index.filter("vec_id % 60 = 0").selectExpr("vec_id AS query_id", "embedding")
    recall = found_and_recall(ann.search(index, book, queries), x, list(range(0, 3000, 60)))[1]
    print("near copies, noise", noise, "recall", recall)
    assert recall >= 0.95 and (noise or recall == 1)


@pytest.mark.parametrize("shape", ["spread", "clusters", "copies"])
def test_many_rows_in_any_partitioning(spark, shape):
    """50,000 rows: a block's 200 best by code, a twentieth, are ranked exactly, and no others."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50_000, 32))
    if shape == "clusters":
        x += 3 * rng.normal(size=(50, 32))[rng.integers(0, 50, 50_000)]
    if shape == "copies":
        x[::3] = x[0] + 0.01 * rng.normal(size=(len(x[::3]), 32))
    rows, queries, found = table(spark, x), list(range(0, 50_000, 500)), []
    for n in (2, 16):
        index, book = ann.build_index(rows.repartition(n))
        asked = index.filter("vec_id % 500 = 0").selectExpr("vec_id AS query_id", "embedding")
        got, recall = found_and_recall(ann.search(index, book, asked), x, queries)
        found.append(got)
        print("50,000 rows", shape, "in", n, "partitions: recall", recall)
        assert recall >= 0.95
    assert found[0] == found[1]


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(i % 30, [float(i), 1.0], i, 0.5, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int, score double, codes string")
    found = ann.nearest(df, every=20, k=3).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(by) == {0, 20} and all({rank for rank, _ in v} == {1, 2, 3} for v in by.values()) and by[0][0] == (1, 29)
