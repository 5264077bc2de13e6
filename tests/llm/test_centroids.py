"""Clustering by a vantage-point tree against plain loops over Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from corpusloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, Distance int"


def brute(rows, k, rounds, dim, seed=1):
    kept = [(i, [math.floor(64.0 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, near(v)) for i, v in kept]
    own = {}
    for _, (d, n) in found:
        own[n] = own.get(n, 0) + d
    fit = lambda d: d if d < 2**63 else None
    total = sum(own.values()) if all(fit(d) is not None for _, (d, _) in found) else None
    inertia = {n: None if any(fit(d) is None for _, (d, m) in found if m == n) else fit(s) for n, s in own.items()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, fit(d), inertia[n], None if total is None else fit(total), digest[n]) for i, (d, n) in found), key=repr)


def check(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(parts)
    found = sorted((tuple(r) for r in centroids.cluster(df, **how).collect()), key=repr)
    assert found == brute(rows, how["k"], how["rounds"], how["dim"])
    return found


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_loops(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(300, 4)) * (0.05 if seed == 0 else 1), 2)  # the first: many equal integers, so many ties
    check(spark, [(i, v) for i, v in enumerate(x.tolist())], k=16, rounds=3, dim=4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [i / 7, -i / 9]) for i in range(30)] + [(3, [0.5, 0.5]), (3, [0.5, 0.5]), (None, [1.0, 2.0]), (None, [1.0, 2.0])]
    rows += [(50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [nan, 1.0]), (55, [inf, 1.0]), (56, [1.0, 2.0, 3.0])]
    assert len(check(spark, rows, k=5, rounds=3, dim=2)) == 34
    assert len(check(spark, rows[:3], k=16, rounds=3, dim=2)) == 3  # fewer rows than centroids
    check(spark, [(i, [0.5, 0.5]) for i in range(20)], k=4, rounds=3, dim=2)  # all equal: one centroid takes all
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).count() == 0


def test_components_beyond_64_bits(spark):
    rows = [(i, [5e37 * (i % 7), -3e38 + i, 3.4e38]) for i in range(40)] + [(100 + i, [float(i), 0.0, 2.0**17]) for i in range(40)]
    found = check(spark, rows, k=6, rounds=2, dim=3)
    assert any(r[2] is None for r in found)


def test_the_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3, 4, (60, 2))
    x = rng.integers(-8, 9, (2000, 2))
    number, best = centroids.VantageTree(centres).nearest(x)
    away = ((x[:, None] - centres) ** 2).sum(2)
    assert (best == away.min(1)).all() and (number == away.argmin(1)).all()
    seen = []
    tree, plain = centroids.VantageTree(np.arange(0, 64000, 1000).reshape(-1, 1)), centroids.squared
    try:
        centroids.squared = lambda a, c: (seen.append(len(a)), plain(a, c))[1]
        tree.nearest(rng.integers(0, 64000, (500, 1)))
    finally:
        centroids.squared = plain
    assert sum(seen) < 500 * 64 / 3  # most of the 64 centroids are never compared
