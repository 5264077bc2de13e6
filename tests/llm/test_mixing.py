import re
from collections import defaultdict

import pytest

from corpusloom.llm import mixing
from tests.llm.test_common import documents


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Repeated clamping and resharing, as it is usually described."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        level = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if level[s] > cap * sizes[s]]
        if not over:
            return fixed | level
        fixed |= {s: cap * sizes[s] for s in over}


def rows():
    import random

    rng = random.Random(4)
    out = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), "en", f"s{min(rng.randrange(12), 5)}", 0) for i in range(400)]
    return [*out, (None, "x y z", None, None, 0), (900, None, None, None, 0), (901, "", None, "s1", 0), (5, "again \x0b and\tagain", "en", "s2", 0), (902, "one", "en", "é", 0)]


def test_targets_and_taken_words(spark):
    data = rows()
    found = mixing.taken_words(documents(spark, data)).collect()
    assert len(found) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s, _ in data:
        sizes[s] += size(t)
    want = targets(sizes)
    taken, by_size = defaultdict(int), {(i, size(t)): s for i, t, _, s, _ in data}
    for r in found:
        s = by_size[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.taken_words(documents(spark, data).repartition(3)).collect()), key=str)


def test_repetitions_hold_the_taken_words(spark):
    data = rows()
    docs = documents(spark, [(*r, 1) for r in data], ", whole int")
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    per_doc = defaultdict(int)
    for r in mixed.collect():
        per_doc[r.doc_id] += len((r.text or "").split())
    for r in mixing.taken_words(docs).groupBy("doc_id").sum("taken").collect():
        assert per_doc[r.doc_id] == r[1]


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = documents(spark, rows())
    first = sorted(map(tuple, mixing.taken_words(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.taken_words(docs).collect()), key=str) == first


def test_empty_and_wordless(spark):
    assert mixing.taken_words(documents(spark, [])).count() == 0 and mixing.mix_sources(documents(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.taken_words(documents(spark, [(1, " ", None, "a", 0)])).collect()] == [(1, 0, 0, 0.0, 0)]
