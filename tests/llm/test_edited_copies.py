"""Edited copies of test items, each alone in its corpus, against brute force."""

import random

from corpusloom.llm import decontamination
from tests.llm.test_common import documents
from tests.llm.test_pairs import brute_align


def test_single_copies_with_many_edits(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    items = [(i, [word() for _ in range(rng.choice([15, 24, 38, 60]))]) for i in range(40)]
    docs = []
    for i, words in items:
        copy = [word() if rng.random() < rng.choice([0.15, 0.2, 0.25, 0.3]) else w for w in words]
        if i % 8 == 0:  # every third word is another: no three words of the item stand together
            copy = [word() if j % 3 == 2 else w for j, w in enumerate(words)]
        if i % 8 == 4:  # a word between any two: no two words of the item stand together
            copy = [x for w in words for x in (w, word())][:-1]
        docs.append((i, [word() for _ in range(rng.randrange(300))] + copy + [word() for _ in range(rng.randrange(300))]))
    docs += [(100 + i, [rng.choice(items[i % 40][1]) if rng.random() < 0.4 else word() for _ in range(90)]) for i in range(40)]
    want = {(d, i) for d, t in docs for i, w in items if set(w) & set(t) and brute_align(w, t) >= 0.5 * 2 * len(w)}
    table = documents(spark, [(d, " ".join(t), None, None, 0) for d, t in docs])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontamination.find_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want) and len(want) >= 30
    score = {(d, i): brute_align(w, t) / (2 * len(w)) for d, t in docs for i, w in items if (d, i) in want}
    assert {(r.doc_id, r.item_id): r.score for r in found} == score
    assert {r.doc_id for r in decontamination.drop_leaks(table, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
