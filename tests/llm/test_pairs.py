"""Search, joins, decontamination and line dedup against brute force."""

import random

import numpy as np
import pytest

from corpusloom.llm import ann, decontamination, graph, jaccard_join, line_dedup
from tests.llm.test_common import documents


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_nearest(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, a in good:
        if q % every == 0:
            scored = sorted((-float((a * b).sum()), i) for i, b in good if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest_vectors(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=9).round(3).tolist()) for i in range(700)]
    data += [(1000 + i, data[20][1]) for i in range(300)]  # many copies of one vector, which is a query too
    odd = [(2000, None), (2001, [0.0] * 9), (2002, [float("nan")] + [1.0] * 8), (2020, [float("inf")] * 9), (2003, [1.0, 2.0]), (2004, [None] + [1.0] * 8)]
    found = ann.nearest(vectors(spark, [(i, v, 0) for i, v in data + odd])).collect()
    want = brute_nearest(data, 20, 20)
    got = {q: [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] for q in {r.query_id for r in found}}
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in got)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.95 and got[20] == want[20]
    by_id = dict(data)
    r = found[0]
    assert r.score == (np.array(by_id[r.query_id], np.float32).astype(float) * np.array(by_id[r.vec_id], np.float32).astype(float)).sum()


def test_nearest_of_few_and_none(spark):
    few = vectors(spark, [(0, [1.0, 0.0], 0), (3, [0.5, 0.5], 0), (4, [0.5, 0.5], 0)])
    assert [(r.rank, r.vec_id) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 3), (2, 4)]
    assert ann.nearest(vectors(spark, [])).count() == 0


def test_anisotropic_codes_keep_the_parallel_part():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    book = ann.train(x, threshold=0.5, parts=4)
    part, length, way = book.residuals(x)
    codes = book.encode(x, way)
    stands_for = lambda c: book.coarse[part] + length[:, None] * np.stack([book.centres[j, c[:, j]] for j in range(len(book.centres))], 1).reshape(len(x), -1)
    plain = ann.Codebooks(book.coarse, book.centres, 1.0).encode(x, way, sweeps=0)
    along = lambda y: (((x - y) * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2
    assert along(stands_for(codes)).mean() < 0.7 * along(stands_for(plain)).mean()
    q = rng.normal(size=(3, 16))
    small = np.einsum("qmw,mkw->qmk", book.split(q), book.centres)
    tables = (small[:, ::2, :, None] + small[:, 1::2, None, :]).reshape(3, -1, 256).astype(np.float32)
    assert np.allclose(q @ book.coarse[part].T + ann.scan(tables, ann.pack(codes)) * length, q @ stands_for(codes).T, atol=1e-4)


# ---------------------------------------------------------------- joins


def brute_classes(rows, n=5, threshold=0.8):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    linked = [[a != b and bool(sets[a]) and bool(sets[b]) and 1.0 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9 for b in range(len(rows))] for a in range(len(rows))]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(len(rows)):
            if linked[a][b]:
                old, new = root[b], root[a]
                root = [new if r == old else r for r in root]
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root[b] == root[a] and rows[b][0] is not None]
        out.append((i, min(ids) if ids else None, sum(linked[a]), len(sets[a])))
    return sorted(out, key=str)


def near_copies(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(60):
        rows.append((i, [word() for _ in range(rng.randrange(3, 80))] + (passage if i % 3 == 0 else [])))
    for i in range(60, 160):
        base = list(rows[rng.randrange(8)][1] if i < 130 else rows[rng.randrange(len(rows))][1])
        for _ in range(rng.randrange(0, 3)):
            base[rng.randrange(len(base))] = word()
        rows.append((i, base))
    texts = [(i, " ".join(w)) for i, w in rows]
    return texts + [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE  two"), (None, texts[3][1]), (3, texts[3][1]), (205, "x" * 50000)]


def test_classes_equal_brute_force(spark):
    rows = near_copies()
    found = jaccard_join.classes(documents(spark, [(i, t, None, None, 0) for i, t in rows]))
    assert sorted((tuple(r) for r in found.select("doc_id", "class_id", "n_links", "n_shingles").collect()), key=str) == brute_classes(rows)


def test_large_buckets_and_components_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 6)
    rows = near_copies(1)
    found = jaccard_join.classes(documents(spark, [(i, t, None, None, 0) for i, t in rows]))
    assert sorted((tuple(r) for r in found.select("doc_id", "class_id", "n_links", "n_shingles").collect()), key=str) == brute_classes(rows)


def test_one_of_each_stays(spark):
    rows = near_copies()
    docs = documents(spark, [(i, t, None, None, 0, 9) for i, t in rows], ", kept int")
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    classes = brute_classes(rows)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, c, _, _ in classes})
    assert jaccard_join.classes(documents(spark, [])).count() == 0 and jaccard_join.keep_one_of_each(documents(spark, [])).count() == 0


def test_exact_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in rng.integers(1, 400, 40)]
    want = [[len(set(a) & set(b)) for b in sets[20:]] for a in sets[:20]]
    assert (jaccard_join.overlaps(sets[:20], sets[20:]) == want).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {}
    for a, b in links:
        if a is not None and a != b:
            for x in (a, b):
                root.setdefault(x, x)
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    found = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == root and found.count() == len(root)


# ---------------------------------------------------------------- decontamination


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(-1, 5, rng.integers(1, 25))
        assert decontamination.align(a, b)[0] == brute_align(a, b)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 6)))
    items = [(i, [word() for _ in range(rng.randrange(12, 40))]) for i in range(8)]
    docs = []
    for i in range(80):
        words = [word() for _ in range(rng.randrange(0, 120))]
        if i % 2:
            copy = list(items[i % 8][1])
            for _ in range(int(len(copy) * rng.choice([0, 0.1, 0.2, 0.25]))):
                j = rng.randrange(len(copy))
                copy[j : j + 1] = rng.choice([[], [word()], [copy[j], word()]]) if len(copy) > 5 else [word()]
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((i, " ".join(words).capitalize() + "."))
    bench = [(i, " ".join(w) + "!") for i, w in items] + [(50, None), (None, "a b c d"), (51, "two words")]
    want = {(d, i) for d, t in docs for i, w in items if brute_align([hash(x) for x in w], [hash(x) for x in decontamination.words_of(t)]) >= 0.5 * 2 * len(w)}
    table = documents(spark, [(i, t, None, None, 0) for i, t in docs] + [(300, None, None, None, 0), (301, "", None, None, 0)])
    test_items = spark.createDataFrame(bench, "item_id long, text string")
    found = decontamination.find_leaks(table, test_items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want) and len(want) > 30
    clean = decontamination.drop_leaks(table, test_items)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in table.collect()} - {d for d, _ in want}
    r = next(r for r in found if r.score == 1)
    assert decontamination.words_of(dict(docs)[r.doc_id])[r.first_word : r.last_word + 1] == dict(items)[r.item_id]


def test_leaks_in_blocks_and_without_items(spark, monkeypatch):
    docs = documents(spark, [(1, "x one two three four five six y", None, None, 0), (None, "seven eight nine ten eleven", None, None, 0)])
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven")], "item_id long, text string")
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 1)
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()} == {(1, 1), (None, 2)}
    assert decontamination.drop_leaks(docs, bench).count() == 0
    none = bench.filter("item_id > 5")
    assert decontamination.find_leaks(docs, none).count() == 0 and decontamination.drop_leaks(docs, none).count() == 2
    assert decontamination.find_leaks(documents(spark, []), bench).count() == 0


def test_long_and_repeated_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASSAGE", 10)
    words = [f"w{i}" for i in range(35)]
    docs = documents(spark, [(1, " ".join(["x", *words[10:20], "y"]), None, None, 0), (2, "other words only here", None, None, 0), (3, "b1 b2 b3 b4 b5", None, None, 0)])
    bench = spark.createDataFrame([(7, " ".join(words)), (7, " ".join(words)), (7, "b1 b2 b3 b4 b5")], "item_id long, text string")
    assert {tuple(r) for r in decontamination.find_leaks(docs, bench).collect()} == {(1, 7, 1.0, 1, 10), (3, 7, 1.0, 0, 4)}


def test_items_with_one_text_spread_over_blocks(spark):
    bench = spark.range(12_000).selectExpr("id AS item_id", "'the same ten words stand in each of all these items' AS text")
    parts = decontamination.blocks(bench)
    sizes = [b.items.count() for b in parts]
    assert len(parts) == 3 and sum(sizes) == 12_000 and max(sizes) < 1.2 * decontamination.ITEM_BLOCK


def test_features_are_counted_on_all_documents(spark, monkeypatch):
    """A block's seeds don't depend on what earlier blocks have dropped."""
    docs = documents(spark, [(i, f"alpha beta gamma delta number{i % 2} tail{i}", None, None, 0) for i in range(40)])
    bench = spark.createDataFrame([(1, "alpha beta gamma delta number0"), (2, "alpha beta gamma delta number1")], "item_id long, text string")
    seen, plain = [], decontamination.feature_counts
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 1)
    monkeypatch.setattr(decontamination, "feature_counts", lambda docs, items: (seen.append(docs.count()), plain(docs, items))[1])
    assert decontamination.drop_leaks(docs, bench).count() == 0 and seen == [40] * len(seen) and len(seen) >= 2


# ---------------------------------------------------------------- lines


def brute_lines(docs, least):
    """Runs that hold `least` words and stood before go; each stretch of `least` words or more, begun or ended by any line, is looked for on its own, with its first place."""
    lines = {i: t.split("\n") for i, t in docs}
    gone, first = {i: set() for i in lines}, {}
    for i in sorted(lines):
        words = [len(x.split()) for x in lines[i]]
        for p in range(len(words)):
            fits = [n for n in range(1, len(words) - p + 1) if sum(words[p : p + n]) >= least]
            # The shortest from the line on, and those that lose their words without their first line.
            for n in [n for k, n in enumerate(fits) if k == 0 or sum(words[p + 1 : p + n]) < least]:
                run = tuple(lines[i][p : p + n])
                j, q = first.setdefault(run, (i, p))
                gone[i] |= {x for x in range(p, p + n) if (j, q) != (i, p) and not (j == i and x < q + n)}
    kept = {i: "\n".join(x for p, x in enumerate(lines[i]) if p not in gone[i]) for i in lines}
    left = {x for i in lines for p, x in enumerate(lines[i]) if p not in gone[i]}
    assert all(x in left for i in lines for x in lines[i])  # nothing is lost
    return kept


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(3)
    for least in (1, 7, 20):
        pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 5))) for _ in range(4)] + ["", ""]
        docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.93 else f"u{rng.random()}" for _ in range(rng.randrange(1, 25)))) for i in range(25)]
        docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "\n".join(["a b c"] * 12)), (103, "")]
        found = line_dedup.dedup_lines(documents(spark, [(i, t, None, None, 0) for i, t in docs]), min_words=least).collect()
        assert {r.doc_id: r.text for r in found} == brute_lines(docs, least)
        assert all(r.n_lines == dict(docs)[r.doc_id].count("\n") + 1 for r in found)


def test_runs_that_overlap_themselves_keep_a_copy(spark):
    five = "one two three four five"
    docs = [(1, "\n".join(["lorem"] * 120)), (2, "\n".join(["head", *[five] * 40, "tail"])), (3, "\n".join(["lorem"] * 60)), (4, "\n".join(["x y", "z"] * 60))]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, [(i, t, None, None, 0) for i, t in docs])).collect()}
    assert found[1] == "\n".join(["lorem"] * 50) and found[3] == ""
    assert found[2] == "\n".join(["head", *[five] * 10, "tail"])
    assert len(found[4].split()) in (50, 51, 52)
    assert found == brute_lines(docs, 50)


def test_many_blank_lines_cost_one_pass(spark):
    words = " ".join(f"w{i}" for i in range(25))
    text = words + "\n" * 20_000 + words + " end"
    docs = documents(spark, [(1, text, None, None, 0), (2, text, None, None, 0), (3, "\n" * 20_000, None, None, 0)])
    found = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()}
    assert found == {1: 0, 2: 20_001, 3: 0}


def test_previous_smaller():
    rng = np.random.default_rng(1)
    lcp = rng.integers(0, 6, 200)
    row = np.sort(rng.integers(0, 200, 500))
    n = rng.integers(1, 8, 500)
    found, places, prefixes = line_dedup.previous_smaller(lcp, row, n)
    for r, m, f in zip(row, n, found, strict=True):
        below = [j for j in range(r + 1) if lcp[j] < m]
        assert f == (below[-1] if below else -1)
    for m in range(1, 8):
        below = [j for j in range(200) if lcp[j] < m]
        assert [p for p, x in zip(places, prefixes, strict=True) if x < m][-1:] == below[-1:]


def test_odd_lines(spark):
    long = "\n".join(f"w{i} " * 60 for i in range(3))
    docs = documents(spark, [(1, long, None, None, 0), (2, long, None, None, 0), (None, long, None, None, 0), (3, None, None, None, 0), (1, long, None, None, 0)])
    found = line_dedup.dedup_lines(docs.withColumnRenamed("n_chars", "n_lines")).collect()
    assert sorted((str(r.doc_id), r.text == long, r.n_removed) for r in found) == [("1", False, 3), ("1", False, 3), ("2", False, 3), ("3", False, 0), ("None", True, 0)]
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block", [7, 65_536])
def test_suffix_array_and_prefixes_equal_a_naive_sort(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(block)
    seqs = [[rng.choice("aaabbcd") if rng.random() < 0.9 else f"u{i}-{j}" for j in range(rng.randrange(1, 30))] for i in range(12)]
    seqs += [seqs[0], seqs[1][3:], seqs[0] + seqs[1]]
    depths = lambda d, j: [n for n in (1, 2, 3, 5, 9) if j + n <= len(seqs[d])]
    all_lines = [x for q in seqs for x in q]
    places = [(d, 0, j) for d, q in enumerate(seqs) for j, x in enumerate(q) if all_lines.count(x) > 1]
    order = {x: i for i, x in enumerate(sorted(set(all_lines)))}
    rows = spark.createDataFrame([(*p, order[seqs[p[0]][p[2]]], 0, depths(p[0], p[2])) for p in places], "d long, t long, pos long, h1 long, h2 long, depths array<int>")
    rounds = line_dedup.rank_rounds(rows.drop("depths"), 9)
    array = line_dedup.suffix_array(rounds)
    found = [(r.d, r.t, r.pos, r.lcp) for r in array.orderBy("i").collect()]
    assert [r.i for r in array.orderBy("i").collect()] == list(range(len(places))) and sorted(f[:3] for f in found) == sorted(places)

    def common(p, q):
        a, b = seqs[p[0]][p[2] :], seqs[q[0]][q[2] :]
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    # What the rounds don't rank, a line that occurs once or an end, is ordered by the suffix's place; so are prefixes beyond the depth.
    longest = 2 ** len(rounds) - 1
    assert all(min(f[3], longest) == min(common(f, g), longest) or f[3] >= 9 <= common(f, g) for g, f in zip(found, found[1:], strict=False))

    def key(p):
        out = []
        for x in seqs[p[0]][p[2] : p[2] + 2 ** (len(rounds) - 1)]:
            if all_lines.count(x) < 2:
                break
            out.append(order[x])
        return out

    keys = [key(f) for f in found]
    assert keys == sorted(keys)
    # The interval of each suffix and depth: all suffixes with the same lines, and no other.
    left = {(r.n, r.d, r.pos): r.left for r in line_dedup.intervals(array.join(rows.select("d", "t", "pos", "depths"), ["d", "t", "pos"])).collect()}
    index = {f[:3]: i for i, f in enumerate(found)}
    for p in places:
        for n in depths(p[0], p[2]):
            same = [index[q] for q in places if seqs[q[0]][q[2] : q[2] + n] == seqs[p[0]][p[2] : p[2] + n]]
            if len(same) > 1:
                assert left[n, p[0], p[2]] == min(same) and max(same) - min(same) == len(same) - 1
