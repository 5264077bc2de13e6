"""Alignment against whole texts encoded by the libraries and counted in plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import alignment
from corpusloom.llm.queries import vocabulary

pytest.importorskip("public_tokenizers")

A, B = (vocabulary(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")) if vocabulary else (None, None)
PARTS = ["ab", "house", " ", " ", "\n", "the", "  ", "\n\n", "\t", "'ll", "é", "ñ1", "\xa0", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\U0001f600", "漢字", "▁", "\r\n", "\x00", "​", ". ", "x\ny", "word", "\x1c", "　", "ſ", "é"]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def brute(rows):
    """Rows as the contract has them, in plain loops over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(v): bytes([v]) for v in visible}
    names |= {chr(256 + i): bytes([v]) for i, v in enumerate(v for v in range(256) if v not in visible)}
    out, linked = [], []
    for i, t in rows:
        left = a.encode(f" {t or ''}", add_special_tokens=False).ids
        right = b.encode(t or "")
        left_bytes = [b"".join(names[c] for c in a.id_to_token(x)) for x in left]
        right_bytes = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in right]
        want = f" {t}".encode()
        if not t or b"".join(left_bytes) != want or b"".join(right_bytes) != want:
            out.append([i, 0, 0, 0, 0, ""])
            linked.append([])
            continue
        ends = [np.cumsum([0, *map(len, x)]).tolist() for x in (left_bytes, right_bytes)]
        pairs = [(left[x], right[y]) for x in range(len(left)) for y in range(len(right)) if ends[0][x] < ends[1][y + 1] and ends[1][y] < ends[0][x + 1]]
        common = sorted(set(ends[0]) & set(ends[1]))[1:]
        shown, last = [], 0
        for c in common:
            shown.append("|".join(",".join(str(ids[k]) for k in range(len(ids)) if last <= e[k] < c) for ids, e in ((left, ends[0]), (right, ends[1]))))
            last = c
        out.append([i, len(left), len(right), len(common), len(pairs), hashlib.sha256(";".join(shown).encode()).hexdigest()])
        linked.append(pairs)
    counts = Counter(p for pairs in linked for p in set(pairs))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return sorted(((*o[:5], sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), o[5]) for o, pairs in zip(out, linked, strict=True)), key=repr)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, N_A int, run string, radix int").repartition(parts)
    found = alignment.align(df, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == brute(rows)
    return got


def test_equals_whole_texts(spark):
    rows = list(enumerate(texts()))
    rows += [(7, "the house"), (7, "the house"), (None, "the house\nand the garden"), (None, None), (500, None), (501, ""), (502, " "), (503, "the " * 3000), (504, "x" * 2000), (505, "a\nb\nc d"), (506, "a \nb"), (507, "\na"), (508, "a\n")]
    check(spark, rows)


def test_documents_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.filter("n_chars < 1500").collect()]
    assert len(rows) > 20
    check(spark, rows, 2)


def test_no_rows_and_no_tokens(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).count() == 0
    check(spark, [(1, None), (2, ""), (3, "▁")])


def test_runs_are_the_same_whatever_their_size():
    rng = np.random.default_rng(2)
    text, pair, links = rng.integers(0, 300, 5000), (rng.integers(0, 40, 5000) << 32) | rng.integers(0, 9, 5000), rng.integers(1, 5, 5000)
    for parts in ([slice(0, 5000)], [slice(0, 700), slice(700, 5000)]):
        by_radix, told = {}, Counter()
        for s in parts:
            for radix, records, names, documents in alignment.run_parts(text[s], pair[s], links[s]):
                by_radix.setdefault(radix, []).append(names)
                jumps, n = alignment.restored(documents, 2)
                assert records == len(jumps) and (n > 0).all()
                told["links"] += int(n.sum())
        assert told["links"] == links.sum()
        for radix, names in by_radix.items():
            found = list(alignment.merged([alignment._pairs_of(x) for x in names]))
            assert [p for p, _ in found] == sorted(p for p in set(pair.tolist()) if alignment.radix_of(np.array([p]))[0] == radix)
            if len(parts) == 1:
                assert dict(found) == {p: len(set(text[pair == p].tolist())) for p, _ in found}


def test_a_hot_id_is_dealt_over_groups(spark):
    parts = spark.createDataFrame([(run, 3, 100, b"", b"") for run in range(64)] + [(run, 4, 10, b"", b"") for run in range(64)], "run long, radix int, records long, pairs binary, documents binary")
    dealt, salts = alignment.dealt(parts)
    n = {r.radix: r.salts for r in salts.collect()}
    assert n[3] > 5 * n[4] and dealt.filter("radix = 3").select("salt").distinct().count() > 10
