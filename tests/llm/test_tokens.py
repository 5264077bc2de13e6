import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import token_counts, token_file
from corpusloom.llm.queries import vocabulary
from tests.llm.test_common import documents

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

LETTERS = ["ab", "A's", "'ll", " ", "\n", "\t", "\x0b", "\x85", "\xa0", "　", "é", "é", "ñ1", "٣", "_-", "<|endoftext|>", "ſ", "\U0001f600", "漢字", "\x1c", "Σ", "İ", ";", "‍", "יִ", "가", "Å", "ª½", "word", "the"]


def texts(n=3000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(30))) for _ in range(n)] + ["", " ", "x" * 3000, "the end. " * 500]


def test_counts_equal_the_library(spark, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts(), add_special_tokens=False)]
    counter = token_counts.counter(path, token_counts.whole_tokens(token_counts.load(path)))
    assert [counter.count(t) for t in texts()] == want
    monkeypatch.setattr(token_counts, "SLICE", 40)
    assert [counter.count(t) for t in texts()] == want


def test_counts_of_rows(spark):
    docs = documents(spark, [(1, "hello world", "en", "a", 1), (1, None, None, None, None), (None, "é" * 2000, "en", "a", 0)])
    found = sorted(map(tuple, token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json")).collect()), key=str)
    assert (1, 11, 2, False) in found and (1, 0, 0, False) in found and len(found) == 3
    assert [r[1] for r in found if r[0] is None] == [4000]
    assert token_counts.count_tokens(documents(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_word_ids_equal_the_library():
    path = vocabulary("word_bpe_49k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts(), add_special_tokens=False)]
    small = token_file.WordIds(path, remember=500)
    for words in (token_file.word_ids(path), small):
        assert [list(np.frombuffer(i, "<u4")) for i in words.ids(texts())] == want


@pytest.mark.parametrize("n, limit", [(1, 16), (2, 16), (3, 2), (300, 9), (5000, 16)])
def test_code_lengths(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
    lengths = token_file.code_lengths(counts, limit)
    assert lengths.max() <= limit and (2.0**-lengths).sum() <= 1 and (n == 1 or (2.0**-lengths).sum() == 1)
    if n <= 3:
        return
    import heapq

    heap, unlimited = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        unlimited += a
        heapq.heappush(heap, a)
    assert (lengths * counts).sum() >= unlimited
    if limit == 16 and lengths.max() < 16:
        assert (lengths * counts).sum() == unlimited


def test_codec_round_trip():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 20000) % 3000
    tokens, counts = np.unique(ids, return_counts=True)
    book = token_file.Codebook(tokens, token_file.code_lengths(counts, 16))
    decoder = token_file.Decoder(book)
    for n in (0, 1, 511, 512, 513, 20000):
        assert (decoder.decode(*book.encode(ids[:n]), n) == ids[:n]).all()


def test_file_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK", 50)
    rows = [(i * 7 % 101, t, None, None, 0) for i, t in enumerate(texts(100, 2))] + [(None, "null id", None, None, 0), (500, None, None, None, 0), (3, "again", None, None, 0)]
    path = vocabulary("word_bpe_49k.json")
    token_file.write_token_file(documents(spark, rows), str(tmp_path / "f"), path)
    found = token_file.read_token_file(spark, str(tmp_path / "f")).collect()
    tokenizer = Tokenizer.from_file(path)
    want = sorted((r[0] is not None, r[0] or 0, np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in found) == want
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(len(x.ids) // 4 for x in ordered[:i]) for i in range(len(ordered))]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in ordered] == sorted((r.doc_id is not None, r.doc_id or 0) for r in found)
    digest = token_file.digest(token_file.read_token_file(spark, str(tmp_path / "f"))).filter("doc_id = 500").first()
    assert (digest.n_tokens, digest.ids_crc32) == (1, zlib.crc32(np.array([2], "<u4").tobytes()))


def test_file_of_nothing(spark):
    assert token_file.round_trip(documents(spark, []), vocabulary("word_bpe_49k.json")).count() == 0
