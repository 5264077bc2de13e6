import zlib

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import decontamination, mixing
from corpusloom.llm.queries import vocabulary
from tests.llm.test_pairs import brute_classes

pytest.importorskip("public_tokenizers")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "token_file"]


def test_run_equals_brute_force(spark, tmp_path):
    """Stage by stage with plain Python over a small corpus."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120").collect()
    rows = [tuple(r) for r in docs] + [(1000, "12 34 !!", "en", "src1", 8), (1001, None, None, None, None), (1002, docs[0].text, "en", "src9", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    classes = {i: c for i, c, _, _ in brute_classes([(r[0], r[1]) for r in kept])}
    kept = [r for r in kept if classes[r[0]] == r[0]]
    items = [decontamination.words_of(t) for _, t in bench]

    def leaks(text):
        words = decontamination.words_of(text)
        ids = {w: i for i, w in enumerate(dict.fromkeys([*words, *(x for i in items for x in i)]))}
        b = np.array([ids[w] for w in words])
        return any(decontamination.align(np.array([ids[x] for x in i]), b)[0] >= 0.5 * 2 * len(i) for i in items if set(i) & set(words))

    kept = [r for r in kept if not leaks(r[1])]
    table = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r for r in mixing.taken_words(table).collect()}
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    texts = {r[0]: r[1] for r in kept}
    assert {r[0] for r in found} == {i for i in texts if taken[i].taken > 0}
    for i, text in texts.items():
        copies = [r for r in found if r[0] == i]
        whole, part = divmod(taken[i].taken, taken[i].size)
        assert sum(c[3] == crc(text) for c in copies) == whole and len(copies) == whole + bool(part)
    starts = sorted((r[1], r[2]) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _key int, rejected int, n_tokens string, _leaks int, Start double"


def whole_run(spark, folder, rows):
    spark.createDataFrame(rows, CLASHING).write.parquet(f"{folder}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(folder))
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return found.collect()


def test_run_on_nothing(spark, tmp_path):
    assert whole_run(spark, tmp_path, []) == []


def test_run_on_odd_rows(spark, tmp_path):
    docs = [tuple(r)[:5] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 80").collect()]
    clean = [r for r in docs if r[1] and len(r[1]) > 200][:40]
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n ", "en", "s", 3), (None, None, None, None, None)]
    odd += [clean[0], clean[0], (None, clean[1][1] + " and one more", "en", "s", 1), (None, clean[2][1], clean[2][2], None, 1), (clean[3][0], clean[4][1][::-1], "en", "s", 1), (903, clean[5][1] * 60, "en", "s", 1)]
    extra = (7, 8, "x", 9, 0.5)
    found = whole_run(spark, tmp_path, [(*r, *extra) for r in [*clean, *odd]])
    ids = {r.doc_id for r in found}
    assert ids and ids <= {r[0] for r in clean} | {903, None} and not ids & {900, 901, 902}
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)
