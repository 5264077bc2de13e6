"""Odd rows through every operator on documents: ids beyond 2^53 beside null ones, clashing names, repeated, empty and very long texts, no rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, jaccard_join, language_id, line_dedup, mixing, quality, token_counts, token_file, toxicity
from corpusloom.llm.common import WordScores
from corpusloom.llm.queries import vocabulary

pytest.importorskip("public_tokenizers")
BIG = 2**53 + 1
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, Score double, REJECTED string, _own_score int, _mix_limit int, _mix_sk int, _language string, _leaks int, _key int, "
    "_hash string, Lang_Pred string, n_tokens long, Predicted int, class_id string, item_id int, _d int, _runs int, big long"
)
ITEM = "one two three four five six seven eight nine ten"
LONG = "word after word goes on and on. " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(BIG, "the house and the garden " + ITEM), (None, "the garden and the house in the evening"), (BIG + 2, "the house and the garden " + ITEM), (BIG + 4, "the road number 3 and the river"), (7, None), (8, ""), (9, LONG), (10, "das haus und der garten am abend"), (10, "das haus und der garten am abend"), (None, None)]
    texts += [(100 + i, f"the road number {i} and the river", ) for i in range(20)] + [(200 + i, f"die strasse nummer {i} und der fluss") for i in range(20)]
    rows = [(i, t, "de" if t and t.startswith("d") else "en", "s", 0, 0.5, "x", 3, 4, 5, "y", 6, 7, "z", "l", BIG, 1, "c", 2, 8, 9, BIG + 4 if i else None) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def ids(rows, column="doc_id"):
    return sorted((r[column] is not None, r[column] or 0) for r in rows)


def labels(spark):
    return spark.createDataFrame([(100 + i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "op1": lambda spark, d: jaccard_join.classes(d),
    "op3": lambda spark, d: toxicity.toxicity(d, labels(spark)),
    "op4": lambda spark, d: token_file.round_trip(d, vocabulary("word_bpe_49k.json")),
    "op5": lambda spark, d: language_id.identify(d),
    "op7": lambda spark, d: mixing.taken_words(d),
    "op8": lambda spark, d: token_counts.count_tokens(d, vocabulary("byte_bpe_50k.json")),
    "op10": lambda spark, d: quality.quality(d, labels(spark)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_each_row_gives_one_with_its_id(spark, docs, name):
    found = PER_ROW[name](spark, docs).collect()
    assert ids(found) == ids(docs.collect())
    same = [tuple(x for c, x in r.asDict().items() if c not in ("doc_id", "start")) for r in found if r.doc_id == 10]
    assert len(same) == 2 and same[0] == same[1]
    assert PER_ROW[name](spark, docs.limit(0)).count() == 0


BENCH = [(1, ITEM), (2, "river"), (3, "zz yy"), (4, "number 7"), (None, "x y z"), (5, None), (6, " ")]


def test_leaks(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontamination.find_leaks(docs, bench).collect()
    # Items of one or two words must be met word for word.
    assert {(r.doc_id, r.item_id) for r in found} == {(BIG, 1), (BIG + 2, 1), (BIG + 4, 2), (107, 4)} | {(100 + i, 2) for i in range(20)}
    assert {r.score for r in found} == {1.0} and decontamination.find_leaks(docs.limit(0), bench).count() == 0


#: Stages, the ids that they may drop: a text of words that no other has is rejected by so small a model.
KEPT = {
    "keep_identified": (lambda spark, d: language_id.keep_identified(d), {7, 8, BIG, BIG + 2}),
    "keep_one_of_each": (lambda spark, d: jaccard_join.keep_one_of_each(d), {BIG + 2, BIG + 4}),
    "drop_leaks": (lambda spark, d: decontamination.drop_leaks(d, spark.createDataFrame(BENCH[:1], "item_id long, text string")), {BIG, BIG + 2}),
    "mix_sources": (lambda spark, d: mixing.mix_sources(d, share=1.0), {7, 8}),
    "dedup_lines": (lambda spark, d: line_dedup.dedup_lines(d, min_words=3000).drop("n_lines", "n_removed"), set()),
}


@pytest.mark.parametrize("name", KEPT)
def test_stages_keep_all_columns(spark, docs, name):
    run, gone = KEPT[name]
    found = run(spark, docs)
    assert [c for c in found.columns] == docs.columns
    rows = found.collect()
    assert {r.doc_id for r in rows if r.doc_id} >= {r.doc_id for r in docs.collect() if r.doc_id} - gone
    assert all(r.big == (BIG + 4 if r.doc_id else None) and r.n_tokens == BIG and r.Score == 0.5 for r in rows)
    assert len(rows) <= docs.count() and run(spark, docs.limit(0)).count() == 0


def test_large_ids_beside_null_ones_stay(spark):
    rows = [(BIG + i, f"a text of its own {i} " + " ".join(f"w{i}x{j}" for j in range(9))) for i in range(0, 82, 2)] + [(None, "another text without an id")]
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(kept) == 42 and ids(kept) == ids([{"doc_id": i} for i, _ in rows])


def test_language_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.filter("doc_id < 500").collect() if r.text]
    model = language_id.train([r.text for r in rows[:300]], [r.lang for r in rows[:300]])
    found = {r.i: r for r in language_id.predict(spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "i int, text string"), model).collect()}
    from corpusloom.llm.common import hashed_subwords

    for i, r in enumerate(rows):
        total, n = np.zeros(len(model.labels)), 0
        for w in language_id.LETTERS.findall(r.text.lower()):
            _, bucket = hashed_subwords([w], len(model.table))
            total, n = total + model.table[bucket].astype(float).sum(0), n + len(bucket)
        if not n:
            assert (found[i].lang_pred, found[i].score) == ("und", 0)
            continue
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert found[i].score == pytest.approx(p.max(), abs=1e-3) and (found[i].lang_pred == model.labels[int(p.argmax())] or p.max() < 0.51)


def test_toxicity_scores_equal_brute_force(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400").collect() if r.text]
    model = toxicity.train(rows[:200], [i % 3 == 0 for i in range(200)], rounds=2)
    found = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(rows):
        words = toxicity.words_of(text)
        if not words:
            assert found[i] == 0
            continue
        scores = WordScores(model.table)
        scores.learn(set(words))
        value = {w: v for w, v in zip(words, scores.rows(words).astype(float).tolist(), strict=True)}
        windows = [words[a : a + model.span] for a in range(max(1, len(words) - model.span + 1))]
        best = max(sum(value[w][0] for w in x) / sum(value[w][1] for w in x) for x in windows) + model.bias
        assert found[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, model.slope * best + model.offset)))), abs=1e-4)


def test_the_fitting_rows_are_the_same_each_time(spark):
    docs = spark.createDataFrame([(i % 50, f"the text number {i} says moron" if i % 2 else f"the text number {i}") for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i % 50, i % 2, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    runs = [toxicity.toxicity(docs.repartition(n), marks, fit_rows=20).agg(F.sum("score")).first()[0] for n in (1, 5)]
    assert runs[0] == pytest.approx(runs[1], abs=1e-9)


def test_features_are_counted_in_all_documents(spark):
    from corpusloom.llm import decontamination

    items = decontamination.Items([(1, "red green blue"), (2, "green blue black")], 0.5)
    docs = spark.createDataFrame([(i, "green blue x red green") for i in range(50)] + [(50, None), (51, ""), (52, "blue"), (53, "black Black")], "doc_id long, text string").coalesce(1)
    counts = dict(zip(items.grams.tolist(), decontamination.feature_counts(docs, items).tolist(), strict=True))
    word = lambda w: items.vocabulary[w]
    pair = lambda *w: int(items.pairs(np.array([word(x) for x in w]))[0])
    assert {w: counts[word(w)] for w in ("red", "green", "blue", "black")} == {"red": 50, "green": 100, "blue": 51, "black": 2}
    # No pair spans two texts.
    assert (counts[pair("red", "green")], counts[pair("green", "blue")], counts[pair("blue", "black")]) == (50, 50, 0)
