import numpy as np

from corpusloom.llm import common


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)


def test_subwords_are_those_of_each_word_alone():
    words = ["idiot", "a", "é漢", "x" * 40]
    owner, ids = common.hashed_subwords(words, 1000)
    for i, w in enumerate(words):
        alone = common.hashed_subwords([w], 1000)[1]
        assert sorted(ids[owner == i]) == sorted(alone)
    assert (ids < 1000).all() and len(common.hashed_subwords([], 10)[0]) == 0


def test_word_scores_survive_forgetting():
    table = np.random.default_rng(0).normal(size=(64, 2)).astype(np.float32)
    small, large = common.WordScores(table, remember=3), common.WordScores(table)
    for words in (["a", "b", "c"], ["d", "a"], ["a", "b", "c", "d", "e"]):
        small.learn(set(words))
        large.learn(set(words))
        assert np.allclose(small.rows(words), large.rows(words))


def test_names_that_clash_with_no_column(spark):
    df = spark.createDataFrame([(1, 2)], "_key long, _KEY_ long")
    assert common.fresh(df, "_key", "x") == ["_key__", "x"]


def test_bounded_sample_is_repeatable(spark):
    df = spark.range(1000)
    a = {r.id for r in common.smallest_by_hash(df, "id", 50, 1).collect()}
    assert len(a) == 50 and a == {r.id for r in common.smallest_by_hash(df.repartition(7), "id", 50, 1).collect()}
    assert common.smallest_by_hash(df.filter("id < 0"), "id", 5, 1).count() == 0


def test_slices_cover_all_rows():
    texts = ["x" * n for n in (5, 0, 9, 1, 1, 30)]
    assert [i for a, b in common.in_slices(texts, 8) for i in range(a, b)] == list(range(6))
