import zlib

import numpy as np
import pytest

from corpusloom.llm import language_id, quality, toxicity
from tests.llm.test_common import documents

SF = "/root/testdata/sf0.1"


def crc(i):
    return zlib.crc32(str(i).encode())


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_languages_of_held_out_documents(spark):
    docs = read(spark, "documents")
    found = language_id.identify(docs, fit_rows=2000).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (found.held_out == found.doc_id.map(crc).mod(3).eq(1)).all() and len(found) == docs.count()
    assert (held.lang_pred == held.lang).mean() > 0.98 and found.score.between(0, 1).all() and found.rejected.mean() < 0.002


def test_languages_of_odd_texts(spark):
    fit = [(i, t, y, "s", 0) for i, (t, y) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 40)]
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "12 ² !?", "xx", "s", 0), (None, "the garden", "en", "s", 0), (1003, "das haus", None, "s", 0), (1003, "das haus", None, "s", 0)]
    docs = documents(spark, [(*r, 0.5) for r in fit + odd], ", score double")
    found = {(r.doc_id, r.lang_pred, r.rejected) for r in language_id.identify(docs).filter("doc_id >= 1000 OR doc_id IS NULL").collect()}
    assert found == {(1000, "und", True), (1001, "und", True), (1002, "und", True), (None, "en", False), (1003, "de", False)}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 83 and {r.score for r in kept.collect()} == {0.5}


def test_languages_without_labels(spark):
    docs = documents(spark, [(1, "text", None, None, 0)])
    assert [r.lang_pred for r in language_id.identify(docs).collect()] == ["und"] and language_id.identify(documents(spark, [])).count() == 0


def test_toxicity_of_held_out_documents(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (found.held_out == found.doc_id.map(crc).mod(3).eq(1)).all()
    # A third of the toxic labels of this table stand on documents without any insult.
    assert held[held.toxic == 1].predicted.mean() > 0.6 and held[held.toxic == 0].predicted.mean() < 0.02
    assert (found.predicted == (found.score >= 0.7)).all()


def test_misspellings_share_subwords():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("aeioutnsr"), rng.integers(2, 8)))
    texts = [[word() for _ in range(30)] for _ in range(400)]
    for i in range(0, 400, 2):
        texts[i][5] = ["moron", "idiot", "stupid"][i // 2 % 3]
    model = toxicity.train([" ".join(t) for t in texts], [1 - i % 2 for i in range(400)])
    from corpusloom.llm.common import WordScores

    z = toxicity.document_logits([["tea", w, "ran"] for w in ("moron", "morron", "idiott", "stupidd", "train", "season")], WordScores(model.table), model)
    s = 1 / (1 + np.exp(-(model.slope * z + model.offset)))
    assert s[:4].min() > s[4:].max() and (s[:4] > 0.5).sum() >= 3 and (s[4:] < 0.3).all()


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark, [(1, None, None, None, 0), (None, "a b", None, None, 0), (2, "", None, None, 0)])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, empty)
    assert [(r.score, r.predicted) for r in found.orderBy("doc_id").collect() if r.doc_id] == [(0.0, 0), (0.0, 0)] and found.count() == 3
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, odd).count() == 3


def test_quality_of_held_out_documents(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    found = quality.quality(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (found.held_out == found.doc_id.map(crc).mod(5).eq(0)).all()
    assert held[held.quality == 1].predicted.mean() > 0.99 and held[held.quality == 0].predicted.mean() < 0.1


def test_quality_tables_are_the_sum_of_their_parts():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing but an interaction
    model = quality.train(x, y, n_pairs=2)
    assert {p for p, *_ in model.pairs} >= {(0, 1)}
    assert ((model.logits(x) > 0) == (y == 1)).mean() > 0.9
    by_hand = model.base + sum(t[np.searchsorted(e, x[7, j], "right")] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    by_hand += sum(t[np.searchsorted(a, x[7, i], "right"), np.searchsorted(b, x[7, j], "right")] for (i, j), a, b, t in model.pairs)
    assert model.logits(x[7:8])[0] == pytest.approx(by_hand)


def test_quality_of_odd_rows(spark):
    docs = documents(spark, [(1, None, None, None, 0), (None, "漢字 \x00", None, None, 0), (2, "", None, None, 0), (2, "", None, None, 0)])
    found = quality.quality(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(found) == 4 and {r.score for r in found} == {0.5}
    assert quality.features(None) == quality.features("") and all(np.isfinite(quality.features("\ud800 x" * 5)))


def test_languages_left_out_of_training_are_rejected(spark):
    docs = read(spark, "documents")
    texts = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id < 4000").toPandas()
    for learned, other in ((["de", "en", "es"], "fr"), (["en", "fr"], "de")):
        fit, rest = texts.iloc[:2000], texts.iloc[2000:]
        own = fit[fit.lang.isin(learned)]
        model = language_id.train(list(own.text), list(own.lang))
        rows = rest[rest.lang.isin([*learned, other])].reset_index(drop=True)
        junk = ["".join(chr(97 + (i * 7 + j * j * 11 + i * j) % 26) + " " * (j % 6 == 5) for j in range(400)) for i in range(50)]
        found = language_id.predict(spark.createDataFrame([(i, t) for i, t in enumerate([*rows.text, *junk])], "i int, text string"), model).orderBy("i").toPandas()
        gone = found.rejected[: len(rows)].groupby(rows.lang.isin(learned)).mean()
        print(learned, "rejected of", other, gone[False], "of learned ones", gone[True], "of junk", found.rejected[len(rows) :].mean())
        assert gone[False] > 0.95 and gone[True] < 0.01 and found.rejected[len(rows) :].mean() > 0.95
