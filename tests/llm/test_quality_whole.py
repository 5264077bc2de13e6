"""The registered quality query against scores made by plain loops, on every document of a table."""

import math
import zlib

import pytest

from corpusloom.llm import quality
from corpusloom.llm.queries import op10_quality

SF = "/root/testdata/sf0.001"


def by_hand(text):
    """The features of a text, character by character and word by word."""
    kinds = dict.fromkeys(["letter", "upper", "digit", "mark", "symbol"], 0)
    for c in text:
        if c.isspace():
            continue
        if ord(c) >= 0x3000 or c.isalpha():
            kinds["upper" if ord(c) < 0x3000 and c.isupper() else "letter"] += 1
        elif c.isdigit():
            kinds["digit"] += 1
        else:
            kinds["mark" if c in ".,;:!?'\"()-" else "symbol"] += 1
    words, lines, n = text.split(), text.split("\n"), max(len(text), 1)
    letters, k = kinds["letter"] + kinds["upper"], max(len(words), 1)
    lengths = [len(w) for w in words] or [0]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log(1 + len(text)), math.log(1 + len(words)), math.log(1 + len(lines)), sum(lengths) / len(lengths), math.log(1 + max(lengths)),
        letters / n, kinds["upper"] / max(letters, 1), kinds["digit"] / n, kinds["mark"] / n, kinds["symbol"] / n,
        len(set(words)) / k, repeats / k, max([words.count(w) for w in set(words)] or [0]) / k, sum(not any(c.isalpha() for c in w) for w in set(words)) / max(len(set(words)), 1),
        sum(x <= 3 for x in lengths) / k, math.log(1 + len(words) / len(lines)), 1 - len(set(lines)) / len(lines), sum(x[-1:] in tuple(".!?:") and x != "" for x in lines) / len(lines),
    ]


def bin_of(edges, value):
    return sum(e <= value for e in edges)


def test_every_score_is_the_sum_of_its_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.tables) == len(quality.FEATURES) and model.pairs
    found = {r.doc_id: r for r in op10_quality(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        own, library = by_hand(r.text or ""), quality.features(r.text)
        assert own == pytest.approx([float(v) for v in library], abs=1e-9)
        # Bins by the library's own numbers: a hand-made one may differ in the last digit, on an edge.
        x = [float(v) for v in library]
        z = model.base + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        z += sum(t[bin_of(a, x[i]), bin_of(b, x[j])] for (i, j), a, b, t in model.pairs)
        score = 1 / (1 + math.exp(-max(-40, min(40, z))))
        got = found[r.doc_id]
        assert got.score == pytest.approx(score, abs=1e-12) and got.predicted == int(score >= 0.3)
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_no_label_of_a_held_out_row_is_learned_from(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").collect()
    turned = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.quality is not None else r.quality, r.toxic) for r in labels]
    models = [quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")) for rows in ([tuple(r) for r in labels], turned)]
    assert models[0].base == models[1].base and all((a == b).all() for a, b in zip(models[0].tables, models[1].tables, strict=True))
