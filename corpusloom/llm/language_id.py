"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WordScores, crc_of_id, fresh, hashed_subwords, in_slices, of_texts, one_per_id, release_memos, smallest_by_hash, trained

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Marks of known subwords; subwords that a text is taken to know beforehand, so that few words prove little.
KNOWN, PRIOR = 2**22, 60


@dataclass
class LanguageModel:
    """labels in order; table: a row of logits per subword bucket (embeddings times weights); known: packed marks of subwords met in training.

    A prediction is rejected if its score is below reject_below, or the share of unknown subwords above most_unknown.
    """

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    known: np.ndarray
    reject_below: float = 0.0
    most_unknown: float = 1.0

    def scores(self) -> WordScores:
        return WordScores(self.table, known=np.unpackbits(self.known).astype(bool))


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text and any(map(str.isalpha, text)) else []


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], *, buckets: int = 2**17, dim: int = 16, epochs: int = 4, least_steps: int = 1000, window: int = 40, rate: float = 0.5, seed: int = 5) -> LanguageModel:
    """Fit on labelled texts. Each epoch draws a window of words from anywhere in each text; a fifth of the texts calibrates.

    Calibration sets the temperature, and what is rejected: scores nearer to chance than a quarter of what all but one in
    a thousand right predictions reach, which spares texts in two languages, and texts with twice the unknown subwords that all but one in a thousand have.
    Without a text that has letters, the model has no labels and predicts `und` only.
    """
    rng, labels = np.random.default_rng(seed), sorted(set(langs))
    spelled: dict[str, str] = {}  # one string per word
    pairs = [([spelled.setdefault(x, x) for x in w], labels.index(y)) for t, y in zip(texts, langs, strict=True) if (w := words_of(t))]
    k = len(labels) if pairs else 0
    if not k:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, np.zeros(KNOWN // 8, np.uint8))
    order = rng.permutation(len(pairs))
    held, fit = order[: len(pairs) // 5], order[len(pairs) // 5 :]
    fit = fit if len(fit) else held
    embed, weights, bias = rng.normal(0, 0.1, (buckets, dim)), rng.normal(0, 0.1, (dim, k)), np.zeros(k)
    per_epoch = -(-len(fit) // 64)
    epochs = max(epochs, -(-least_steps // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), per_epoch):
            lr, step = rate * (1 - step / steps), step + 1
            bags = []
            for i in batch:
                words = pairs[i][0]
                length = int(rng.integers(1, window + 1))
                at = int(rng.integers(0, max(1, len(words) - length + 1)))
                bags.append(words[at : at + length])
            owner, ids = hashed_subwords([w for b in bags for w in b], buckets)
            owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])[owner]
            n = np.bincount(owner, minlength=len(bags))[:, None]
            mean = np.stack([np.bincount(owner, embed[ids, d], len(bags)) for d in range(dim)], 1) / n
            wrong = softmax(mean @ weights + bias)
            wrong[np.arange(len(bags)), [pairs[i][1] for i in batch]] -= 1
            back = wrong @ weights.T / n
            weights -= lr * mean.T @ wrong / len(bags)
            bias -= lr * wrong.mean(0)
            np.subtract.at(embed, ids, 4 * lr * back[owner])
    met, known = list(set().union(*(pairs[i][0] for i in fit))), np.zeros(KNOWN, bool)
    for a in range(0, len(met), 20_000):
        known[hashed_subwords(met[a : a + 20_000], KNOWN)[1]] = True
    model = LanguageModel(labels, (embed @ weights).astype(np.float32), bias, 1.0, np.packbits(known))
    if len(held):
        sizes = rng.integers(1, window + 1, len(held))
        bags = [pairs[i][0] if j % 2 else pairs[i][0][: sizes[j]] for j, i in enumerate(held)]
        (z, strange), y = _logits(bags, model.scores(), model), np.array([pairs[i][1] for i in held])
        at = np.arange(len(held))
        model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(z / t)[at, y] + 1e-12).mean())
        p = softmax(z / model.temperature)
        right = p.argmax(1) == y
        if right.any():
            model.reject_below = float(1 / k + (np.quantile(p.max(1)[right], 0.001) - 1 / k) / 4)
        model.most_unknown = float(2 * np.quantile(strange, 0.999) + 2 / len(held))
    return model


def _logits(bags: list[list[str]], scores: WordScores, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Logits, and shares of unknown subwords, of bags that hold a word each."""
    scores.learn(set().union(*bags))
    starts = np.cumsum([0, *map(len, bags[:-1])])
    sums = np.add.reduceat(scores.rows([w for b in bags for w in b]).astype(np.float64), starts)
    return sums[:, :-2] / sums[:, -2:-1] + model.bias, (sums[:, -2] - sums[:, -1]) / (sums[:, -2] + PRIOR)


def fit(docs: DataFrame, *, fit_rows: int = 6000, seed: int = 5) -> LanguageModel:
    """Learn from at most fit_rows documents with a lang whose crc32(doc_id) mod 3 is not 1, chosen by a seeded hash.

    Rows with a null doc_id, lang or text aren't learned from; of rows that share an id, one is.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_of_id() % 3 != 1))

    def learn(rows: pd.DataFrame) -> LanguageModel:
        rows = rows.sort_values(["doc_id", "lang", "text"])
        return train(list(rows["text"]), list(rows["lang"]), seed=seed)

    sample = smallest_by_hash(usable.withColumn("order", F.xxhash64("lang", "text")), "doc_id", fit_rows, seed)
    return trained(one_per_id(sample, "doc_id", "order", "text", "lang"), learn)


def _language(docs: DataFrame, model: LanguageModel) -> Column:
    """A struct column lang_pred, score, rejected of the texts of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        release_memos()
        model = sent.value
        scores = model.scores()

        def work(texts: list[str | None]) -> pd.DataFrame:
            pred, score, strange = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
            for a, b in in_slices(texts):
                bags = [words_of(t) for t in texts[a:b]]
                full = [i for i, x in enumerate(bags) if x] if model.labels else []
                if full:
                    at = [a + i for i in full]
                    z, strange[at] = _logits([bags[i] for i in full], scores, model)
                    p = softmax(z / model.temperature)
                    pred[at], score[at] = np.array(model.labels, object)[p.argmax(1)], p.max(1)
            return pd.DataFrame({"lang_pred": pred, "score": score, "rejected": (pred == UNKNOWN) | (score < model.reject_below) | (strange > model.most_unknown)})

        return work

    return of_texts("lang_pred string, score double, rejected boolean", start)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and rejected, from the whole text alone. No shuffle.

    score is the calibrated probability of lang_pred. A text that is null or without letters gets `und`, 0
    and rejected; with one learned lang every other text gets it. Texts whose score is near chance, or with too many
    subwords that no training text has, as in another language, keep their prediction but are rejected. Columns of docs with these names, in any case,
    are replaced. Equal texts get equal results, however long they are.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    (out,) = fresh(docs, "_language")
    return docs.withColumn(out, _language(docs, model)).select(*docs.columns, f"{out}.*")


def identify(docs: DataFrame, *, fit_rows: int = 6000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document. A null doc_id is not held out."""
    model = fit(docs, fit_rows=fit_rows)
    held = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, *, fit_rows: int = 6000) -> DataFrame:
    """The documents whose language is identified, with their columns unchanged: rejected ones go."""
    (out,) = fresh(docs, "_language")
    return docs.withColumn(out, _language(docs, fit(docs, fit_rows=fit_rows))).filter(~F.col(f"{out}.rejected")).drop(out)
