"""Toxicity: subword-bag embeddings averaged over short windows into a linear softmax, trained jointly in numpy.

A document's label says that some place in it is toxic, so a document is scored by its most toxic window, and
training lets each toxic document teach by the windows that the model so far finds most toxic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WordScores, crc_of_id, hashed_subwords, in_slices, of_texts, one_per_id, smallest_by_hash, trained

WORDS = re.compile(r"\w+")


@dataclass
class ToxicModel:
    """table: a logit per subword bucket (embeddings times the weights' difference). slope and offset turn a document's highest window logit into a score."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float
    span: int


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def window_logits(sums: np.ndarray, lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean logit of the window that starts at each word, -inf where a document has no full window left.

    sums: (words, 2), each word's sum of logits and number of subwords, document after document. A document
    with fewer words than span has one window. Returns the logits and the windows' lengths in words.
    """
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(sums))
    stop = np.minimum(at + span, ends)
    run = np.concatenate([np.zeros((1, 2)), np.cumsum(sums, axis=0, dtype=np.float64)])
    total = run[stop] - run[at]
    logits = total[:, 0] / np.maximum(total[:, 1], 1)
    logits[(at + span > ends) & (at > starts)] = -np.inf
    return logits, stop - at


def train(texts: list[str], toxic: list[int], *, buckets: int = 2**18, dim: int = 8, span: int = 2, rounds: int = 10, rate: float = 8.0, seed: int = 3) -> ToxicModel:
    """Fit on labelled texts; a fifth of them calibrates. With only one label the score is that label's."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = []
    for t, label in zip(texts, toxic, strict=True):
        if w := words_of(t):
            docs.append((np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for x in w), np.int32, len(w)), int(label)))
    if len({y for _, y in docs}) < 2:
        return ToxicModel(np.zeros((buckets, 1), np.float32), 0.0, 0.0, 40.0 if docs and docs[0][1] else -40.0, span)
    order = rng.permutation(len(docs))
    held, fit = order[: len(docs) // 5], order[len(docs) // 5 :]
    if len({docs[i][1] for i in held}) < 2 or len({docs[i][1] for i in fit}) < 2:
        held = fit = order
    flat = [docs[i][0] for i in fit]
    y = np.array([docs[i][1] for i in fit])
    owner, ids = hashed_subwords(list(vocabulary), buckets)
    first = np.argsort(owner, kind="stable")
    ids, per_word = ids[first], np.bincount(owner, minlength=len(vocabulary))
    at_word = np.concatenate([[0], np.cumsum(per_word)])
    # Start: how much likelier a toxic document is to hold the subword, smoothed.
    share = []
    for label in (0, 1):
        counts = np.bincount(np.concatenate([np.unique(f) for f, v in zip(flat, y, strict=True) if v == label]), minlength=len(vocabulary))
        share.append((np.bincount(ids, np.repeat(counts, per_word), buckets) + 10) / (sum(y == label) + 20))
    embed = rng.normal(0, 0.05, (buckets, dim))
    embed[:, 0] = np.log(share[1] / share[0])
    weights = rng.normal(0, 0.05, (dim, 2))
    weights[0] = (-0.5, 0.5)
    bias = np.zeros(2)
    words, lengths = np.concatenate(flat), np.array([len(f) for f in flat])
    starts = np.cumsum(lengths) - lengths
    for r in range(rounds):
        table = embed @ (weights[:, 1] - weights[:, 0])
        sums = np.stack([np.add.reduceat(table[ids], at_word[:-1]), per_word], 1)[words]
        logits, size = window_logits(sums, lengths, span)
        chosen, labels = [], []
        for i, (a, n) in enumerate(zip(starts, lengths, strict=True)):
            own = logits[a : a + n]
            k = min(n, 2 if y[i] else 3)
            top = np.argpartition(-own, k - 1)[:k]
            chosen += [a + j for j in top if own[j] > -np.inf]
            labels += [y[i]] * int((own[top] > -np.inf).sum())
        chosen, labels = np.array(chosen), np.array(labels)
        cost = len(labels) / 2 / np.bincount(labels, minlength=2)[labels]
        for _ in range(2):
            for batch in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 128)):
                lr = rate * (1 - r / rounds)
                members = [words[chosen[j] : chosen[j] + size[chosen[j]]] for j in batch]
                bag = np.repeat(np.arange(len(batch)), [int(per_word[m].sum()) for m in members])
                sub = np.concatenate([ids[at_word[w] : at_word[w + 1]] for m in members for w in m])
                kept = rng.random(len(sub)) < 0.5  # a word must be known by any half of its subwords
                bag, sub = bag[kept], sub[kept]
                n = np.maximum(np.bincount(bag, minlength=len(batch)), 1)[:, None]
                mean = np.stack([np.bincount(bag, embed[sub, d], len(batch)) for d in range(dim)], 1) / n
                z = mean @ weights + bias
                wrong = np.exp(z - z.max(1, keepdims=True))
                wrong /= wrong.sum(1, keepdims=True)
                wrong[np.arange(len(batch)), labels[batch]] -= 1
                wrong *= cost[batch][:, None]
                back = wrong @ weights.T / n
                weights -= 0.1 * lr * mean.T @ wrong / len(batch)
                bias -= 0.1 * lr * wrong.mean(0)
                np.subtract.at(embed, sub, lr * back[bag])
    model = ToxicModel((embed @ (weights[:, 1] - weights[:, 0])).astype(np.float32)[:, None], float(bias[1] - bias[0]), 1.0, 0.0, span)
    spelled, scores = list(vocabulary), WordScores(model.table, remember=len(vocabulary))
    best = np.concatenate([document_logits([[spelled[j] for j in docs[i][0]]], scores, model) for i in held])
    model.slope, model.offset = _platt(best, np.array([docs[i][1] for i in held], float))
    return model


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with smoothed targets so that separable data stay finite."""
    mean, spread = z.mean(), z.std() + 1e-9
    x = np.stack([(z - mean) / spread, np.ones(len(z))], 1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def document_logits(bags: list[list[str]], scores: WordScores, model: ToxicModel) -> np.ndarray:
    """Each document's highest window logit; every bag holds a word at least."""
    scores.learn(set().union(*bags))
    lengths = np.array([len(b) for b in bags])
    logits, _ = window_logits(scores.rows([w for b in bags for w in b]), lengths, model.span)
    return np.maximum.reduceat(logits, np.cumsum(lengths) - lengths) + model.bias


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 7000, seed: int = 3) -> ToxicModel:
    """Learn labels.toxic from at most fit_rows labels, up to 3/7 of them toxic, whose crc32(doc_id) mod 3 is not 1.

    Labels that are null, or whose document is missing or null, aren't learned from. An id with several labels
    has the smallest, one with several texts is learned from by one of them.
    """
    usable = one_per_id(labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & (crc_of_id() % 3 != 1)), "doc_id", "toxic")
    most = {1: fit_rows * 3 // 7, 0: fit_rows - fit_rows * 3 // 7}
    chosen = [smallest_by_hash(usable.filter(F.col("toxic") == v), "doc_id", n, seed).limit(n) for v, n in most.items()]
    chosen = chosen[0].unionByName(chosen[1])  # bounded by fit_rows, so it may be broadcast
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    sample = one_per_id(rows.withColumn("order", F.xxhash64("text")), "doc_id", "order", "text", "toxic")

    def learn(rows: pd.DataFrame) -> ToxicModel:
        rows = rows.sort_values(["doc_id", "toxic", "text"])
        return train(list(rows["text"]), list(rows["toxic"]), seed=seed)

    return trained(sample, learn)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= threshold) of every whole text. No shuffle.

    A null text, or one without a word, scores 0. Rows stay as they are, repeated ones and null ids too: equal
    texts score alike, however long. An empty table gives no rows. Other columns of docs are left out, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = sent.value
        scores = WordScores(model.table)

        def work(texts: list[str | None]) -> np.ndarray:
            out = np.zeros(len(texts))
            for a, b in in_slices(texts):
                bags = [words_of(t) for t in texts[a:b]]
                full = [i for i, x in enumerate(bags) if x]
                if full:
                    z = model.slope * document_logits([bags[i] for i in full], scores, model) + model.offset
                    out[[a + i for i in full]] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of_texts("double", start).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 7000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. A null doc_id is not held out."""
    held = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    return score(docs, fit(docs, labels, fit_rows=fit_rows)).select("doc_id", held.alias("held_out"), "score", "predicted")
