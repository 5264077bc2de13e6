"""Text quality: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees over binned features fills one lookup table per feature and per chosen pair of
features; a score is the sum of the looked-up values under a logistic curve.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_of_id, of_texts, one_per_id, smallest_by_hash, trained

FEATURES = (
    "log_chars", "log_words", "log_lines", "mean_word", "longest_word", "letters", "uppercase", "digits", "marks", "symbols",
    "distinct_words", "stutter", "commonest_word", "wordless", "short_words", "words_per_line", "repeated_lines", "ended_lines",
)

# Character classes: 0 other, 1 lower-case or caseless letter, 2 upper-case letter, 3 digit, 4 ordinary punctuation, 5 symbol, 6 white space.
_CLASSES = np.zeros(0x3000, np.uint8)
for _code in range(0x3000):
    _c = chr(_code)
    if _c.isspace():
        _CLASSES[_code] = 6
    elif _c.isalpha():
        _CLASSES[_code] = 2 if _c.isupper() else 1
    elif _c.isdigit():
        _CLASSES[_code] = 3
    else:
        _CLASSES[_code] = 4 if _c in ".,;:!?'\"()-" else 5


def features(text: str | None) -> list[float]:
    """The features of a whole text; a null text is an empty one."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_CLASSES[np.minimum(codes, 0x2FFF)], minlength=7) if len(codes) else np.zeros(7)
    high = int((codes >= 0x3000).sum())  # letters of scripts without case, for the most part
    if high:
        kinds[_CLASSES[0x2FFF]] -= high
        kinds[1] += high
    n, words, lines = max(len(text), 1), text.split(), text.split("\n")
    k = max(len(words), 1)
    ids: dict[str, int] = {}
    place = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    most = int(np.bincount(place).max()) if words else 0
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    letters = kinds[1] + kinds[2]
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), np.log1p(lengths.max()),
        letters / n, kinds[2] / max(letters, 1), kinds[3] / n, kinds[4] / n, kinds[5] / n,
        len(ids) / k, (place[1:] == place[:-1]).sum() / k, most / k, sum(not any(map(str.isalpha, w)) for w in ids) / max(len(ids), 1), (lengths <= 3).sum() / k,
        np.log1p(len(words) / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.endswith((".", "!", "?", ":")) for x in lines) / len(lines),
    ]


@dataclass
class QualityModel:
    """edges: each feature's bin edges; tables: a value per bin; pairs: ((i, j), coarse edges of i and j, a value per cell)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for (i, j), a, b, t in self.pairs:
            z += t[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return z


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(values) else np.zeros(0)


def _tree(grad: np.ndarray, hess: np.ndarray, least: float, leaves: int = 3) -> np.ndarray:
    """Values per bin of a tree over one binned feature: the best cut, then the best cut of a part, up to so many leaves."""
    parts = [(0, len(grad))]
    gains: dict[tuple[int, int], tuple[float, int]] = {}

    def best(a: int, b: int) -> tuple[float, int]:
        g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
        if b - a < 2:
            return 0.0, a
        gl, hl = g[:-1], h[:-1]
        gain = gl**2 / (hl + 1) + (g[-1] - gl) ** 2 / (h[-1] - hl + 1) - g[-1] ** 2 / (h[-1] + 1)
        gain[(hl < least) | (h[-1] - hl < least)] = 0
        return float(gain.max()), a + int(gain.argmax()) + 1

    while len(parts) < leaves:
        for p in parts:
            gains.setdefault(p, best(*p))
        p = max(parts, key=lambda q: gains[q][0])
        gain, cut = gains[p]
        if gain <= 0:
            break
        parts.remove(p)
        parts += [(p[0], cut), (cut, p[1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return out


def _cross(grad: np.ndarray, hess: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best tree with one cut of each of two binned features (four leaves)."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(grad)
    quarters = [(x[:-1, :-1], x[:-1, -1:] - x[:-1, :-1], x[-1:, :-1] - x[:-1, :-1], x[-1, -1] - x[:-1, -1:] - x[-1:, :-1] + x[:-1, :-1]) for x in (g, h)]
    gain = sum(a**2 / (b + 1) for a, b in zip(*quarters, strict=True)) - g[-1, -1] ** 2 / (h[-1, -1] + 1)
    gain = np.where(np.minimum.reduce(np.broadcast_arrays(*quarters[1])) < least / 4, 0, gain)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(grad)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = grad[rows, cols].sum() / (hess[rows, cols].sum() + 1)
    return float(gain.max()), out


def train(x: np.ndarray, y: np.ndarray, *, bins: int = 48, coarse: int = 8, rounds: int = 150, n_pairs: int = 6, rate: float = 0.1, least: float = 2.0) -> QualityModel:
    """Fit by cyclic boosting: every round gives each feature one shallow tree on the current residuals; then, with the features' tables as they are, every round does so for each pair.

    Pairs are those whose best four-leaf tree explains most of what the features alone leave. With one label
    only, or no rows, the score is the smoothed share of label 1 (0.5 without rows).
    """
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(set(y.tolist())) < 2:
        return QualityModel(base)
    k = x.shape[1]
    model = QualityModel(base, [_cuts(x[:, j], bins) for j in range(k)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    where = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            step = rate * np.clip(_tree(np.bincount(where[j], g, len(model.tables[j])), np.bincount(where[j], h, len(model.tables[j])), least), -4, 4)
            model.tables[j] += step
            z += step[where[j]]
    cuts = [_cuts(x[:, j], coarse) for j in range(k)]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(cuts)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(cuts[i]) + 1, len(cuts[j]) + 1)
        return np.bincount(cells[i] * shape[1] + cells[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {(i, j): _cross(grid(i, j, g), grid(i, j, h), least)[0] for i, j in combinations(range(k), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    tables = {p: np.zeros((len(cuts[p[0]]) + 1, len(cuts[p[1]]) + 1)) for p in chosen}
    for _ in range(rounds // 3):
        for i, j in chosen:
            g, h = slopes()
            step = rate * np.clip(_cross(grid(i, j, g), grid(i, j, h), least)[1], -4, 4)
            tables[i, j] += step
            z += step[cells[i], cells[j]]
    model.pairs = [(p, cuts[p[0]], cuts[p[1]], t) for p, t in tables.items()]
    return model


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 8000, seed: int = 10) -> QualityModel:
    """Learn labels.quality from at most fit_rows labels, up to half of them 0, whose crc32(doc_id) mod 5 is not 0.

    Labels that are null, or whose document is missing or null, aren't learned from. An id with several labels
    has the smallest, one with several texts is learned from by one of them.
    """
    usable = one_per_id(labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & (crc_of_id() % 5 != 0)), "doc_id", "quality")
    chosen = [smallest_by_hash(usable.filter(F.col("quality") == v), "doc_id", fit_rows // 2, seed).limit(fit_rows // 2) for v in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # bounded by fit_rows, so it may be broadcast
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = one_per_id(rows.withColumn("order", F.xxhash64("text")), "doc_id", "order", "text", "quality")

    def learn(rows: pd.DataFrame) -> QualityModel:
        rows = rows.sort_values("doc_id", kind="stable")
        return train(np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES)), rows["quality"].to_numpy().astype(float))

    return trained(rows.select("doc_id", "quality", _features().alias("x")), learn)


def _features() -> Column:
    return of_texts("array<double>", lambda: lambda texts: [features(t) for t in texts])


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= threshold) of every whole text. No shuffle.

    A null text is scored as an empty one. Rows stay as they are, repeated ones and null ids too: equal texts
    score alike, however long. An empty table gives no rows. Other columns of docs are left out, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(texts: list[str | None]) -> np.ndarray:
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            return 1 / (1 + np.exp(-np.clip(sent.value.logits(x), -40, 40)))

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of_texts("double", start).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. A null doc_id is not held out."""
    held = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    return score(docs, fit(docs, labels, fit_rows=fit_rows)).select("doc_id", held.alias("held_out"), "score", "predicted")
