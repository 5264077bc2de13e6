"""Benchmark decontamination: rare words and word pairs of test items find places in documents, Smith-Waterman alignment judges them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, in_slices, of_texts

WORDS = re.compile(r"\w+")
#: Items of fewer words must be met word for word.
N = 3
#: Test items, and characters of them, that are sent to the executors at once: more are worked off in blocks.
ITEM_BLOCK, BLOCK_CHARACTERS = 5_000, 50_000_000
#: Longer items are aligned in passages of so many words.
PASSAGE = 2_000
MATCH, MISMATCH, GAP = 2, -1, -1
FOUND = "item_id bigint, score double, first_word int, last_word int"
FIELDS = ("item_id", "score", "first_word", "last_word")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Items:
    """A block of test items, long ones in passages, as numbers of a vocabulary of their words, with their features.

    Features of an item are its words and its pairs of neighbouring words. An alignment with M matches and E
    mismatches and gaps scores 2 M - E and keeps at least M - E - 1 pairs, so one that reaches 2 t L on L words has
    2 t L - 1 features at least. Whatever features an item leaves out, a copy has all but so many of the others:
    the rare ones are its seeds, and `least` of them must stand in a window. No copy is lost, however it is edited.

    grams: sorted keys of all features; (item, starts) the items that have grams[k], by position.
    """

    def __init__(self, rows: list[tuple[int, str]], threshold: float):
        pairs = [(i, part) for i, t in rows for w in [words_of(t)] for a in range(0, len(w), PASSAGE) if len(part := w[a : a + PASSAGE]) >= min(N, len(w))]
        self.ids = [i for i, _ in pairs]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64) for _, w in pairs]
        self.base = len(self.vocabulary) + 1
        lengths = np.array([len(w) for w in self.words], np.int64)
        #: The least score of a copy, and the most words of a document that a copy can span.
        self.wanted = np.where(lengths < N, MATCH * lengths, np.ceil(MATCH * threshold * lengths - 1e-9)).astype(np.int64)
        self.span = np.maximum(3 * lengths - self.wanted, 1)
        keys = [np.concatenate([w, self.pairs(w)]) for w in self.words]
        self.index(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys) if keys else np.zeros(0, np.int64))
        self.members = np.unique(np.concatenate([i * self.base + w for i, w in enumerate(self.words)])) if keys else np.zeros(0, np.int64)

    def index(self, item: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.item = item[order]
        self.grams, self.starts = np.unique(key[order], return_index=True)
        self.sizes = np.diff(np.append(self.starts, len(order)))

    def pairs(self, words: np.ndarray) -> np.ndarray:
        """A number for each pair of neighbouring words, unlike those of words; -1 where a word is unknown."""
        return np.where((words[:-1] >= 0) & (words[1:] >= 0), (words[:-1] + 1) * self.base + words[1:], -1)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in words at which a known feature starts, and which it is."""
        if not len(self.grams):
            return words[:0], words[:0]
        out = []
        for keys in (words, self.pairs(words)):
            at = np.flatnonzero(keys >= 0)
            k = np.minimum(np.searchsorted(self.grams, keys[at]), len(self.grams) - 1)
            same = self.grams[k] == keys[at]
            out.append((at[same], k[same]))
        return np.concatenate([a for a, _ in out]), np.concatenate([k for _, k in out])

    def choose_seeds(self, counts: np.ndarray) -> None:
        """counts: of each feature in the corpus. They decide how many places are looked at, not what is found."""
        common, key = np.repeat(counts, self.sizes), np.repeat(self.grams, self.sizes)
        order = np.lexsort((-key, common, self.item))
        item, key = self.item[order], key[order]
        n = np.bincount(item, minlength=len(self.words))
        must = np.maximum(self.wanted - 1, 0)
        self.least = np.maximum(must // 3, 1)
        take = np.where(must > 0, n - must + self.least, n)
        place = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        seed = place < np.repeat(take, n)
        # A word of a document answers to one place of an item: a feature counts once for each time it is met.
        both = np.unique(np.stack([item[seed], key[seed]]), axis=1)
        self.index(both[0], both[1])


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two number sequences, and where it ends in each (last positions)."""
    slope = GAP * np.arange(len(b) + 1)
    above, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    for i, x in enumerate(a):
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(b == x, MATCH, MISMATCH))
        row = np.maximum.accumulate(row - slope) + slope  # gaps along b
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j - 1)
        above = row
    return best


def places(words: np.ndarray, text: np.ndarray, within: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, low, high): stretches of words, by their number in all texts, that hold every alignment with the wanted score.

    words: of several texts, with an unknown one after each. text, within: each word's text, and its number in it.
    """
    at, gram = items.hits(words)
    if not len(at):
        return
    n = items.sizes[gram]
    item = items.item[np.repeat(items.starts[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    at = np.repeat(at, n)
    # Cells as long as a copy can be: two neighbours hold it, and have its seeds.
    cells = int((within.max() // items.span.min())) + 2
    key, count = np.unique((item * (int(text[-1]) + 1) + text[at]) * cells + within[at] // items.span[item], return_counts=True)
    least = items.least[key // (cells * (int(text[-1]) + 1))]
    near = np.append(np.diff(key) == 1, False)
    both = near & (count + np.append(count[1:], 0) >= least)
    good = (count >= least) | both
    good[1:] |= both[:-1]
    key = key[good]
    first = np.searchsorted(text, np.arange(int(text[-1]) + 1))
    for part in np.split(key, np.flatnonzero(np.diff(key) > 1) + 1):
        if not len(part):
            continue
        owner, cell = divmod(int(part[0]), cells)
        i, t = divmod(owner, int(text[-1]) + 1)
        low = int(first[t]) + cell * int(items.span[i])
        # One cell with enough seeds may share its copy with a neighbour that has none.
        low, high = max(int(first[t]), low - int(items.span[i])), low + (len(part) + 1) * int(items.span[i])
        high = min(high, int(first[t + 1]) if t + 1 < len(first) else len(words))
        # No alignment scores more than a match for every word of the item and a mismatch for every other.
        keys = i * items.base + words[low:high]
        spot = np.minimum(np.searchsorted(items.members, keys), len(items.members) - 1)
        total = np.cumsum(np.where((items.members[spot] == keys) & (words[low:high] >= 0), MATCH, MISMATCH))
        if (total - np.minimum(np.minimum.accumulate(np.append(0, total[:-1])), 0)).max() >= items.wanted[i]:
            yield t, i, low, high


def matches(texts: list[str | None], items: Items) -> list[list[tuple[int, float, int, int]]]:
    """For each text (item id, score, first word, last word) of the best alignment of each item, or of a passage of it, that reaches what the item wants."""
    found: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
    for a, b in in_slices([t or "" for t in texts], 1_000_000):
        split = [words_of(t) for t in texts[a:b]]
        sizes = np.array([len(w) + 1 for w in split])
        words = np.full(int(sizes.sum()), -1, np.int64)
        begin = np.cumsum(sizes) - sizes
        for s, w in zip(begin, split, strict=True):
            words[s : s + len(w)] = items.numbers(w)
        text = np.repeat(np.arange(b - a), sizes)
        for t, i, low, high in places(words, text, np.arange(len(words)) - begin[text], items):
            item = items.words[i]
            points, i_end, end = align(item, words[low:high])
            score = points / (MATCH * len(item))
            if points >= items.wanted[i] and score > found[a + t].get(items.ids[i], (0.0,))[0]:
                back = align(item[: i_end + 1][::-1], words[low : low + end + 1][::-1])
                found[a + t][items.ids[i]] = (score, low + end - back[2] - int(begin[t]), low + end - int(begin[t]))
    return [[(i, *best) for i, best in f.items()] for f in found]


def feature_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each feature of the block's items stands in the documents, all of them. A task sends a row per feature met."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = sent.value
        total = np.zeros(len(items.grams), np.int64)
        for batch in batches:
            for a, b in in_slices(batch["text"].tolist(), 1_000_000):
                # Texts as one row of words with an unknown one after each, so that no pair spans two.
                words = [w for text in batch["text"][a:b] for w in (*words_of(text), None)]
                total += np.bincount(items.hits(items.numbers(words))[1], minlength=len(total))
        met = np.flatnonzero(total)
        yield pd.DataFrame({"gram": met, "n": total[met]})

    rows = docs.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(items.grams), np.int64)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


@dataclass
class Block:
    items: DataFrame

    def load(self, docs: DataFrame, threshold: float) -> Items:
        items = Items(sorted((r.item_id, r.text) for r in self.items.collect()), threshold)
        items.choose_seeds(feature_counts(docs, items))
        return items


def blocks(benchmark: DataFrame) -> list[Block]:
    """The usable items in blocks of about ITEM_BLOCK items and BLOCK_CHARACTERS by a hash of id and text, so that a text of many items spreads too: one, but for very large benchmarks."""
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    count, characters = usable.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(-(-count // ITEM_BLOCK), -(-(characters or 0) // BLOCK_CHARACTERS))
    return [Block(usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)) for i in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word for every document and test item that it holds a copy of, edited or not.

    Words are runs of letters, digits and underscores, in lower case. They are aligned (2 for a match, -1 for a
    mismatch or gap); score is the best sum over that of an unchanged copy, and must reach threshold. Places are
    aligned where seeds stand, rare words and pairs of an item so many that every such copy has some (see Items).
    Items of over 2,000 words are aligned in passages of so many, and the best counts, as it does for rows that
    share an item_id. Items of one or two words must stand in a document word for
    word. Null texts and ids of items, and items without words, take no part; a document row may repeat, be very
    long, or have a null id, and gives its own results; equal scores count for the first place. Other columns of
    docs are left out, whatever their names. No document is shuffled.
    """
    spark, found = docs.sparkSession, None
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(block.load(docs, threshold))
        look = of_texts(f"array<struct<{FOUND}>>", lambda sent=sent: lambda texts: [[dict(zip(FIELDS, m, strict=True)) for m in found] for found in matches(texts, sent.value)])
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(look))
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], f"doc_id long, {FOUND}") if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The documents without any test item, as find_leaks() judges, with their columns unchanged."""
    whole = docs  # features are counted over all documents: what a block has dropped is not judged again for each later one
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block.load(whole, threshold))
        (mark,) = fresh(docs, "_leaks")
        clean = of_texts("boolean", lambda sent=sent: lambda texts: [not m for m in matches(texts, sent.value)])
        docs = docs.withColumn(mark, clean).filter(F.col(mark)).drop(mark)
    return docs
