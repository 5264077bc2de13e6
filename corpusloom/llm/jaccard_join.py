"""Jaccard join on word n-grams by chosen paths.

Sets are embedded as MinHash tokens. A run splits all sets on one token, buckets that stay large on another one
below it, and so on; sets that share a path meet in a bucket, small buckets are compared by brute force, and
runs repeat with other tokens until the wanted recall. What met is then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, of_texts, release_memos, staged
from corpusloom.llm.graph import components, fixed_width, whole_groups

#: MinHash tokens of a set. Depth of paths: a bucket is split at most DEPTH - 1 times.
TOKENS, DEPTH = 64, 3
#: Buckets of up to so many sets are compared by brute force; larger ones are split.
SMALL = 256
#: Sets, and shingles, of a block of exact comparison.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000
_RNG = np.random.default_rng(1)
_A, _B = (_RNG.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64))


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with this probability even if each bucket on its way had to be split to the end."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**DEPTH))


class Shingles:
    """Texts to sets of hashed word n-grams; words' hashes are remembered up to a bound."""

    def __init__(self, n: int, remember: int = 500_000):
        self.n, self.remember, self.hashes = n, remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the n-grams of lower-case, white-space separated words; of all words, if fewer than n."""
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.hashes
        if len(known) > self.remember:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.n, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for j in range(size):
            out = (out ^ h[j : len(h) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def min_hash(shingles: np.ndarray) -> np.ndarray:
    """TOKENS 32-bit minima."""
    out = np.full(TOKENS, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        out = np.minimum(out, ((shingles[i : i + 4096, None] * _A + _B) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, set_id (16 bytes, equal for equal sets; null for a text without words), n_shingles, tokens (bytes) per row."""

    def start():
        release_memos()
        shingles = Shingles(n)

        def work(texts: list[str | None]) -> pd.DataFrame:
            ids, sizes, tokens = [], [], []
            for text in texts:
                s = shingles(text)
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                tokens.append(min_hash(s).tobytes() if len(s) else None)
            return pd.DataFrame({"set_id": ids, "n_shingles": sizes, "tokens": tokens})

        return work

    made = of_texts("set_id binary, n_shingles int, tokens binary", start)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), made.alias("made"))
    return rows.select("doc_id", "text_hash", "made.*")


def _token(at) -> F.Column:
    """The token at a position (from 0) of the column tokens, as its four bytes."""
    return F.substring("tokens", at * 4 + 1, 4) if isinstance(at, int) else F.expr(f"substring(tokens, ({at}) * 4 + 1, 4)")


def meetings(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links (a, b) between set_ids that hold together all pairs which some run brings together and whose tokens don't rule them out."""
    runs = runs_for(threshold, recall)
    spare = (TOKENS - runs) // (DEPTH - 1)
    if spare < 1:
        raise ValueError(f"{runs} runs need more tokens")
    roots = F.explode(F.array(*[F.xxhash64(F.lit(r), _token(r)) for r in range(runs)]))
    rows = staged(sets.select("set_id", roots.alias("node")), "join-level")
    found: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        sizes = staged(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "join-sizes")
        sized = staged(rows.join(sizes, "node"), "join-sized")
        found.append(_brute_force(sized.filter(F.col("size") <= SMALL).join(sets, "set_id"), threshold))
        large = sized.filter(F.col("size") > SMALL)
        if large.isEmpty():
            break
        if depth == DEPTH:
            # What no path has split is nearly alike throughout: all go to the bucket's smallest set, and exact comparison decides.
            # Written, as other minima and counts below, so that Spark can split a hot bucket's rows: both sides of the join are plain exchanges.
            hub = staged(large.groupBy("node").agg(F.min("set_id").alias("b")), "join-hubs")
            found.append(large.join(hub, "node").select(F.col("set_id").alias("a"), "b"))
            break
        at = f"{runs + (depth - 1) * spare} + pmod(xxhash64(node, {depth}), {spare})"
        rows = staged(large.join(sets, "set_id").select("set_id", F.xxhash64("node", _token(at)).alias("node")), "join-level")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.filter("a <> b")


def _brute_force(members: DataFrame, threshold: float) -> DataFrame:
    """For rows (node, set_id, n_shingles, tokens): links that connect each bucket's sets as their tokens' likeness does.

    A pair is ruled out if its sizes differ too much for the threshold, or if it shares so few tokens that at
    the threshold this had a chance of about one in a million (five standard deviations).
    """
    least = TOKENS * threshold - 5 * math.sqrt(TOKENS * threshold * (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, "node"):
            ids, sizes = rows.column("set_id").to_pylist(), rows.column("n_shingles").to_numpy()
            tokens = fixed_width(rows.column("tokens"), 4 * TOKENS).view(np.uint32)
            begins, ends = bounds, np.append(bounds[1:], rows.num_rows)
            two = begins[ends - begins == 2]
            like = ((tokens[two] == tokens[two + 1]).sum(1) >= least) & (np.minimum(sizes[two], sizes[two + 1]) >= threshold * np.maximum(sizes[two], sizes[two + 1]))
            a, b = [ids[i] for i in two[like]], [ids[i + 1] for i in two[like]]
            for start, end in zip(begins, ends, strict=True):
                if end - start > 2:
                    t, s = tokens[start:end], sizes[start:end]
                    for i, j in forest(lambda i, t=t, s=s: ((t[i + 1 :] == t[i]).sum(1) >= least) & (np.minimum(s[i + 1 :], s[i]) >= threshold * np.maximum(s[i + 1 :], s[i])), end - start)[0]:
                        a.append(ids[start + i])
                        b.append(ids[start + j])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    rows = members.select("node", "set_id", "n_shingles", "tokens").repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(run, "a binary, b binary")


def forest(later, n: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect what the linked pairs of 0..n-1 connect, and each one's root. later(i): which of i+1.. are linked to i."""
    root, out = np.arange(n), []
    for i in range(n - 1):
        for j in np.flatnonzero(later(i)) + i + 1:
            if root[i] != root[j]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out, root


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right, exactly."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(x, y, True)) for y in right] for x in left])
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), True)
    column = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        column.append((at[hit][order], owner[hit][order]))
    for start in range(0, len(shared), 2048):
        dense = []
        for (at, owner), n in zip(column, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(at, [start, start + 2048])
            x = np.zeros((n, min(2048, len(shared) - start)), np.float32)
            x[owner[a:b], at[a:b] - start] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison of rows (pair, component, n_blocks, low, high, block, set_id, copies, shingles), a group per pair of blocks of a component.

    Returns links (a, b) that connect what is linked, and (a, null, links): how many documents a's set is linked to
    there. A component of one block is settled: its rows (a, b, settled) name the smallest set linked with a, near or far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        for table, bounds in whole_groups(batches, "pair"):
            a, b, n, settled = [], [], [], []
            for start, end in zip(bounds, np.append(bounds[1:], table.num_rows), strict=True):
                part = table.slice(start, end - start)
                # Pairs of blocks that share a hash are told apart here.
                where = np.stack([part.column(c).to_numpy() for c in ("component", "low", "high", "block", "n_blocks")], 1)
                for key in np.unique(where[:, :3], axis=0):
                    own = np.flatnonzero((where[:, :3] == key).all(1))
                    ids = [part.column("set_id")[int(i)].as_py() for i in own]
                    sets = [np.frombuffer(part.column("shingles")[int(i)].as_py(), np.uint64) for i in own]
                    copies, block = part.column("copies").to_numpy()[own], where[own, 3]
                    left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
                    if not len(left) or not len(right):
                        continue
                    both = overlaps([sets[i] for i in left], [sets[i] for i in right])
                    sizes = np.array([len(s) for s in sets])
                    # both / union >= threshold, without rounding at the threshold for sets of any practical size
                    linked = both * (1 + threshold) >= threshold * (sizes[left][:, None] + sizes[right][None, :]) - 1e-6
                    linked &= left[:, None] != right[None, :]
                    counts = np.zeros(len(own), np.int64)
                    counts[left] += linked @ copies[right]
                    if key[1] != key[2]:
                        counts[right] += linked.T @ copies[left]
                    whole = np.zeros((len(own), len(own)), bool)
                    whole[np.ix_(left, right)] = linked
                    whole |= whole.T
                    edges, root = forest(lambda i, w=whole: w[i, i + 1 :], len(own))
                    if where[own[0], 4] == 1:
                        first = {}
                        for i, r in enumerate(root):
                            first[r] = min(first.get(r, ids[i]), ids[i])
                        edges = [(i, first[r]) for i, r in enumerate(root)]
                    else:
                        edges = [(i, ids[j]) for i, j in edges]
                    found = np.flatnonzero(counts)
                    a += [ids[i] for i, _ in edges] + [ids[i] for i in found]
                    b += [x for _, x in edges] + [None] * len(found)
                    n += [None] * len(edges) + counts[found].tolist()
                    settled += [bool(where[own[0], 4] == 1)] * (len(edges) + len(found))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "links": pa.array(n, pa.int64()), "settled": pa.array(settled, pa.bool_())})

    rows = rows.repartition("pair").sortWithinPartitions("pair")
    return rows.mapInArrow(run, "a binary, b binary, links long, settled boolean")


def classes(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, n_shingles, kept for every row of docs.

    Documents are linked if the Jaccard likeness of their sets of n-word shingles (lower-case words between white
    space; all words of a text with fewer than n) reaches threshold; class_id is the smallest doc_id of the
    connected documents, n_links the number of other rows a row is linked to. Equal sets are one node with a
    number of copies, so copies are never expanded into pairs. A null or wordless text has no links and is a
    class of its own; with a null doc_id its class_id is null too. Rows with one doc_id are rows of their own.
    kept marks, of each class, the rows with the smallest doc_id (null last, then smallest hash of the text).
    """
    docs = docs.select("doc_id", "text")
    rows = staged(signatures(docs, n), "join-signatures")
    sets = rows.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.count("*").alias("copies"), F.min(_order()).alias("one"), F.min("tokens").alias("tokens"), F.min("n_shingles").alias("n_shingles"))
    sets = staged(sets, "join-sets")
    met = components(meetings(sets.select("set_id", "n_shingles", "tokens"), threshold, recall), "join-met")
    met = staged(met.select(F.col("node").alias("set_id"), F.col("root").alias("group")).join(sets.select("set_id", "copies", "one", "n_shingles"), "set_id"), "join-candidates")
    n_blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    blocks = staged(met.groupBy("group").agg(n_blocks.alias("n_blocks")), "join-blocks")
    placed = met.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("n_blocks")).cast("int"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memos()
        shingles = Shingles(n)
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.iloc[a : a + 1000]
                yield part.drop(columns="text").assign(shingles=[shingles(t).tobytes() for t in part["text"]])

    # One row's text per set: the document itself, found by id and text, not by id alone.
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    wanted = placed.select("set_id", "copies", F.xxhash64("group").alias("component"), "n_blocks", "block", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))
    # A merge join at every size: what is compared grows with the input, so it is never broadcast.
    with_text = texts.join(wanted.hint("merge"), (texts["text_hash"] == wanted["one_hash"]) & texts["doc_id"].eqNullSafe(wanted["one_id"]))
    built = with_text.select("set_id", "copies", "component", "n_blocks", "block", "text").mapInPandas(build, "set_id binary, copies long, component long, n_blocks int, block int, shingles binary")
    built = staged(built.dropDuplicates(["set_id"]), "join-shingles")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    pairs = built.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).withColumn("pair", F.xxhash64("component", "low", "high"))
    compared = staged(_compare(pairs.select("pair", "component", "n_blocks", "low", "high", "block", "set_id", "copies", "shingles"), threshold), "join-compared")
    linked = compared.filter("b IS NOT NULL AND settled").select(F.col("a").alias("set_id"), F.col("b").alias("root"))
    far = compared.filter("b IS NOT NULL AND NOT settled").select("a", "b")
    if not far.isEmpty():
        linked = linked.unionByName(components(far, "join-linked").select(F.col("node").alias("set_id"), "root"))
    counts = compared.filter("links IS NOT NULL").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    named = sets.select("set_id", "copies", "one").join(linked, "set_id", "left").join(counts, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = staged(named, "join-roots")
    lowest = staged(named.groupBy("root").agg(F.min("one").alias("first")), "join-lowest")
    named = named.join(lowest, "root").select("set_id", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    whole = rows.join(staged(named, "join-named"), "set_id", "left")
    alone = F.col("set_id").isNull()
    return whole.select(
        "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles", (alone | (_order() == F.col("first"))).alias("kept"),
    )


def _order() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The document of each class that classes() marks as kept, with the columns of docs unchanged.

    Documents without words are classes of their own and stay; of rows that repeat both id and text, one stays.
    """
    key, text = fresh(docs, "_key", "_hash")
    lowest = F.lit(-(2**63))
    kept = classes(docs, **options).filter("kept").select(F.coalesce("doc_id", lowest).alias(key), F.col("text_hash").alias(text)).distinct()
    rows = docs.withColumn(key, F.coalesce("doc_id", lowest)).withColumn(text, F.xxhash64("text"))
    return rows.join(kept, [key, text], "left_semi").dropDuplicates([key, text]).select(*docs.columns)


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), grams AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE n * 1.8 >= 0.8 * (len(x.s) + len(y.s)) - 1e-6
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, (SELECT min(b) FROM reach r WHERE r.a = s.doc_id) AS class_id,
       (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links, len(s.s)::INT AS n_shingles
FROM sets s
"""
