"""Maximum inner product search with score-aware (anisotropic) product quantisation.

A vector is a coarse centre and what is left, as a length and a direction in codes of four bits a subspace: near
copies, which share a centre, differ by directions at their own scale. Quantisation errors along a vector change
its inner products with the queries that matter more than errors across it, so codebooks and codes minimise a loss that weighs
the parallel part of the error more. A query scans the codes through lookup tables; the best of each block are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import one_per_id, smallest_by_hash, staged, trained

CENTRES = 16


@dataclass
class Codebooks:
    """coarse: (parts, dim). centres: (subspaces, 16, width), of directions. parallel: weight of the squared parallel error relative to the perpendicular one."""

    coarse: np.ndarray
    centres: np.ndarray
    parallel: float

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.centres.shape
        full = np.zeros((len(x), m * width))
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), m, width)

    def residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest coarse centre of each row, and the length and direction of what is left."""
        part = nearest_centres(x, self.coarse)
        rest = x - self.coarse[part]
        length = np.linalg.norm(rest, axis=1)
        return part, length, rest / np.maximum(length, 1e-300)[:, None]

    def encode(self, x: np.ndarray, way: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """(rows, subspaces) codes of directions by coordinate descent on the anisotropic loss of the vectors x, from the nearest centres."""
        parts, m = self.split(way), len(self.centres)
        unit = self.split(x) / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        square = np.stack([((parts[:, j, None] - self.centres[j]) ** 2).sum(2) for j in range(m)], 1)
        along = np.stack([np.einsum("nkw,nw->nk", parts[:, j, None] - self.centres[j], unit[:, j]) for j in range(m)], 1)
        codes, rows = square.argmin(2), np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[rows, j, codes[:, j]]
                codes[:, j] = (square[:, j] + (self.parallel - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
                total = rest + along[rows, j, codes[:, j]]
        return codes.astype(np.uint8)


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (0.5 * (centres**2).sum(1) - x @ centres.T).argmin(1)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, ::2] << 4 | codes[:, 1::2]


def train(x: np.ndarray, *, parts: int = 256, width: int = 2, threshold: float = 0.2, rounds: int = 4, seed: int = 2) -> Codebooks:
    """Fit coarse centres by k-means, then codebooks of directions: k-means in each subspace, and rounds of anisotropic codes and least-squares centres.

    threshold: the cosine from which inner products matter; it sets the parallel weight (d - 1) t^2 / (1 - t^2).
    """
    rng, n = np.random.default_rng(seed), len(x)
    d = x.shape[1]
    m = -(-d // width)
    coarse = x[rng.choice(n, min(parts, n), replace=False)]
    for _ in range(6):
        near = nearest_centres(x, coarse)
        for k in np.unique(near):
            coarse[k] = x[near == k].mean(0)
    book = Codebooks(coarse, np.zeros((m, CENTRES, width)), max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))
    _, _, way = book.residuals(x)
    pieces = book.split(way)
    for j in range(m):
        centres = pieces[rng.choice(n, CENTRES, replace=n < CENTRES), j]
        for _ in range(10):
            near = ((pieces[:, j, None] - centres) ** 2).sum(2).argmin(1)
            for k in np.unique(near):
                centres[k] = pieces[near == k, j].mean(0)
        book.centres[j] = centres
    unit = book.split(x) / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for _ in range(rounds):
        codes = book.encode(x, way)
        # Normal equations of the loss |r|^2 + (parallel - 1) (r.u)^2 in all centres at once.
        spots = (np.arange(m) * CENTRES + codes)[:, :, None] * width + np.arange(width)
        size = m * CENTRES * width
        design = np.zeros((n, size))
        design[np.arange(n)[:, None], spots.reshape(n, -1)] = unit.reshape(n, -1)
        left = (book.parallel - 1) * design.T @ design
        left[np.arange(size), np.arange(size)] += np.bincount(spots.ravel(), minlength=size) + 1e-6
        right = np.bincount(spots.ravel(), pieces.ravel(), size) + (book.parallel - 1) * design.T @ (way * unit.reshape(n, -1)[:, :d]).sum(1)
        # Centres without members keep their place.
        right += 1e-6 * book.centres.ravel()
        book.centres = np.linalg.solve(left, right).reshape(m, CENTRES, width)
    return book


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part: not null, no null or non-finite component, not all zero, of the commonest length."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select("vec_id", "embedding").filter(v.isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0))
    size = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("embedding") == F.lit(size[0] if size else 0))


def build_index(vectors: DataFrame, *, fit_rows: int = 4000, seed: int = 2) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, embedding, part (its coarse centre), length (of the rest), codes (bytes, of its direction) of every usable vector, written to the shared folder; codebooks fit in one task on fit_rows of them at most, chosen by a seeded hash; of rows that share a vec_id, the least."""
    good = usable(vectors)

    def learn(rows: pd.DataFrame) -> Codebooks | None:
        rows = rows.sort_values("vec_id", kind="stable")
        return train(np.array(rows["embedding"].tolist(), np.float64), seed=seed) if len(rows) else None

    book = trained(one_per_id(smallest_by_hash(good, "vec_id", fit_rows, seed), "vec_id", "embedding"), learn)
    if book is None:
        return good.select("vec_id", "embedding", F.lit(0).alias("part"), F.lit(0.0).alias("length"), F.lit(b"").alias("codes")), None
    sent = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                rows = batch.iloc[a : a + 2048]
                x = np.array(rows["embedding"].tolist(), np.float64)
                part, length, way = sent.value.residuals(x)
                yield rows.assign(part=part.astype(np.int32), length=length, codes=[c.tobytes() for c in pack(sent.value.encode(x, way))])

    return staged(good.mapInPandas(run, "vec_id long, embedding array<float>, part int, length double, codes binary"), "ann-index"), book


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, rows): the sum over bytes of a lookup in each query's 256-entry tables."""
    out = np.zeros((len(tables), len(codes)), np.float32)
    for j in range(codes.shape[1]):
        out += np.take(tables[:, j], codes[:, j], axis=1)
    return out


def search(index: DataFrame, book: Codebooks | None, queries: DataFrame, *, k: int = 20, rerank: int = 200, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of the index by inner product, but for itself.

    queries(query_id, embedding). Index and queries are hashed into blocks of about `block` rows; a task scans
    one pair of blocks and ranks the `rerank` best vectors by code exactly, in double precision: a twentieth of a block. Equal
    vectors are one candidate with all its ids, so that ties in score go to the smaller vec_id however many there are;
    rows that repeat a vec_id are candidates of their own. Blocks and results don't depend on the cluster. An empty index gives no rows.
    """
    if book is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Blocks as even as hashing makes them, of one size on every cluster.
    n, q = index.count(), queries.count()
    c_blocks, q_blocks = max(-(-n // block), 1), max(-(-q // block), 1)
    rows = index.select("vec_id", "embedding", "part", "length", "codes", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(c_blocks)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    asked = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    sent = index.sparkSession.sparkContext.broadcast(book)

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        book, mine = sent.value, mine.sort_values("vec_id", kind="stable")
        ids, every = mine["vec_id"].to_numpy(), np.array(mine["embedding"].tolist(), np.float64)
        # Equal vectors, which come with their ids in order, are one candidate.
        vectors, first, group = np.unique(every, axis=0, return_index=True, return_inverse=True)
        members = np.argsort(group.ravel(), kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(group.ravel()))])
        codes = np.frombuffer(b"".join(mine["codes"]), np.uint8).reshape(len(mine), -1)[first]
        part, length = mine["part"].to_numpy()[first], mine["length"].to_numpy().astype(np.float32)[first]
        found = []
        for a in range(0, len(theirs), 256):
            some = theirs.iloc[a : a + 256]
            asked, own = np.array(some["embedding"].tolist(), np.float64), some["query_id"].to_numpy()
            small = np.einsum("qmw,mkw->qmk", book.split(asked), book.centres)
            if small.shape[1] % 2:
                small = np.concatenate([small, np.zeros((len(asked), 1, CENTRES))], 1)
            tables = (small[:, ::2, :, None] + small[:, 1::2, None, :]).reshape(len(asked), -1, 256).astype(np.float32)
            rough = (asked @ book.coarse.T)[:, part] + scan(tables, codes) * length
            rough[~np.isfinite(rough)] = np.inf  # beyond single precision: ranked exactly
            take = min(rerank, len(vectors))
            near = np.argpartition(rough, len(vectors) - take, axis=1)[:, len(vectors) - take :]
            for i in range(len(asked)):
                exact = (vectors[near[i]] * asked[i]).sum(1)
                edge = np.sort(exact)[-min(k + 1, len(exact))]
                # The k smallest ids of each, and one more for the query's own.
                at = np.concatenate([members[bounds[v] : bounds[v + 1]][: k + 1] for v in near[i][exact >= edge]])
                at = at[ids[at] != own[i]]
                score = (every[at] * asked[i]).sum(1)
                top = np.lexsort((ids[at], -score))[:k]
                found.append((np.full(len(top), own[i]), ids[at][top], score[top]))
        return pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    near = rows.groupBy("qb", "cb").cogroup(asked.groupBy("qb", "cb")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest vectors of every row whose vec_id is divisible by `every`, by largest inner product; vectors that are not usable(), such as those of another length than most have, take no part."""
    index, book = build_index(vectors)
    queries = index.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(index, book, queries, k=k)
