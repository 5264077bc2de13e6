"""Exact k-means on integer vectors: a vantage-point tree over the centroids, rebuilt and broadcast in each round.

Every vector searches the tree best first: the open node with the smallest lower bound comes next, and a node is
pruned only if its bound is above the distance found so far, so that equally near centroids are all looked at and
the smallest number wins. Bounds come from the triangle inequality; distances are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import staged

#: Up to this size of a component, squared distances of 2^20 components fit 64 bits; beyond it, Python's integers are used.
SMALL = 2**20
#: Sums leave a task in limbs of so many bits, which Spark adds.
LIMB, LIMBS = 40, 5
#: Bounds give way by this share, which is more than rounding can take.
SLACK = 1e-9
#: Vectors that search at a time.
SLICE = 4096


def as_integers(x: np.ndarray) -> np.ndarray:
    """floor(64 * x) of doubles, as 64-bit integers where all are small, else as Python's."""
    scaled = np.floor(64.0 * np.asarray(x, np.float64))
    if not scaled.size or np.abs(scaled).max() <= SMALL:
        return scaled.astype(np.int64)
    return np.array([int(v) for v in scaled.ravel()], object).reshape(scaled.shape)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    d = x - centre
    return np.einsum("ij,ij->i", d, d) if d.dtype == np.int64 else (d * d).sum(1)


@dataclass
class Node:
    """A vantage point, or a leaf's centroids; children are (node number, least and largest distance from the vantage point)."""

    point: int
    members: list[int]
    children: list[tuple[int, float, float]]


class VantageTree:
    """Nearest centroid of integer vectors; nodes are numbered from the root."""

    def __init__(self, centres: np.ndarray, leaf: int = 2):
        self.centres, self.nodes = centres, []
        self._grow(list(range(len(centres))), leaf)

    def _grow(self, members: list[int], leaf: int) -> int:
        number = len(self.nodes)
        if len(members) <= leaf:
            self.nodes.append(Node(-1, members, []))
            return number
        # The vantage point is the member farthest from the first one: its distances spread most.
        far = squared(self.centres[members], self.centres[members[0]])
        point = members[int(np.argmax(far))]
        rest = [m for m in members if m != point]
        away = np.sqrt(squared(self.centres[rest], self.centres[point]).astype(np.float64))
        self.nodes.append(Node(point, [point], []))
        order = np.argsort(away, kind="stable")
        for half in np.array_split(order, 2):
            if len(half):
                child = self._grow([rest[i] for i in half], leaf)
                self.nodes[number].children.append((child, float(away[half].min()), float(away[half].max())))
        return number

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row; of equally near centroids the smallest number."""
        n, rows = len(x), np.arange(len(x))
        best = np.zeros(n, np.int64 if x.dtype == np.int64 and self.centres.dtype == np.int64 else object)
        number, reach = np.full(n, -1), np.full(n, np.inf)
        bounds = np.full((n, len(self.nodes)), np.inf)  # of the open nodes of each row
        bounds[:, 0] = 0
        while True:
            node = bounds.argmin(1)
            # Inclusive: a node whose bound equals the best distance can hold an equally near centroid.
            live = np.flatnonzero((bounds[rows, node] <= reach * (1 + SLACK)) & np.isfinite(bounds[rows, node]))
            if not len(live):
                return number, best
            bounds[live, node[live]], chosen = np.inf, node[live]
            for k in np.unique(chosen):
                own, at = live[chosen == k], self.nodes[k]
                for m in at.members:
                    d = squared(x[own], self.centres[m])
                    better = (number[own] < 0) | (d < best[own]) | ((d == best[own]) & (m < number[own]))
                    won = own[better]
                    best[won], number[won] = d[better], m
                    reach[won] = np.sqrt(d[better].astype(np.float64))
                if at.children:
                    away = np.sqrt(d.astype(np.float64))  # a vantage point is its node's only member
                    for child, least, largest in at.children:
                        room = SLACK * (away + largest)
                        bounds[own, child] = np.maximum(0, np.maximum(away - largest, least - away) - room)


def kept(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and embedding of the vectors with dim components, none null, non-finite or beyond single precision."""
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= 3.5e38))
    return vectors.select("vec_id", "embedding").filter(v.isNotNull() & (F.size(v) == dim) & good)


def first_centres(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows with the smallest sha256 of "seed:vec_id", in order of the hash, then of the vector; rows without an id come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(key.alias("key"), "embedding").orderBy(F.asc_nulls_last("key"), "embedding").limit(k).collect()
    return as_integers(np.array([r.embedding for r in found], np.float64))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return as_integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _searched(batches: Iterator[pa.RecordBatch], tree: VantageTree, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            x = _matrix(part.column("embedding"), dim)
            yield part, x, *tree.nearest(x)


def limbs(value: int) -> list[int]:
    """An integer as limbs, the lowest first; the last one keeps the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & (2**LIMB - 1))
        value >>= LIMB
    return [*out, value]


def moved(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after a round: the exact floor of the mean of each one's vectors; those without vectors stay."""
    dim, sent = centres.shape[1], rows.sparkSession.sparkContext.broadcast(VantageTree(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(sent.value.centres)
        sums, counts = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for _, x, number, _ in _searched(batches, sent.value, dim):
            for c in np.unique(number):
                own = x[number == c]
                sums[c] += own.sum(0).astype(object)  # a slice's sum of small integers fits 64 bits
                counts[c] += len(own)
        at = np.flatnonzero(counts)
        flat = [limbs(int(v)) for c in at for v in sums[c]]
        columns = {"c": np.repeat(at, dim), "place": np.tile(np.arange(dim), len(at)), "n": np.repeat(counts[at], dim)}
        columns |= {f"l{i}": np.array([f[i] for f in flat], np.int64) for i in range(LIMBS)}
        yield from pa.table({name: pa.array(v, pa.int64()) for name, v in columns.items()}).to_batches()

    # A row per centroid and component from each task; what comes back has as many rows as the centroids have components.
    made = rows.select("embedding").mapInArrow(run, "c long, place long, n long, " + ", ".join(f"l{i} long" for i in range(LIMBS)))
    total = made.groupBy("c", "place").agg(*[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("n", *(f"l{i}" for i in range(LIMBS)))])
    out = [list(map(int, c)) for c in centres]
    for r in total.collect():
        out[r.c][r.place] = sum(int(r[f"l{i}"]) << (LIMB * i) for i in range(LIMBS)) // int(r.n)
    sent.unpersist()
    values = np.array(out, object)
    return values.astype(np.int64) if np.abs(values).max() <= SMALL else values


def _long(value: Column) -> Column:
    return F.when(F.abs(value) <= 2**63 - 1, value).cast("long")


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dim: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector(vec_id, embedding) that is kept.

    Components count as floor(64 * x). Vectors that are null, have another number of components than dim, or hold a
    null or non-finite one (or one beyond single precision) are left out. The first centroids are the rows with
    the smallest sha256 of "seed:vec_id", fewer than k if there are fewer rows; rows that repeat an id or a vector count each, and a
    null id is never before another. Each round assigns every vector to its nearest centroid (ties: the smaller number) and
    moves the centroids to the floor of their vectors' mean; then vectors are assigned once more. A squared
    distance, or a sum of them, that does not fit a long is null. Only centroids and their sums pass the
    driver; vectors stay in their partitions, without a shuffle. An empty table gives no rows; other columns are left out.
    """
    rows = staged(kept(vectors, dim), "centroid-rows")
    out = "vec_id long, cluster int, distance long"
    centres = first_centres(rows, k, seed)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centres = moved(rows, centres)
    sent = rows.sparkSession.sparkContext.broadcast(VantageTree(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, best in _searched(batches, sent.value, dim):
            distance = pa.array([int(d) if d < 2**63 else None for d in best], pa.int64()) if best.dtype == object else pa.array(best)
            yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), pa.array(number, pa.int32()), distance], names=["vec_id", "cluster", "distance"])

    found = staged(rows.mapInArrow(run, out), "centroid-clusters")
    # A row per centroid.
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("own")).collect()
    inertia = {r.cluster: None if r.own is None else int(r.own) for r in sums}
    total = None if None in inertia.values() else sum(inertia.values())
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centres]
    facts = [(c, _long(own), _long(total), digests[c]) for c, own in inertia.items()]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(value: int | None) -> int | None:
    return value if value is not None and value < 2**63 else None


def _oracle(k: int, rounds: int, dim: int, seed: int) -> str:
    squares = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def assigned(centres: str) -> str:
        return f"(SELECT v.id, arg_min(c.n, ({squares}, c.n)) AS n, min({squares}) AS distance FROM v, {centres} c GROUP BY v.id)"

    # Division cuts toward zero, so the remainder is made positive first.
    mean = "((sum(v.x[u.place]) - (sum(v.x[u.place]) % count(*) + count(*)) % count(*)) // count(*))::HUGEINT"
    steps = [
        f"""v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})""",
        f"c0 AS (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || id)) - 1 AS n FROM v QUALIFY n < {k})",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS {assigned(f'c{r}')}",
            f"m{r} AS (SELECT n, list(mean ORDER BY place) AS x FROM (SELECT a.n, u.place, {mean} AS mean FROM a{r} a JOIN v USING (id), range(1, {dim + 1}) u(place) GROUP BY ALL) GROUP BY n)",
            f"c{r + 1} AS (SELECT coalesce(m{r}.x, c{r}.x) AS x, n FROM c{r} LEFT JOIN m{r} USING (n))",
        ]
    return f"""WITH {", ".join(steps)}, f AS {assigned(f"c{rounds}")}
SELECT f.id AS vec_id, f.n::INT AS cluster, f.distance::BIGINT AS distance, (sum(f.distance) OVER (PARTITION BY f.n))::BIGINT AS cluster_inertia,
  (sum(f.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda e: e::VARCHAR), ',')) AS centroid_sha256
FROM f JOIN c{rounds} c USING (n)"""


ORACLE_SQL = _oracle(16, 3, 64, 1)
