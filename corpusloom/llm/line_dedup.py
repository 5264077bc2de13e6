"""Line dedup: a suffix array over sequences of line ids, by distributed prefix doubling, finds repeated runs of lines.

Suffixes begin at the lines that occur more than once; a run that repeats holds no others. Round k ranks them by
their first 2^k lines: a suffix whose continuation is no such line, or a text's end, is settled and ordered by its place.
Neighbours in the array share a common prefix, found by the rounds from the last to the first; the suffixes with a
run of n lines in common are an interval of the array between prefixes shorter than n, and its first place is the copy that stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, staged

#: A line's place: document id (smallest long for null), hash of the text, number of the line from 0.
PLACE = ["d", "t", "pos"]
#: Suffixes that a task reads the array by.
BLOCK = 65_536
#: Bytes of text, with 64 more for each line, that are cut into lines at a time.
SLICE = 4_000_000

# White space in UTF-8: single bytes, wider characters by width as numbers, and the bytes that these begin with.
_SPACES = [chr(c).encode() for c in range(0x10000) if chr(c).isspace()]
_SPACE, _LEAD = (np.isin(np.arange(256), [x[0] for x in _SPACES if (len(x) > 1) == wide]) for wide in (False, True))
_WIDE = {n: [int.from_bytes(x) for x in _SPACES if len(x) == n] for n in (2, 3)}


def _word_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words, as str.split() parts them, of each line of UTF-8 bytes; ends: where the lines end, at a newline or the last byte."""
    space = _SPACE[data]
    at = np.flatnonzero(_LEAD[data])  # bytes that can begin a wider space
    code = np.zeros(len(at), np.int64)
    for i in range(3):
        code = code << 8 | np.where(at + i < len(data), data[np.minimum(at + i, len(data) - 1)], 0)
    for width, found in ((2, np.isin(code >> 8, _WIDE[2])), (3, np.isin(code, _WIDE[3]))):
        space[(at[found, None] + np.arange(width)).ravel()] = True
    begins = ~space
    begins[1:] &= space[:-1]
    return np.diff(np.searchsorted(np.flatnonzero(begins), ends), prepend=0)


def _depths(words: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, n), ascending: the shortest runs from each line on, and up to each line, that hold `least` words, by their first line.

    words: those of the lines of many texts, one after another; sizes: how many lines each has. No run leaves its text.
    Of all runs with so many words it is enough to look at these: together they cover every line of every longer
    repeated run, and no other.
    """
    total, at = np.concatenate([[0], np.cumsum(words)]), np.arange(len(words))
    last = np.repeat(np.cumsum(sizes), sizes)
    first = last - np.repeat(sizes, sizes)
    end = np.searchsorted(total, total[:-1] + least, "left")
    # Lines without words before the first counted one don't lengthen a run to the front.
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    ahead, back = end <= last, start >= first
    line, n = np.concatenate([at[ahead], start[back]]), np.concatenate([(end - at)[ahead], (at + 1 - start)[back]])
    pairs = np.unique(line[n > 0] * (len(words) + 1) + n[n > 0])
    return pairs // (len(words) + 1), pairs % (len(words) + 1)


def places_of(d: np.ndarray, t: np.ndarray, texts: list[bytes], least: int) -> pa.RecordBatch:
    """The rows of line_places for some texts, in UTF-8, all their lines at once; texts without a run to look at have none."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([x.count(b"\n") + 1 for x in texts], np.int64)
    line, n = _depths(_word_counts(data, np.append(np.flatnonzero(data == 10), len(data))), sizes, least)
    runs = np.bincount(line, minlength=int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    kept = (np.bincount(text, runs) > 0)[text]
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, compress(joined.split(b"\n"), kept))), ">i8").reshape(-1, 2).astype(np.int64)
    text, pos = text[kept], (np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[kept]
    depths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs[kept])]), pa.int32()), pa.array(n, pa.int32()))
    return pa.RecordBatch.from_arrays([*map(pa.array, (d[text], t[text], pos, h[:, 0], h[:, 1])), depths], names=[*PLACE, "h1", "h2", "depths"])


def line_places(docs: DataFrame, min_words: int) -> DataFrame:
    """d, t, pos, h1, h2 (128-bit hash of the line), depths (lengths of the runs to look at that begin with the line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            room = pc.binary_length(column).to_numpy() + 64 * pc.count_substring(column, b"\n").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(room, dtype=np.int64) // SLICE)) + 1).tolist(), len(column)]
            d, t = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield places_of(d[a:b], t[a:b], column.slice(a, b - a).to_pylist(), min_words)

    rows = docs.filter(F.col("text").isNotNull()).select(_id(), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(run, "d long, t long, pos long, h1 long, h2 long, depths array<int>")


def _id() -> F.Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """d, t, pos, id, rank, alone of rows in order of keys, then place: id ascends, rank is the first id with the same keys.

    Rows with a null key are alone, whatever the others hold. The order is that of a sort by ranges, so no task sees all rows, and equal keys may spread over tasks.
    """
    order = staged(rows.repartitionByRange(*keys, *PLACE).sortWithinPartitions(*keys, *PLACE).select(*PLACE, *keys, F.monotonically_increasing_id().alias("id")), "lines-order")
    groups = staged(order.dropna(subset=keys).groupBy(*keys).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "lines-groups")
    return staged(order.join(groups, keys, "left").select(*PLACE, "id", F.coalesce("first", "id").alias("rank"), F.col("first").isNull().alias("alone")), "lines-rank")


def rank_rounds(lines: DataFrame, depth: int) -> list[DataFrame]:
    """Of lines(d, t, pos, h1, h2): per round k, d, t, pos, id, rank, alone by the first 2^k lines, until 2^k reaches depth or all are alone."""
    rounds = [_ranked(lines, ["h1", "h2"])]
    while 2 ** (len(rounds) - 1) < depth:
        last, step = rounds[-1], 2 ** (len(rounds) - 1)
        open_ = last.filter("NOT alone")
        if open_.isEmpty():
            break
        ahead = last.select("d", "t", (F.col("pos") - step).alias("pos"), F.col("rank").alias("rank2"))
        both = open_.select(*PLACE, "rank").join(ahead, PLACE, "left")
        settled = last.filter("alone").select(*PLACE, "rank", F.lit(None).cast("long").alias("rank2"))
        rounds.append(_ranked(both.unionByName(settled), ["rank", "rank2"]))
    return rounds


def suffix_array(rounds: list[DataFrame]) -> DataFrame:
    """i (from 0), d, t, pos, lcp: the suffixes in order, each with the number of lines that it has in common with the one before it.

    Orders and prefixes are exact up to the depth that the rounds were made for.
    """
    last = rounds[-1].select("id", *PLACE)
    # A row per task of the sort: how many ids stand before it.
    parts = last.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.shiftleft("part", 33)).alias("shift"))
    rows = last.join(F.broadcast(parts), F.shiftright("id", 33) == F.col("part")).select((F.col("id") + F.col("shift")).alias("i"), *PLACE)
    # The last suffix of a block is also the first neighbour of the next block.
    block = F.floor(F.col("i") / BLOCK)
    both = F.when(F.col("i") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    near = rows.withColumn("block", F.explode(both)).withColumn("near", F.lag(F.struct(*PLACE)).over(W.partitionBy("block").orderBy("i")))
    pairs = near.filter(F.col("block") == block).select("i", *PLACE, *[F.col(f"near.{c}").alias(f"near_{c}") for c in PLACE], F.lit(0).cast("long").alias("lcp"))
    for k in reversed(range(len(rounds))):
        known = rounds[k].filter("NOT alone").select(*PLACE, "rank")
        for side, name in (("", "own"), ("near_", "other")):
            there = known.select(F.col("d").alias(f"{side}d"), F.col("t").alias(f"{side}t"), F.col("pos").alias("at"), F.col("rank").alias(name))
            pairs = pairs.withColumn("at", F.col(f"{side}pos") + F.col("lcp")).join(there, [f"{side}d", f"{side}t", "at"], "left").drop("at")
        pairs = pairs.withColumn("lcp", F.col("lcp") + F.when(F.col("own") == F.col("other"), 2**k).otherwise(0)).drop("own", "other")
    return staged(pairs.select("i", *PLACE, "lcp"), "lines-array")


def previous_smaller(lcp: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """For each (row, n), rows ascending: the last place up to row whose prefix is shorter than n, -1 if there is none; then the places, and their prefixes, that answer for rows to come.

    One pass for all n, over a stack of places whose prefixes ascend.
    """
    out, places, prefixes, at, end = np.full(len(row), -1, np.int64), [], [], 0, len(row)
    rows, depths = row.tolist(), n.tolist()
    for i, value in enumerate(lcp.tolist()):
        while prefixes and prefixes[-1] >= value:
            prefixes.pop()
            places.pop()
        prefixes.append(value)
        places.append(i)
        while at < end and rows[at] == i:
            k = bisect_left(prefixes, depths[at])
            if k:
                out[at] = places[k - 1]
            at += 1
    return out, places, prefixes


def intervals(array: DataFrame) -> DataFrame:
    """n, left, d, t, pos: for each suffix of array(i, d, t, pos, lcp, depths) and each of its depths n, where the interval of suffixes with the same n lines begins."""
    schema = "n int, i long, left long, block long, d long, t long, pos long, upto int"

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, lcp = table.column("i").to_numpy(), table.column("lcp").to_numpy()
        lists = table.column("depths").combine_chunks()
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        row, n = np.repeat(np.arange(len(i)), sizes), lists.flatten().to_numpy(zero_copy_only=False)
        found, places, prefixes = previous_smaller(lcp, row, n)
        left = np.where(found >= 0, i[found], -1)
        # For later blocks: the last place of this one at which an interval can begin, for depths above its prefix, up to the next one's.
        k, least = len(places), np.minimum(prefixes, 2**31 - 2) + 1
        none, block = np.full(k, -1, np.int64), i[0] // BLOCK
        values = [np.concatenate([n, least]).astype(np.int32), np.concatenate([i[row], none]), np.concatenate([left, i[places]]), np.full(len(row) + k, block)]
        values += [np.concatenate([table.column(c).to_numpy()[row], none]) for c in PLACE]
        upto = np.concatenate([np.zeros(len(row), np.int64), np.append(least[1:] - 1, 2**31 - 1)]).astype(np.int32)
        return pa.table(dict(zip(("n", "i", "left", "block", *PLACE, "upto"), [*values, upto], strict=True)))

    found = staged(array.withColumn("block", F.floor(F.col("i") / BLOCK)).groupBy("block").applyInArrow(scan, schema), "lines-intervals")
    tests, stacks = found.filter("i >= 0").drop("upto"), found.filter("i < 0").select("n", "upto", "block", "left")
    inside, across = tests.filter("left >= 0"), tests.filter("left < 0").drop("left")
    # Depths that reach into a block from before: no more than there are run lengths; each block says where its intervals of these depths begin.
    depths = [r.n for r in across.select("n").distinct().collect()]
    if not depths:
        return inside.select("n", "left", *PLACE)
    some = F.filter(F.array(*map(F.lit, sorted(depths))), lambda x: x.between(F.col("n"), F.col("upto")))
    ends = stacks.select(F.explode(some).alias("n"), "block", "left").unionByName(across.select("n", "block", F.lit(None).cast("long").alias("left")).distinct())
    before = F.last("left", True).over(W.partitionBy("n").orderBy("block").rangeBetween(W.unboundedPreceding, -1))
    begins = ends.withColumn("begin", before).filter("left IS NULL").select("n", "block", F.col("begin").alias("left"))
    return inside.select("n", "left", *PLACE).unionByName(across.join(begins, ["n", "block"]).select("n", "left", *PLACE))


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """d, t, runs: the runs (first line, lines) of each document that begin with the same lines, min_words words or more, as an earlier place does.

    Where a copy overlaps the first one, in the same document, only its lines behind the first one count.
    """
    places = staged(line_places(docs, min_words).distinct(), "lines-places")
    # Written, as below, so that Spark can split the rows of a line or run that is everywhere: both sides of the join are plain exchanges.
    repeated = staged(places.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "lines-often")
    lines = staged(places.join(repeated, ["h1", "h2"]), "lines-repeated")
    depth = lines.agg(F.max(F.array_max("depths"))).first()[0] or 1
    array = suffix_array(rank_rounds(lines.drop("depths"), depth))
    runs = staged(intervals(array.join(lines.select(*PLACE, "depths"), PLACE)), "lines-runs")
    first = staged(runs.groupBy("n", "left").agg(F.min(F.struct(*PLACE)).alias("first")), "lines-first")
    later = runs.join(first, ["n", "left"]).filter(F.struct(*PLACE) > F.col("first"))
    same = (F.col("d") == F.col("first.d")) & (F.col("t") == F.col("first.t"))
    begin = F.when(same, F.greatest("pos", F.col("first.pos") + F.col("n"))).otherwise(F.col("pos"))
    later = later.select("d", "t", begin.alias("pos"), (F.col("pos") + F.col("n") - begin).cast("int").alias("n"))
    return later.groupBy("d", "t").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))


def dedup_lines(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """docs with text less its repeated runs of lines, and n_lines and n_removed.

    Lines are what newlines part; white space parts words. A run of lines that hold min_words words or more and
    stood before, in a document with a smaller doc_id (then smaller hash of the text) or earlier in its own, is
    deleted; the first copy stays, and where a later one overlaps it, as in a line repeated many times, only the
    lines behind it go: what is deleted stands, line for line, in what is kept. Shorter repeats stay. A null text stays null with 0 lines; an empty one has
    one line; rows that repeat both id and text are one document and get one result each; null ids come first.
    Columns of docs named n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    d, t, runs, out = fresh(docs, "_d", "_t", "_runs", "_out")
    found = staged(later_copies(docs, min_words), "lines-later").withColumnsRenamed({"d": d, "t": t, "runs": runs})

    @F.pandas_udf("text string, n_lines int, n_removed int")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, places, strict=True):
            lines = text.split("\n")
            gone = np.zeros(len(lines) + 1, np.int64)
            np.add.at(gone, [r["pos"] for r in own], 1)
            np.add.at(gone, [r["pos"] + r["n"] for r in own], -1)
            kept = [x for x, g in zip(lines, np.cumsum(gone[:-1]), strict=True) if not g]
            rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    # Merge joins at every size, over one shuffle: what is to be deleted grows with the input, so it is never
    # broadcast. Only documents that lose lines pass through Python.
    keyed = docs.withColumn(d, _id()).withColumn(t, F.xxhash64("text"))
    cut_rows = keyed.join(found.hint("merge"), [d, t]).withColumn(out, cut("text", runs))
    cut_rows = cut_rows.select(*[F.col(f"{out}.text").alias("text") if c == "text" else F.col(c) for c in docs.columns], f"{out}.n_lines", f"{out}.n_removed")
    whole = keyed.join(found.select(d, t).hint("merge"), [d, t], "left_anti")
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return cut_rows.unionByName(whole.select(*docs.columns, n_lines.alias("n_lines"), F.lit(0).alias("n_removed")))
