"""Token-id files: canonical length-limited Huffman codes from global counts, in independently decodable blocks.

A file is a folder with two Parquet tables. `codebook` (token, length): the code is canonical, so lengths say it
all. `blocks`, in ascending (shard, block): doc_ids and n_tokens of the block's documents, first (ids in the
shard before the block), n_ids, payload (codes, high bits first, in big-endian 32-bit words) and checkpoints
(the bit at which every 512th id starts), from which a block is decoded many places at once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import memo, release_memos, shared_folder, staged

#: Ids between two checkpoints; ids after which a block ends with its current document.
STRIDE, BLOCK = 512, 1_048_576
#: Codes are at least allowed this many bits, and two more than a fixed-length code needs.
LEAST_LIMIT = 16
BLOCKS = "shard int, block int, doc_ids array<bigint>, n_tokens array<bigint>, first long, n_ids long, payload binary, checkpoints binary"

# ---------------------------------------------------------------- tokenizing

# Where the library's and Python's notion of white space differ.
_ODD_SPACE = "[\\x1c-\\x1f]"
# Punctuation that stands alone after a word, and words whose normal form is their lower case.
_ENDINGS = ".,;:!?"
_PLAIN = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[{_ENDINGS}]?$"


def runs_of(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for lengths[0] numbers, then the same for the others."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def laid_out(parts: list[tuple[np.ndarray, np.ndarray]], begins: list[np.ndarray]) -> np.ndarray:
    """One array of several lists of runs (values, lengths), each run at its beginning."""
    out = np.empty(sum(len(values) for values, _ in parts), np.uint32)
    for (values, lengths), begin in zip(parts, begins, strict=True):
        out[runs_of(begin, lengths)] = values
    return out


class Known:
    """Strings and the ids of each, in columns: many strings are looked up at a time."""

    def __init__(self):
        self.strings, self.ids, self.begins, self.lengths = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.strings)

    def add(self, strings: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Strings that aren't known yet, and their ids one after the other."""
        self.strings = pa.concat_arrays([self.strings, strings])
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(lengths) - lengths])
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])

    def places(self, strings: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], remember: int) -> np.ndarray:
        """The place of each string; learn() tells ids of those that aren't known. Beyond the bound, only strings at hand are kept."""
        at = np.array(pc.fill_null(pc.index_in(strings, value_set=self.strings), -1))
        if len(self) > remember:
            kept, at = np.unique(at, return_inverse=True)
            if kept[0] < 0:
                kept, at = kept[1:], at - 1
            words, (ids, lengths) = self.strings.take(pa.array(kept)), self.of(kept)
            self.__init__()
            self.add(words, ids, lengths)
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            new = strings.take(pa.array(gaps)).dictionary_encode()
            at[gaps] = len(self) + new.indices.to_numpy()
            self.add(new.dictionary, *learn(new.dictionary))
        return at

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places, one after the other, and how many each has."""
        lengths = self.lengths[places]
        return self.ids[runs_of(self.begins[places], lengths)], lengths


class WordIds:
    """Ids of texts, by the ids of their white-space separated words, which are remembered up to a bound.

    For a vocabulary whose normalizer folds white space and case and whose pre-tokenizer never joins what white
    space parts, the ids of a text are those of its words one after the other; texts with characters on which the
    library and Python disagree go to the library whole. New words of plain letters, with or without one mark
    after them, go to it many at a time in lower case and without the mark: each is one pre-token, whose last id,
    and no other, ends a word. When the bound is met, the words of the texts at hand are kept.
    """

    def __init__(self, path: str, remember: int = 400_000, characters: int = 3_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.remember, self.characters = remember, characters
        self.words, self.cores, self.marks = Known(), Known(), Known()
        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.bare):
            t.no_truncation()
            t.no_padding()
        # The same model for what is normal already.
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        marks = ["", *_ENDINGS]
        self.marks.add(pa.array(marks), *self.encode(marks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts by the library, and how many each has."""
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def encode_cores(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cores, ids, lengths = new.to_pylist(), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        groups = [cores[a : a + 500] for a in range(0, len(cores), 500)]
        for part, found in zip(groups, self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            own = np.array(found.ids, np.uint32)
            stops = np.flatnonzero(self.ends[own]) + 1
            if len(stops) == len(part) and stops[-1] == len(own):
                n = np.diff(stops, prepend=0)
            else:
                own, n = self.encode(part)
            ids.append(own)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def encode_words(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        is_plain = pc.match_substring_regex(new, _PLAIN)
        plain, other = np.flatnonzero(is_plain), np.flatnonzero(pc.invert(is_plain))
        low = pc.utf8_lower(new.filter(is_plain))
        core = pc.utf8_rtrim(low, _ENDINGS)
        mark = pc.if_else(pc.equal(low, core), "", pc.utf8_slice_codeunits(low, -1))
        cores = self.cores.of(self.cores.places(core, self.encode_cores, self.remember))
        marks = self.marks.of(self.marks.places(mark, self.encode_words, len(self.marks)))
        others = self.encode(new.take(pa.array(other)).to_pylist())
        lengths = np.zeros(len(new), np.int64)
        lengths[plain], lengths[other] = cores[1] + marks[1], others[1]
        begins = np.cumsum(lengths) - lengths
        return laid_out([cores, marks, others], [begins[plain], begins[plain] + cores[1], begins[other]]), lengths

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        split = pc.utf8_split_whitespace(texts)
        ids, n = self.words.of(self.words.places(split.flatten(), self.encode_words, self.remember))
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(pc.list_value_length(split).to_numpy())]
        lengths = np.diff(ends, prepend=0)
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD_SPACE))
        if len(odd):
            parts = np.split(ids, ends[:-1])
            for i in odd:
                parts[i] = self.encode([texts[int(i)].as_py()])[0]
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, lengths

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Runs of texts with about so many bytes each."""
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(size // self.characters)) + 1, [len(texts)]]))
        return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        column, out = pa.array(texts, pa.string()), []
        for a, b in self.slices(column):
            ids, n = self.flat(column.slice(a, b - a))
            out += [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]
        return out


def word_ids(path: str) -> WordIds:
    """This worker's ids for a vocabulary file."""
    return memo(("words", path), lambda: WordIds(path))


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits for symbols with these positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 2**limit:
        raise ValueError(f"{n} symbols need codes longer than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    items, single = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, packages])
        by_weight = np.argsort(merged, kind="stable")
        single.append(by_weight < n)
        items = merged[by_weight]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(single):
        k = int(level[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: by length, then by token."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        by_code = np.lexsort((tokens, lengths))
        self.tokens, self.lengths = np.asarray(tokens, np.int64)[by_code], np.asarray(lengths, np.int64)[by_code]
        self.longest = int(self.lengths.max(initial=1))
        spans = np.int64(1) << (self.longest - self.lengths)
        self.codes = ((np.cumsum(spans) - spans) >> (self.longest - self.lengths)).astype(np.uint64)
        size = int(self.tokens.max(initial=0)) + 1
        self.at = np.full(size, -1, np.int64)
        self.at[self.tokens] = np.arange(len(self.tokens))
        self.spans = spans

    def decoding_table(self) -> tuple[np.ndarray, np.ndarray]:
        """By the next `longest` bits: the token and its code's length."""
        pad = 2**self.longest - int(self.spans.sum())
        return np.concatenate([np.repeat(self.tokens, self.spans), np.zeros(pad, np.int64)]), np.concatenate([np.repeat(self.lengths, self.spans), np.ones(pad, np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """payload and checkpoints."""
        at = self.at[ids]
        lengths, codes = self.lengths[at], self.codes[at]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        word, shift = begins >> 5, (64 - (begins & 31) - lengths).astype(np.uint64)
        wide = codes << shift  # a code of at most 32 bits lies in two neighbouring words
        n_words = (int(ends[-1]) + 31 >> 5) + 1 if len(ids) else 1
        high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n_words)  # bits never overlap: sums stay exact
        low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words + 1)[:n_words]
        return (high + low).astype(np.uint64).astype(">u4").tobytes(), begins[::STRIDE].astype("<i8").tobytes()


class Decoder:
    def __init__(self, book: Codebook):
        self.longest = book.longest
        self.tokens, self.lengths = book.decoding_table()

    def decode(self, payload: bytes, checkpoints: bytes, n_ids: int) -> np.ndarray:
        """All ids of a block; every stretch between checkpoints advances one id per step."""
        words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
        bit = np.frombuffer(checkpoints, "<i8").copy()
        out = np.zeros((len(bit), STRIDE), np.int64)
        mask, last = np.uint64(2**self.longest - 1), len(words) - 2
        for j in range(min(STRIDE, n_ids)):
            at = np.minimum(bit >> 5, last)  # the last stretch may run past the end; what it reads there is cut off
            window = (words[at] << np.uint64(32)) | words[at + 1]
            key = ((window >> (64 - (bit & 31) - self.longest).astype(np.uint64)) & mask).astype(np.int64)
            out[:, j] = self.tokens[key]
            bit += self.lengths[key]
        return out.ravel()[:n_ids]


# ---------------------------------------------------------------- Spark


def token_ids(docs: DataFrame, vocabulary: str, end_id: int | None) -> DataFrame:
    """doc_id, tie (hash of the text), ids (compressed little-endian 32-bit integers), of every whole text; end_id, if any, comes last.

    Each task adds a row of its own, whose `counts` (64-bit, by token) are those of all ids it has written.
    """
    end = np.array([] if end_id is None else [end_id], np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack, total = word_ids(vocabulary), zstandard.ZstdCompressor(level=1), np.zeros(0, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in words.slices(texts):
                ids, n = words.flat(texts.slice(a, b - a))
                found = np.bincount(np.append(ids, np.repeat(end, b - a)))
                total = np.concatenate([total, np.zeros(max(0, len(found) - len(total)), np.int64)])
                total[: len(found)] += found
                packed = [pack.compress(_narrow(np.append(x, end))) for x in np.split(ids, np.cumsum(n)[:-1])]
                rest = pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("tie").slice(a, b - a), pa.array(packed, pa.binary()), rest], schema=schema)
        yield pa.RecordBatch.from_pylist([{"counts": total.astype("<i8").tobytes()}], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, ids binary, counts binary")


def _narrow(ids: np.ndarray) -> bytes:
    """Ids by bytes of equal weight, which compresses them better."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _wide(ids: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def token_totals(ids: DataFrame) -> DataFrame:
    """token, n over all rows of token_ids(), from its tasks' counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts in batch["counts"]:
                found = np.frombuffer(counts, "<i8")
                total = np.concatenate([total, np.zeros(max(0, len(found) - len(total)), np.int64)])
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pd.DataFrame({"token": used, "n": total[used]})

    return ids.select("counts").filter("counts IS NOT NULL").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_token_file(docs: DataFrame, path: str, vocabulary: str, *, end_id: int | None = 2) -> None:
    """Encode every whole text and write the ids, documents in ascending doc_id order (null first, ties by text).

    vocabulary: a file of the tokenizers library, present on executors. end_id is appended to each document;
    None appends nothing. A null text is empty. Rows with one doc_id stay apart. Texts are tokenized once; the
    compressed ids wait in the shared folder for the code. Only the counts, a row per token of the vocabulary,
    reach the driver.
    """
    spark = docs.sparkSession
    ids = staged(token_ids(docs, vocabulary, end_id), "token-ids")
    totals = token_totals(ids).orderBy("token").toPandas()
    limit = max(LEAST_LIMIT, int(max(len(totals) - 1, 1)).bit_length() + 2)
    lengths = code_lengths(totals["n"].to_numpy(), limit)
    book = Codebook(totals["token"].to_numpy(), lengths)
    spark.createDataFrame(pd.DataFrame({"token": book.tokens, "length": book.lengths}), "token long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    sent = spark.sparkContext.broadcast(book)

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("first", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("checkpoints", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        unpack, book, shard = zstandard.ZstdDecompressor(), sent.value, TaskContext.get().partitionId()
        block, first, filled, doc_ids, sizes, held = 0, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            payload, checkpoints = book.encode(np.concatenate(held))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (shard, block, doc_ids, sizes, first, filled, payload, checkpoints), strict=True))], schema=schema)

        for batch in batches:
            for key, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                doc_ids.append(key)
                held.append(_wide(unpack.decompress(packed.as_buffer())))
                sizes.append(len(held[-1]))
                filled += sizes[-1]
                if filled >= BLOCK:
                    yield close()
                    block, first, filled, doc_ids, sizes, held = block + 1, first + filled, 0, [], [], []
        if doc_ids:
            yield close()

    # The place in the written table parts rows that repeat both id and text, so that many of them don't meet in one task.
    rows = ids.filter("ids IS NOT NULL").select("doc_id", "tie", "ids", F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    rows.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (the document's, as little-endian 32-bit integers), from the files alone."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    sent = spark.sparkContext.broadcast(Codebook(book["token"].to_numpy(), book["length"].to_numpy()))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # A row per shard, that is per writing task.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("doc_ids", "n_tokens", "first", "before", "n_ids", "payload", "checkpoints")}
                ids = decoder.decode(row["payload"].as_buffer(), row["checkpoints"].as_buffer(), row["n_ids"].as_py()).astype("<u4")
                sizes = row["n_tokens"].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                starts = pa.array(ends - sizes + (row["first"].as_py() + row["before"].as_py()))
                yield pa.RecordBatch.from_pydict({"doc_id": row["doc_ids"].values, "start": starts, "ids": pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary())})

    return blocks.join(F.broadcast(shards), "shard").mapInArrow(run, "doc_id long, start long, ids binary")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read_token_file()'s rows."""
    return rows.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, vocabulary: str, *, end_id: int | None = 2) -> DataFrame:
    """Write docs to a token file in the shared folder and return the digest of what is read back."""
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_file(docs, path, vocabulary, end_id=end_id)
    return digest(read_token_file(docs.sparkSession, path))
