"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and in how many documents.

A text's tokens are those of its words, one after the other: words are cut where neither vocabulary can join what
stands on both sides, so that each is encoded and aligned once. A task counts linked id pairs in runs: the
records (pair, document, links) of some thousand documents, in order of the pair, first side first, parted by a
radix of the first id and compressed. Runs of a radix are shuffled together, hot radixes dealt over several groups, and merged
through a heap, pair by pair: that counts the documents of each pair. Merged again beside the sums, in the
same order, they give each first id's largest count, and stream back what every document's links contribute.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import memo, release_memos, staged

#: A run ends with the document that fills it.
RUN_RECORDS, RUN_DOCUMENTS = 1_000_000, 16_384
#: Parts of a run, by the first id.
RADIX = 32
#: Records that a group of runs may hold, whatever the size of the input.
GROUP_RECORDS = 16_000_000
#: Characters of texts whose words are looked up at a time.
SLICE = 2_000_000
# Words end before a single space, and before and after a single newline, with no white space beside them.
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
# Texts without white space at an end, or beside other white space, have no other spaces and newlines than such.
_BESIDE = r"[ \n][ \n]|^[ \n]|[ \n]$"
# Texts with these are encoded whole: other white space, control characters, and the mark that stands for a space.
_ODD = r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{2581}\x{3000}\x{feff}]"
_MARK = "▁"

DOCUMENT = "run long, ordinal int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PART = "radix int, records long, pairs binary, documents binary"


class Words:
    """What is known of words, in columns: facts (n_a, n_b, n_groups, n_links, whether both sides give the word's bytes), groups as text, and the pair (first id << 32 | second id) of each link."""

    def __init__(self):
        self.words, self.texts = pa.array([], pa.large_string()), pa.array([], pa.large_string())
        self.facts, self.pairs = np.zeros((0, 5), np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def add(self, words: pa.Array, facts: np.ndarray, texts: pa.Array, pairs: np.ndarray) -> None:
        self.words, self.texts = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.texts, texts])
        self.facts, self.pairs = np.concatenate([self.facts, facts]), np.concatenate([self.pairs, pairs])

    def pairs_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of words, one word's after the other's, and how many each has."""
        n = self.facts[:, 3]
        return self.pairs[runs_of((np.cumsum(n) - n)[places], n[places])], n[places]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For two cuttings of the same bytes: where links end, the token of a and of b of each link, and the common ends.

    Every stretch between neighbouring ends, of either side, lies in one token of each; two tokens share one stretch at most.
    """
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a, b, ends[(a_ends[a] == ends) & (b_ends[b] == ends)]


class Aligner:
    """Words of texts aligned by the libraries, remembered up to a bound.

    a: a byte-level BPE file of the tokenizers library; b: a sentencepiece model that puts a space before texts and marks
    spaces. That no piece of b joins a space to what stands before it, or a newline to anything, is proven when the vocabulary is loaded; without proof, every text is encoded whole.
    """

    def __init__(self, a: str, b: str, remember: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.remember = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b), remember
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a_bytes = self._byte_level(self.a)
        self.b_bytes, pieces = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode())
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)):
                pieces.append(piece)
        self.cuts = not any(re.search(f"[^{_MARK}]{_MARK}|\n", p) for p in pieces)
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.shown = pa.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))], pa.large_string())
        self.words = Words()

    @staticmethod
    def _byte_level(tokenizer) -> list[bytes]:
        """Bytes of each id: every character of a token stands for a byte, visible ones of Latin-1 for themselves, the others for the rest in order."""
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in visible]
        table = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(rest)}
        tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        return [bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t in tokens]

    def learn(self, words: pa.Array, alone: bool) -> np.ndarray:
        """The places of words that a text holds; new ones are aligned. Each begins as it stands in the text, mostly with a space; `alone`: each is encoded by itself."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words.words), -1).to_numpy(zero_copy_only=False)
        if (at < 0).any() and len(self.words) > self.remember:
            # Beyond the bound, only words at hand are kept.
            self.words = Words()
            at = np.full(len(words), -1)
        new = words.filter(pa.array(at < 0))
        if len(new):
            spaced, newline = pc.starts_with(new, " "), pc.starts_with(new, "\n")
            for some, single in ((spaced, alone), (pc.invert(pc.or_(spaced, newline)), alone), (newline, True)):
                part = new.filter(some)
                for a in range(0, len(part), 20_000):
                    self._add(part.slice(a, 20_000), single)
            at = pc.index_in(words, value_set=self.words.words).to_numpy()
        return at

    def _add(self, words: pa.Array, alone: bool) -> None:
        """Align new words, which all begin with a space or all not.

        Words with a space stand one after the other in texts of some hundred, others behind a newline each: in such a
        text, too, neither side joins what a word is cut from. A text that either side doesn't give back is left for words one by one.
        """
        if not len(words):
            return
        own, group = words.to_pylist(), 1 if alone else 300
        spaced, behind = own[0].startswith(" "), not own[0].startswith(" ") and not alone
        texts = ["".join(f"\n{w}" if behind else w for w in own[i : i + group]) for i in range(0, len(own), group)]
        left = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # b puts a space before what it gets; behind it and a newline of our own, a text is encoded as behind any other word.
        right = self.b.encode([t[1:] if spaced else t if behind else f"\n{t}" for t in texts], num_threads=1)
        right = [x[0 if spaced else 1 if behind else 2 :] for x in right]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        good = [b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for r, x, y in zip(raw, left, right, strict=True)]
        if not all(good):
            if group == 1:  # words that have no tokens
                bad = [i for i, g in enumerate(good) if not g]
                self.words.add(words.take(pa.array(bad)), np.zeros((len(bad), 5), np.int64), pa.array([""] * len(bad), pa.large_string()), np.zeros(0, np.int64))
            else:
                for i, g in enumerate(good):
                    if not g:
                        self._add(words.slice(i * group, group), True)
            words = words.filter(pa.array(np.repeat(good, group)[: len(own)]))
            left, right, raw = ([x for x, g in zip(side, good, strict=True) if g] for side in (left, right, raw))
        if not len(words):
            return
        a, b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (left, right))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        word_ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + behind)
        ends, i, j, common = overlaps(a_ends, b_ends)
        if behind:  # a newline before each word is a token of its own on both sides
            newline = np.concatenate([[0], word_ends[:-1]]) + 1
            a, a_ends = a[~np.isin(a_ends, newline)], a_ends[~np.isin(a_ends, newline)]
            b, b_ends = b[~np.isin(b_ends, newline)], b_ends[~np.isin(b_ends, newline)]
            ends, common = ends[~np.isin(ends, newline)], common[~np.isin(common, newline)]
            i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        n = len(words)
        facts = [np.bincount(np.searchsorted(word_ends, x), minlength=n) for x in (a_ends, b_ends, common, ends)]
        self.words.add(words, np.stack([*facts, np.ones(n, np.int64)], 1), self._shown(a, b, a_ends, b_ends, common, word_ends), a[i] << 32 | b[j])

    def _shown(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, common: np.ndarray, word_ends: np.ndarray) -> pa.Array:
        """Each word's groups as text: ids of a, ids of b, group by group."""
        group = np.concatenate([np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        ids, group, side = np.concatenate([a, b])[order], group[order], side[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
        of_word = np.searchsorted(word_ends, common)[group]
        closes = np.append(of_word[1:] != of_word[:-1], True)
        mark = np.where(~last, 0, np.where(side == 0, 1, np.where(closes, 3, 2)))
        marks = pa.DictionaryArray.from_arrays(pa.array(mark, pa.int32()), pa.array([",", "|", ";", ""], pa.large_string())).cast(pa.large_string())
        shown = pc.binary_join_element_wise(self.shown.take(pa.array(ids)), marks, pa.scalar("", pa.large_string()))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of_word, minlength=len(word_ends)))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shown), pa.scalar("", pa.large_string()))

    def kinds(self, texts: pa.Array) -> np.ndarray:
        """How to cut each text: 0 at every space and newline, 1 at some of them, 2 not at all, 3 empty or null."""
        beside, odd = (pc.match_substring_regex(texts, x).to_numpy(zero_copy_only=False) for x in (_BESIDE, _ODD))
        none = pc.fill_null(pc.equal(pc.binary_length(texts), 0), True).to_numpy(zero_copy_only=False)
        return np.where(none, 3, np.where(odd.astype(bool) | (not self.cuts), 2, beside.astype(bool).astype(int)))

    def cut(self, texts: pa.Array, kind: int) -> tuple[pa.Array, np.ndarray]:
        """The words of space + text for texts of a kind, one after the other, and how many each has."""
        if kind == 0:
            marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
            lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(" ", marked.type), marked, pa.scalar("", marked.type)), "\0")
            return lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        words = [[f" {t}"] if kind == 2 else _CUT.split(f" {t}") for t in texts.to_pylist()]
        return pa.array(list(itertools.chain.from_iterable(words)), pa.large_string()), np.fromiter(map(len, words), np.int64, len(words))

    def align(self, texts: pa.Array, kind: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For texts of a kind: facts (a row each, zeros without tokens), digests, and per text and pair of it: text, pair, links."""
        words, sizes = self.cut(texts, kind)
        flat = words.dictionary_encode()
        place, use, begins = self.learn(flat.dictionary, kind > 0), flat.indices.to_numpy(), np.cumsum(sizes) - sizes
        known, spot = self.words, place[use]
        sums = np.stack([np.add.reduceat(known.facts[:, k][spot], begins) for k in range(5)], 1)
        good = sums[:, 4] == sizes
        sums[~good] = 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, known.texts.take(pa.array(spot))), pa.scalar(";", pa.large_string()))
        digests = [hashlib.sha256(j.as_buffer()).hexdigest() if g else "" for j, g in zip(joined, good, strict=True)]
        # Words of each text with their counts, then the pairs of those words.
        owner, n = np.repeat(np.arange(len(texts)), sizes), len(place)
        cells, times = np.unique((owner * n + use)[good[owner]], return_counts=True)
        pairs, each = known.pairs_of(place[cells % n])
        return sums[:, :4], digests, np.repeat(cells // n, each), pairs, np.repeat(times, each)


def runs_of(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for lengths[0] numbers, then the same for the others."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def radix_of(pairs: np.ndarray) -> np.ndarray:
    """A mixed digit of the first id, so that neighbours in the vocabulary part."""
    return ((pairs >> 32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % RADIX


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers of their own smallest width, compressed: numbers of bytes, then the arrays."""
    packed = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in arrays]
    head = np.array([[x.itemsize, x.nbytes] for x in packed], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in packed))


def restored(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8 * n
    for width, size in np.frombuffer(raw, "<u4", 2 * n).reshape(n, 2).tolist():
        out.append(np.frombuffer(raw, f"<u{width}", size // width, at).astype(np.int64))
        at += size
    return out


def run_parts(text: np.ndarray, pair: np.ndarray, links: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(radix, records, pairs, documents) of a run: distinct pairs in order, as differences, with their numbers of documents; then the documents of each, as differences, with their links."""
    coded = pa.array(pair).dictionary_encode()
    names = coded.dictionary.to_numpy()
    order = np.argsort(names)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    names, cells, width = names[order], rank[coded.indices.to_numpy()] * (int(text.max(initial=0)) + 1) + text, int(text.max(initial=0)) + 1
    bits = int(links.max(initial=0)).bit_length()
    if (len(names) * width).bit_length() + bits < 63:
        packed = np.sort(cells << bits | links)  # sorted with its links in the last digits
        cells, links = packed >> bits, packed & (2**bits - 1)
    else:
        by_cell = np.argsort(cells, kind="stable")
        cells, links = cells[by_cell], links[by_cell]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    cells, total = cells[first], np.add.reduceat(links, first) if len(first) else links
    code, text = cells // width, cells % width
    n = np.bincount(code, minlength=len(names))
    digit = radix_of(names)
    for r in np.unique(digit):
        own, rows = digit == r, (digit == r)[code]
        texts = text[rows]
        first = np.cumsum(n[own]) - n[own]
        step = np.diff(texts, prepend=0)
        step[first] = texts[first]
        yield int(r), len(texts), squeezed(np.diff(names[own], prepend=0), n[own]), squeezed(step, total[rows])


def runs_in(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row per document (columns of DOCUMENT) and a row per run and radix (run and columns of PART), written to the shared folder."""
    schema = pa.schema([("run", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("radix", pa.int32()), ("records", pa.int64()), ("pairs", pa.binary()), ("documents", pa.binary())])

    def documents(run: int, first: int, ids: pa.Array, facts: np.ndarray, digests: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        columns = [np.full(n, run), np.arange(first, first + n, dtype=np.int32), ids, *facts.T, digests, *[pa.nulls(n, f.type) for f in list(schema)[8:]]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def parts(run: int, held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*run_parts(*[np.concatenate(x) for x in zip(*held, strict=True)]), strict=True)) or [[]] * 4
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array([run] * n, pa.int64()), *[pa.nulls(n, f.type) for f in list(schema)[1:8]], *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[8:], strict=True)]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = memo(("align", a, b), lambda: Aligner(a, b))
        number, held, records, filled = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text").cast(pa.large_string())
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(sizes // SLICE)) + 1, np.arange(0, len(ids), 2048), [len(ids)]])).tolist()
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                texts = column.slice(low, high - low)
                kinds = aligner.kinds(texts)
                facts, digests = np.zeros((len(texts), 4), np.int64), np.full(len(texts), "", object)
                for kind in set(kinds.tolist()) - {3}:
                    some = np.flatnonzero(kinds == kind)
                    facts[some], digests[some], text, pair, links = aligner.align(texts.take(pa.array(some)), kind)
                    held.append((filled + some[text], pair, links))
                    records += len(pair)
                yield documents(number, filled, ids.slice(low, high - low), facts, digests)
                filled += len(texts)
                if records >= RUN_RECORDS or filled >= RUN_DOCUMENTS:
                    if held:
                        yield parts(number, held)
                    number, held, records, filled = number + 1, [], 0, 0
        if held:
            yield parts(number, held)

    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{DOCUMENT}, {PART}"), "alignment-runs")


def merged(runs: list[Iterator[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """(pair, documents) of all runs through a heap, in order of the pair."""
    last, total = -1, 0
    for pair, n in heapq.merge(*runs):
        if pair != last:
            if total:
                yield last, total
            last, total = pair, 0
        total += n
    if total:
        yield last, total


def _pairs_of(data: bytes) -> Iterator[tuple[int, int]]:
    steps, n = restored(data, 2)
    yield from zip(np.cumsum(steps).tolist(), n.tolist(), strict=True)


def counted(parts: DataFrame) -> DataFrame:
    """radix, pair, n: in how many documents each pair is linked, of run parts with their group (radix, salt)."""

    def run(table: pa.Table) -> pa.Table:
        release_memos()
        found = list(merged([_pairs_of(x.as_py()) for x in table.column("pairs")]))
        pair, n = (np.array(x, np.int64) for x in zip(*found, strict=True))
        return pa.table({"radix": pa.array(radix_of(pair), pa.int32()), "pair": pair, "n": n})

    made = parts.select("radix", "salt", "pairs").groupBy("radix", "salt").applyInArrow(run, "radix int, pair long, n long")
    return made.groupBy("radix", "pair").agg(F.sum("n").alias("n"))


def contributions(parts: DataFrame, counts: DataFrame, salts: DataFrame) -> DataFrame:
    """run, best, total: what a part of a run adds to its documents' n_best and count_sum."""
    spread = counts.join(F.broadcast(salts), "radix").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def run(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        release_memos()
        theirs = theirs.sort_by("pair")
        pair, n = theirs.column("pair").to_numpy(), theirs.column("n").to_numpy()
        # In order of the first side, the pairs of each first id stand together.
        first = np.flatnonzero(np.diff(pair >> 32, prepend=-1)) if len(pair) else np.zeros(0, np.int64)
        most = np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(pair))) if len(pair) else n
        runs, best, total = [], [], []
        for number, names, documents in zip(mine.column("run").to_pylist(), mine.column("pairs"), mine.column("documents"), strict=True):
            steps, sizes = restored(names.as_py(), 2)
            jumps, links = restored(documents.as_py(), 2)
            at = np.searchsorted(pair, np.cumsum(steps))
            ends = np.cumsum(sizes)
            run_text = np.cumsum(jumps)
            base = run_text[ends - sizes] - jumps[ends - sizes]
            text = run_text - np.repeat(base, sizes)
            value, top = np.repeat(n[at], sizes), np.repeat(n[at] == most[at], sizes)
            runs.append(number)
            sums = np.zeros(int(text.max()) + 1, np.int64)
            np.add.at(sums, text, links * value)
            best.append(squeezed(np.bincount(text, links * top).astype(np.int64)))
            total.append(squeezed(sums))
        return pa.table({"run": pa.array(runs, pa.int64()), "best": pa.array(best, pa.binary()), "total": pa.array(total, pa.binary())})

    both = parts.select("run", "radix", "salt", "pairs", "documents").groupBy("radix", "salt").cogroup(spread.groupBy("radix", "salt"))
    return both.applyInArrow(run, "run long, best binary, total binary")


def dealt(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run parts with the salt of their group, and (radix, salts): as many groups for each radix as keep every one near an even share, and within what a task should hold."""
    sizes = {r.radix: int(r.n) for r in parts.groupBy("radix").agg(F.sum("records").alias("n")).collect()}  # at most RADIX rows
    share = max(1, min(GROUP_RECORDS, sum(sizes.values()) // (2 * RADIX)))
    salts = parts.sparkSession.createDataFrame([(r, -(-n // share)) for r, n in sizes.items()], "radix int, salts int")
    return parts.join(F.broadcast(salts), "radix").withColumn("salt", F.pmod(F.xxhash64("run"), F.col("salts")).cast("int")), salts


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs(doc_id, text).

    a and b: vocabulary files on the driver and all executors, as Aligner takes them. A text that is null, empty, or not given back byte for byte by either side has no tokens: zeros, and an empty digest. Rows stay as they are: repeated ids or texts are
    documents of their own, null ids stay null; other columns are left out. Counts are over all rows.
    """
    rows = runs_in(docs, a, b)
    parts = rows.filter("radix IS NOT NULL").select("run", "radix", "records", "pairs", "documents")
    parts, salts = dealt(parts)
    counts = staged(counted(parts), "alignment-counts")
    added = staged(contributions(parts, counts, salts), "alignment-added")

    def finish(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        best, total = (np.zeros(mine.num_rows, np.int64) for _ in range(2))
        for name, out in (("best", best), ("total", total)):
            for data in theirs.column(name):
                (x,) = restored(data.as_py(), 1)
                out[: len(x)] += x
        at = mine.column("ordinal").to_numpy()
        return pa.table({**{c: mine.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": best[at], "count_sum": total[at], "groups_sha256": mine.column("groups_sha256")})

    both = rows.filter("ordinal IS NOT NULL").select(*[c.split()[0] for c in DOCUMENT.split(", ")]).groupBy("run").cogroup(added.groupBy("run"))
    return both.applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
