"""Token counts with a byte-level BPE vocabulary: whole tokens by lookup, merges only for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import memo, of_texts

#: The pattern by which byte-level BPE of this kind cuts a text before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts are cut into pieces of about so many characters, between a word and a space, where no pattern crosses.
SLICE = 1_000_000


def specials(tokenizer) -> list[str]:
    return sorted(t.content for t in tokenizer.get_added_tokens_decoder().values())


def whole_tokens(tokenizer) -> list[str]:
    """The vocabulary strings that the library itself, given them alone, returns as one token. The proof is made once, before any text is read."""
    strings = [s for s in (tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())) if s and "�" not in s]
    special = set(specials(tokenizer))
    return [s for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1 and s not in special]


class PieceCounts(dict):
    """Pre-token to its number of tokens. It starts with what is proven to be one token; others are merged by the library when first met.

    At most `remember` others are kept.
    """

    def __init__(self, tokenizer, whole: list[str], remember: int = 400_000):
        self.tokenizer, self.remember, self.whole, self.specials = tokenizer, remember, dict.fromkeys(whole, 1), specials(tokenizer)
        super().__init__(self.whole)

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            if len(self) >= len(self.whole) + self.remember:
                self.clear()
                self.update(self.whole)
            self[piece] = n
        return n

    def slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE:
            cut = text.find(" ", start + SLICE)
            while cut != -1 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].strip() == ""):
                cut = text.find(" ", cut + 1)
            if cut == -1:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def count(self, text: str) -> int:
        """Tokens of a whole text as the library gives them by default: strings of special tokens are one token each."""
        if any(s in text for s in self.specials):
            parts = regex.split("|".join(map(regex.escape, self.specials)), text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, PIECES.findall(part))) for part in self.slices(text))


def load(path: str):
    """The tokenizer of a vocabulary file, without truncation or padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def counter(path: str, whole: list[str]) -> PieceCounts:
    """This worker's counter for a vocabulary file."""
    return memo(("pieces", path), lambda: PieceCounts(load(path), whole))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text.

    path: a byte-level BPE vocabulary file of the tokenizers library, present on the driver and every executor. A null or
    empty text has 0 bytes and 0 tokens; rows stay as they are, repeated ones and null ids too; other columns of
    docs are left out, whatever their names. No shuffle.
    """

    sent = docs.sparkSession.sparkContext.broadcast(whole_tokens(load(path)))  # a part of the vocabulary

    def start():
        pieces = counter(path, sent.value)
        return lambda texts: [pieces.count(t or "") for t in texts]

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), of_texts("long", start).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
