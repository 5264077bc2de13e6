"""Chunkers: each turns rows (filepath, content) into rows of chunks.

Chunks have content, filepath, chunk_index (from 0 in each file), line_start and line_end (from 1, inclusive), type
and symbols. Each chunker is a column, the array of a row's chunks, that is exploded once; nothing is shuffled. A null or
empty content has no chunks. Windows advance by size - overlap while they begin inside the text, so that a last window
may hold overlap only; an overlap as large as the window is an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import check_window, split_lines, window_starts

#: A row's chunks, in order.
CHUNKS = "array<struct<content:string,line_start:int,line_end:int,type:string,symbols:array<string>>>"
CHUNK = ["filepath", "content", "chunk_index", "line_start", "line_end", "type", "symbols"]


def _no_symbols() -> Column:
    return F.array().cast("array<string>")


def _others(files: DataFrame) -> list[str]:
    """Columns of files that chunks carry along."""
    return [c for c in files.columns if c.lower() not in {*CHUNK, "_chunk", "_index"}]


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once: what a lambda holds by name would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _chunk(content: Column, start: Column, end: Column, kind: Column | None = None, symbols: Column | None = None) -> Column:
    kind = F.lit(None).cast("string") if kind is None else kind
    return F.struct(content.alias("content"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), kind.alias("type"), (_no_symbols() if symbols is None else symbols).alias("symbols"))


def _exploded(files: DataFrame, chunks: Column) -> DataFrame:
    keep = _others(files)
    rows = files.select("filepath", *keep, F.posexplode(chunks).alias("_index", "_chunk"))
    return rows.select("filepath", *keep, "_chunk.content", F.col("_index").alias("chunk_index"), "_chunk.line_start", "_chunk.line_end", "_chunk.type", "_chunk.symbols")


def _line_windows(size: int, overlap: int) -> Callable[[Column], Column]:
    step = check_window(size, overlap)

    def windows(lines: Column) -> Column:
        n = F.size(lines)
        return F.transform(window_starts(n, step), lambda s: _chunk(F.array_join(F.slice(lines, s + 1, F.lit(size)), "\n"), s + 1, F.least(s + size, n)))

    return windows


def _lines(path: Column, content: Column, size: int = 50, overlap: int = 5) -> Column:
    return _bound(split_lines(content), _line_windows(size, overlap))


def by_lines(files: DataFrame, size: int = 50, overlap: int = 5) -> DataFrame:
    """Windows of lines."""
    return _exploded(files, _lines(F.col("filepath"), F.col("content"), size, overlap))


def _sized(path: Column, content: Column, size: int = 500, overlap: int = 50) -> Column:
    step = check_window(size, overlap)

    def one(raw: bytes | None) -> np.ndarray:
        """begin and length in bytes, first and last line of each window, a column each."""
        text = (raw or b"").decode()
        starts, plain = range(0, len(text), step), text.isascii()
        cut = [text[a : a + size] for a in starts]
        length = [len(c) if plain else len(c.encode()) for c in cut]
        begin = np.cumsum([0, *(step if plain else len(text[a : a + step].encode()) for a in starts[:-1])])[: len(cut)]
        first = 1 + np.cumsum([0, *(text.count("\n", a, a + step) for a in starts[:-1])])[: len(cut)]
        return np.array([begin, length, first, first + np.array([c.count("\n") for c in cut], np.int64)], np.int32)

    def run(texts: pa.Array) -> pa.Array:
        # One text at a time, so that only the places of a batch's windows are held, not their strings.
        made = [one(None if (raw := t.as_buffer()) is None else raw.to_pybytes()) for t in texts.cast(pa.large_binary())]
        offsets = np.cumsum([0, *(m.shape[1] for m in made)])
        columns = np.concatenate([np.zeros((4, 0), np.int32), *made], axis=1)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["begin", "bytes", "first", "last"]))

    def windows(x: Column) -> Column:
        # Parts of bytes are found at once; parts of texts would be looked for from the beginning.
        return F.transform(x["places"], lambda w: _chunk(F.substring(x["raw"], w["begin"] + 1, w["bytes"]).cast("string"), w["first"], w["last"]))

    valid = F.make_valid_utf8(content)
    places = F.arrow_udf(run, "array<struct<begin:int,bytes:int,first:int,last:int>>")(valid)
    return _bound(F.struct(valid.cast("binary").alias("raw"), places.alias("places")), windows)


def by_size(files: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of characters; lines are counted by newlines before and inside the window. Texts are cut in Arrow batches, in one pass each."""
    return _exploded(files, _sized(F.col("filepath"), F.col("content"), size, overlap))


HEADING = r"^(#{1,6})[\s\x1c-\x1f\x{85}\p{Z}]+(.+)$"


def _headed(path: Column, content: Column, size: int = 100, overlap: int = 10) -> Column:
    step = check_window(size, overlap)

    def sections(lines: Column, heads: Column) -> Column:
        n = F.size(lines)
        # Section beginnings: line 0, unless a heading stands there, and all headings.
        begins = F.when((F.size(heads) == 0) | (F.try_element_at(heads, F.lit(1)) > 0), F.concat(F.array(F.lit(0)), heads)).otherwise(heads)

        def windows(b: Column, end: Column) -> Column:
            head = F.element_at(lines, b + 1)
            headed = F.array_contains(heads, b)
            kind = F.when(F.size(heads) == 0, F.lit(None).cast("string")).when(headed, F.concat(F.lit("markdown_h"), F.length(F.regexp_extract(head, HEADING, 1)).cast("string"))).otherwise("markdown_intro")
            symbols = F.when(headed, F.array(F.regexp_extract(head, HEADING, 2))).otherwise(_no_symbols())
            last = lambda s: F.least(b + s + size, end)
            return F.transform(window_starts(end - b, step), lambda s: _chunk(F.array_join(F.slice(lines, b + s + 1, last(s) - b - s), "\n"), b + s + 1, last(s), kind, symbols))

        made = _bound(begins, lambda begins: F.transform(begins, lambda b, i: windows(b, F.coalesce(F.try_element_at(begins, i + 2), n))))
        return F.when(n > 0, F.flatten(made)).otherwise(F.array().cast(CHUNKS))

    heads = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HEADING), i).otherwise(-1)), lambda i: i >= 0)
    return _bound(split_lines(content), lambda lines: _bound(heads(lines), lambda found: sections(lines, found)))


def by_heading(files: DataFrame, size: int = 100, overlap: int = 10) -> DataFrame:
    """Sections of markdown, each in windows of lines of its own; the index runs on through a file.

    A heading is one to six # and white space at a line's beginning, in code fences too. What stands before the first is
    of type markdown_intro, sections are markdown_h1 to markdown_h6 with the heading as symbol; a text
    without headings is windowed as a whole, without type.
    """
    return _exploded(files, _headed(F.col("filepath"), F.col("content"), size, overlap))


def with_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks with the symbols (filepath, name, kind, start_line) whose definition begins inside, as list and as a closing comment.

    The relational form of the hybrid chunker: a join on the file with a range on the line.
    """
    inside = (chunks["filepath"] == symbols["filepath"]) & symbols["start_line"].between(chunks["line_start"], chunks["line_end"])
    found = chunks.select("filepath", "chunk_index", "line_start", "line_end").join(symbols, inside).select(chunks["filepath"], "chunk_index", F.struct("start_line", "name", "kind").alias("s"))
    found = found.groupBy("filepath", "chunk_index").agg(F.array_sort(F.collect_list("s")).alias("_found"))
    rows = chunks.join(found, ["filepath", "chunk_index"], "left")
    none = F.array().cast("array<struct<start_line:int,name:string,kind:string>>")
    rows = rows.withColumn("_found", F.coalesce("_found", none))
    return rows.withColumn("content", F.concat("content", _hint(F.col("_found")))).withColumn("symbols", F.transform("_found", lambda s: s["name"])).withColumn("type", F.lit("code")).drop("_found")


def _hint(found: Column) -> Column:
    """A closing comment that names the symbols (kind, name, ...) found, or nothing."""
    listed = F.array_join(F.transform(found, lambda s: F.concat(F.element_at(F.split(s["kind"], "_"), 1), F.lit(":"), s["name"])), ", ")
    return F.when(F.size(found) > 0, F.concat(F.lit("\n\n/* Symbols: "), listed, F.lit(" */"))).otherwise("")


def _hinted(path: Column, content: Column, size: int = 50, overlap: int = 5) -> Column:
    from corpusloom.operators.syntax import symbols_of

    def hinted(chunk: Column, symbols: Column) -> Column:
        found = F.filter(symbols, lambda s: s["start_line"].between(chunk["line_start"], chunk["line_end"]))
        return _bound(found, lambda found: _chunk(F.concat(chunk["content"], _hint(found)), chunk["line_start"], chunk["line_end"], F.lit("code"), F.transform(found, lambda s: s["name"])))

    windows = _line_windows(size, overlap)
    both = F.struct(split_lines(content).alias("lines"), symbols_of(path, F.coalesce(content, F.lit(""))).alias("symbols"))
    return _bound(both, lambda x: F.transform(windows(x["lines"]), lambda c: hinted(c, x["symbols"])))


def hybrid(files: DataFrame, size: int = 50, overlap: int = 5) -> DataFrame:
    """Windows of lines with the symbols defined in them; symbols come from the file's syntax, in the same row."""
    return _exploded(files, _hinted(F.col("filepath"), F.col("content"), size, overlap))


def _defined(path: Column, content: Column, size: int = 50, overlap: int = 5) -> Column:
    from corpusloom.operators.syntax import definition_chunks

    check_window(size, overlap)
    return definition_chunks(size, overlap)(path, F.coalesce(content, F.lit("")))


def by_definition(files: DataFrame, size: int = 50, overlap: int = 5) -> DataFrame:
    """A chunk per top-level definition, sanitised and cut into windows if long, and chunks of what lies between."""
    return _exploded(files, _defined(F.col("filepath"), F.col("content"), size, overlap))


Chunker = Callable[[DataFrame], DataFrame]
CHUNKERS: dict[str, Chunker] = {"by_lines": by_lines, "by_size": by_size, "markdown": by_heading, "ast": by_definition, "hybrid": hybrid}
#: The same as columns of a row's chunks.
COLUMNS = {by_lines: _lines, by_size: _sized, by_heading: _headed, by_definition: _defined, hybrid: _hinted}


def register_chunker(name: str, chunker: Chunker) -> None:
    """Make a chunker of one's own available by name."""
    CHUNKERS[name] = chunker


def chunk(files: DataFrame, strategy: str = "ast", **window: int) -> DataFrame:
    """Chunks by the named strategy (an unknown one is by_size), but markdown by its headings in windows of 100 lines with 10 of overlap.

    One pass over files: each row takes one of two columns of chunks. Only a chunker of one's own, which takes tables, makes two branches.
    """
    from corpusloom.functions.paths import is_markdown

    path, content = F.col("filepath"), F.col("content")
    markdown = F.coalesce(is_markdown(path, content), F.lit(False))
    columns = ["filepath", *_others(files), *CHUNK[1:]]
    chunker = CHUNKERS.get(strategy, by_size)
    if chunker in COLUMNS:
        # Python would look at the other kind's texts too; it gets none.
        code = COLUMNS[chunker](path, F.when(~markdown, content), **window)
        return _exploded(files, F.when(markdown, _headed(path, content)).otherwise(code)).select(*columns)
    return chunker(files.filter(~markdown), **window).select(*columns).unionByName(by_heading(files.filter(markdown)).select(*columns))
