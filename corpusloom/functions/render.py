"""Formats of answers: citations, contexts, tables of contents, sections, search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _line_end(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("?"))


def citation() -> Column:
    """One hit's citation; needs filepath, score, line_start, line_end."""
    return F.format_string("- [`%s`](%s:%s) (score: %.2f, lines %s-%s)", "filepath", "filepath", F.col("line_start").cast("string"), "score", F.col("line_start").cast("string"), _line_end(F.col("line_end")))


def qa_block(number: Column) -> Column:
    """One hit as a numbered, fenced block; needs filepath, language, content, line_start, line_end."""
    return F.format_string("### [%d] %s (lines %s-%s)\n```%s\n%s\n```\n", number, "filepath", F.col("line_start").cast("string"), _line_end(F.col("line_end")), "language", "content")


def joined(hits: DataFrame, block: Column, keys: list[str] | None = None, id_column: str = "point_id") -> DataFrame:
    """One text of the blocks of each key's hits (a top-k), best first."""
    part = F.struct((-F.col("score")).alias("s"), F.col(id_column).alias("i"), block.alias("b"))
    return hits.groupBy(*(keys or [])).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["b"]), "\n").alias("text"))


def qa_context(hits: DataFrame, id_column: str = "point_id") -> DataFrame:
    """The context of a question: one row, text. hits is a top-k."""
    ranked = hits.withColumn("_n", F.row_number().over(W.orderBy(F.desc("score"), id_column)).cast("int"))
    return joined(ranked, qa_block(F.col("_n")), id_column=id_column)


def search_result() -> Column:
    """One hit as a heading and a fenced block; needs filepath, language, content, score."""
    return F.format_string("### %s (Score: %.2f)\n```%s\n%s\n```\n", F.coalesce("filepath", F.lit("Unknown File")), "score", F.coalesce("language", F.lit("text")), F.coalesce("content", F.lit("")))


def search_results(hits: DataFrame, collection: str, id_column: str = "point_id") -> str:
    """The answer to a search: a top-k as one text."""
    row = joined(hits, search_result(), id_column=id_column).first()
    return f"# Semantic Search Results (Collection: {collection})\n\n{row.text}" if row and row.text else f"No relevant code found in collection '{collection}'."


def hit_json(id_column: str = "point_id", payload: tuple[str, ...] = ("filepath", "content", "language", "chunk_index")) -> Column:
    """A hit as JSON: id, score, payload."""
    return F.to_json(F.struct(F.col(id_column).alias("id"), F.col("score").alias("score"), F.struct(*payload).alias("payload")))


def web_text(results: DataFrame, query: str) -> str:
    """Search results (rank, title, url, snippet) as numbered markdown; as many as a search returns."""
    block = F.format_string("## %d. %s\n- **URL**: %s\n- **Snippet**: %s\n", F.row_number().over(W.orderBy("rank")), "title", "url", "snippet")
    rows = results.orderBy("rank").select(block.alias("b")).collect()
    return "\n".join([f"# Web Search Results for: {query}\n", *(r.b for r in rows)]) if rows else f"No web results found for: {query}"


def section_label() -> Column:
    return F.when(F.size("symbols") > 0, F.element_at("symbols", 1)).when(F.col("type") == "markdown_intro", "(preamble)").otherwise(F.format_string("(section %d)", "chunk_index"))


def level_label() -> Column:
    kind = F.coalesce("type", F.lit(""))
    return F.when(kind == "markdown_intro", "intro").when(F.startswith(kind, F.lit("markdown_h")), F.upper(F.right(kind, F.lit(2)))).otherwise(kind)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def toc_rows(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number (from 0), section, level, lines, est_tokens of each section."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy("chunk_index")) - 1
    lines = F.format_string("%d-%d", "line_start", "line_end")
    return chunks.select(*keys, number.alias("number"), section_label().alias("section"), level_label().alias("level"), lines.alias("lines"), token_estimate(F.col("content")).alias("est_tokens"))


def toc_text(chunks: DataFrame, key: str = "url") -> DataFrame:
    """key, toc: each page's table of contents as markdown."""
    row = F.format_string("| %d | %s | %s | %s | %d |", "number", "section", "level", "lines", "est_tokens")
    rows = toc_rows(chunks, [key]).select(key, F.struct("number", row.alias("row")).alias("r")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]).alias("rows"))
    # Heading and footer.
    head = F.concat(F.lit("## Table of Contents: "), F.col(key), F.lit("\n\n| # | Section | Level | Lines | ~Tokens |\n|---|---------|-------|-------|---------|\n"))
    foot = F.lit("\n\n---\nTo read specific sections, call ``scout_urls`` with ``mode='sections'``\nand pass the section names or numbers as ``sections=[...]``.\n")
    return rows.select(key, F.concat(head, F.array_join("rows", "\n"), foot).alias("toc"))


def sections(chunks: DataFrame, names: list[str | int], keys: list[str]) -> DataFrame:
    """Chunks whose number equals a name, or whose label holds one in any case, each once and in order; an empty name matches all.

    A name that is an int is a number only: it is not looked for in labels.
    """
    terms = [n.strip().lower() for n in names if isinstance(n, str)]
    number = F.row_number().over(W.partitionBy(*keys).orderBy("chunk_index")) - 1
    label = F.lower(section_label())
    hit = F.col("_number").isin([n for n in names if not isinstance(n, str)])
    for t in terms:
        hit = hit | (F.col("_number").cast("string") == t) | F.contains(label, F.lit(t))
    return chunks.withColumn("_number", number).filter(hit).withColumnsRenamed({"_number": "number"})


def sections_text(chunks: DataFrame, names: list[str | int], key: str = "url") -> DataFrame:
    """key, text: the chosen sections of each page as markdown, or what there was to choose from."""
    if not names:
        return chunks.select(key).distinct().withColumn("text", F.lit("No sections requested."))
    block = F.concat(F.lit("---\n### "), section_label(), F.lit("  ("), level_label(), F.lit(", ~"), token_estimate(F.col("content")).cast("string"), F.lit(" tokens)\n\n"), F.col("content"), F.lit("\n"))
    chosen = sections(chunks, names, [key]).select(key, F.struct("chunk_index", block.alias("b")).alias("c")).groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["b"]), "\n").alias("blocks"))
    offered = F.struct("number", F.format_string("  [%d] %s", "number", "section").alias("line"))
    pages = toc_rows(chunks, [key]).groupBy(key).agg(F.count("*").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(offered)), lambda c: c["line"]), "\n").alias("offers"))
    # The sentences of the answer.
    found = F.concat(F.lit("## Selected Sections from: "), F.col(key), F.lit("\n("), F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" chunks returned)\n\n"), F.col("blocks"))
    none = F.concat(F.lit(f"No sections matched the given names: {names}\n\nAvailable sections were:\n"), F.col("offers"))
    return pages.join(chosen, key, "left").select(key, F.when(F.col("n").isNull(), none).otherwise(found).alias("text"))


def shorten_page(chunks: DataFrame, pages: DataFrame, key: str = "url", text: str = "markdown", most: int = 8000) -> DataFrame:
    """pages with `shown`: the text, or if it is long, its first two chunks and a note, or with under three chunks its beginning."""
    c = chunks.filter("chunk_index < 2").select(key, F.struct("chunk_index", "content").alias("c")).groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("_first"))
    n = chunks.groupBy(key).agg(F.count("*").alias("_n"))
    # The notes.
    note = F.concat(F.lit("... [TRUNCATED - page too large. This page has "), F.col("_n").cast("string"), F.lit(" sections. Re-call with mode='toc' to browse sections, then use mode='sections' to read specific sections.] ..."))
    excerpt = F.concat_ws("\n", F.col("_first")[0]["content"], F.lit(""), note, F.lit(""), F.col("_first")[1]["content"])
    cut = F.concat(F.substring(text, 1, most), F.lit("\n\n... [TRUNCATED - page too large] ..."))
    rows = pages.join(n, key, "left").join(c, key, "left")
    shown = F.when(F.length(text) <= most, F.col(text)).when(F.col("_n") > 2, excerpt).otherwise(cut)
    return rows.withColumn("shown", shown).drop("_n", "_first")


def web_results() -> Column:
    """Snippets of a results table: 120 characters and dots."""
    return F.when(F.length("snippet") > 120, F.concat(F.substring("snippet", 1, 120), F.lit("..."))).otherwise(F.col("snippet"))
