"""Web pages: HTML to markdown, cached chunks, crawling over a table of pages, search backends."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import crawlable, expand_urls, url_cache_key, url_to_path
from corpusloom.operators.chunking import by_heading
from corpusloom.plans.staging import staged


def html_to_markdown(html: Column) -> Column:
    """A small converter: headings, paragraphs, list items, links and code; scripts, styles and navigation go."""
    h = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|aside|noscript)\b.*?</\1\s*>|<head\b.*?</head\s*>", "")
    for level in range(1, 7):
        h = F.regexp_replace(h, rf"(?is)<h{level}\b[^>]*>\s*(.*?)\s*</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n")
    h = F.regexp_replace(h, r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>", "[$2]($1)")
    h = F.regexp_replace(h, r"(?i)<li\b[^>]*>", "\n- ")
    h = F.regexp_replace(h, r"(?i)<pre\b[^>]*>", "\n\n```\n")
    h = F.regexp_replace(h, r"(?i)</pre\s*>", "\n```\n\n")
    h = F.regexp_replace(h, r"(?i)</?(p|div|section|article|ul|ol|table|tr|br|main|body)\b[^>]*>", "\n\n")
    h = F.regexp_replace(h, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        h = F.replace(h, F.lit(entity), F.lit(char))
    h = F.regexp_replace(h, r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(h, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def best_markdown(fit: Column, markdown: Column) -> Column:
    return F.coalesce(F.nullif(fit, F.lit("")), markdown, F.lit(""))


def page_chunks(pages: DataFrame, cached_at: Column | None = None) -> DataFrame:
    """pages(url, markdown) to cached chunks: cache_key, url, the chunk's columns, cached_at."""
    chunks = by_heading(pages.select(F.col("url").alias("filepath"), F.col("markdown").alias("content")))
    return chunks.withColumnRenamed("filepath", "url").withColumn("cache_key", url_cache_key(F.col("url"))).withColumn("cached_at", F.current_timestamp() if cached_at is None else cached_at)


def live(cache: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Entries that are not older than the time to live."""
    return cache.filter(now.cast("double") - F.col("cached_at").cast("double") <= seconds)


def store(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new pages in place of their old entries."""
    return cache.join(new.select("cache_key").distinct(), "cache_key", "left_anti").unionByName(new)


def crawled_urls(files: DataFrame) -> DataFrame:
    """url of saved pages (content): the first source_url line of the first ten."""
    lines = F.slice(F.split("content", "\n", -1), 1, 10)
    found = F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit("source_url:"))), F.lit(1))
    url = F.trim(F.element_at(F.split(found, "source_url:", -1), 2))
    return files.select(url.alias("url")).filter(F.col("url").isNotNull())


def saved_pages(pages: DataFrame) -> DataFrame:
    """pages(url, markdown, seed_url) as files: path and content with front matter; empty ones are skipped, pages that share a path get a mark of their URL."""
    from pyspark.sql import Window as W

    path = url_to_path(F.col("url"))
    seed = F.coalesce(F.concat(F.lit("seed_url: "), F.nullif(F.col("seed_url"), F.lit("")), F.lit("\n")), F.lit(""))
    rows = pages.filter(F.col("markdown") != "").withColumn("path", path)
    clash = F.row_number().over(W.partitionBy("path").orderBy("url")) > 1
    marked = F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit("_"), F.substring(F.md5("url"), 1, 4), F.lit(".md"))
    rows = rows.withColumn("path", F.when(clash, marked).otherwise(F.col("path")))
    return rows.select("url", "path", F.concat(F.lit("---\nsource_url: "), F.col("url"), F.lit("\n"), seed, F.lit("---\n\n"), F.col("markdown")).alias("content"))


def to_crawl(urls: DataFrame, crawled: DataFrame | None = None, recursive: bool = False) -> DataFrame:
    """Expanded URLs less those crawled before; repeated ones stay. Recursive crawls take URLs with a known scheme only."""
    rows = expand_urls(urls)
    rows = rows.filter(crawlable(F.col("url"))) if recursive else rows
    return rows if crawled is None else rows.join(crawled.select("url").distinct(), "url", "left_anti")


def links(pages: DataFrame) -> DataFrame:
    """url, target of the absolute links of pages(url, html), without fragments."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?href\s*=\s*[\"'](https?://[^\"'#]+)"), F.lit(1))
    return pages.select("url", F.explode(found).alias("target"))


def _site(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def _like(patterns: list[str]) -> Column:
    """Whether url matches one of these shell patterns."""
    return F.col("url").rlike("(?s)^(?:" + "|".join(fnmatch.translate(p)[4:-3] for p in patterns) + ")$") if patterns else F.lit(False)


def crawl_all(seeds: DataFrame, pages: DataFrame, *, max_pages: int = 50, max_depth: int = 3, stay_in_path: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """seed_url, url, depth of the pages that breadth-first crawls from each of seeds(url) reach in a table of pages(url, html).

    All crawls share one frontier of (seed, url): a level is one join of it with links, however many seeds there are. Each crawl keeps to its
    seed's site; patterns of `include` (and, with stay_in_path, the seed's path) are alternatives; URLs that match a pattern of `exclude` are
    left out. max_pages bounds each crawl, first by depth, then by URL; one that has them goes no further.
    """
    from pyspark.sql import Window as W

    there = staged(pages.filter("url IS NOT NULL").select("url").distinct(), "crawl-pages")
    edges = staged(links(pages).distinct(), "crawl-links")
    wanted = _site(F.col("url")) == _site(F.col("seed_url"))
    if stay_in_path or include:
        inside = F.contains(F.col("url"), F.regexp_replace("seed_url", "/+$", "")) if stay_in_path else F.lit(False)
        wanted = wanted & (inside | _like(include or []))
    wanted = wanted & ~_like(exclude or [])
    seen = staged(seeds.select(F.col("url").alias("seed_url"), "url", F.lit(0).alias("depth")).distinct().join(there, "url", "left_semi").select("seed_url", "url", "depth"), "crawl")
    frontier = seen
    for depth in range(1, max_depth + 1):
        counts = seen.groupBy("seed_url").agg(F.count("*").alias("_n"))
        found = frontier.select("seed_url", "url").join(edges, "url").select("seed_url", F.col("target").alias("url")).distinct().filter(wanted)
        found = found.join(seen, ["seed_url", "url"], "left_anti").join(there, "url", "left_semi").join(counts, "seed_url")
        # Of a level, as many pages as the crawl may still take.
        place = F.row_number().over(W.partitionBy("seed_url").orderBy("url"))
        found = found.withColumn("_at", place).filter(F.col("_at") <= max_pages).filter(F.col("_at") + F.col("_n") <= max_pages)
        frontier = staged(found.select("seed_url", "url", F.lit(depth).alias("depth")), "crawl")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def crawl(seed: str, pages: DataFrame, **limits) -> DataFrame:
    """url, depth of the pages that a crawl from one seed reaches; limits as in crawl_all()."""
    return crawl_all(pages.sparkSession.createDataFrame([(seed,)], "url string"), pages, **limits).select("url", "depth").orderBy("depth", "url")


def crawl_run(urls: DataFrame, pages: DataFrame, saved: DataFrame | None = None, *, recursive: bool = False, **limits) -> DataFrame:
    """url, path, content of the files that a run adds: urls are expanded, filtered, less those saved before, fetched and written as markdown.

    urls(url); pages(url, html) stand for the net; saved(content) are files of earlier runs. A recursive run follows the
    links of all URLs given, as crawl_all() does with these limits. A page that several lead to is saved once, for the first of them.
    """
    before = None if saved is None else crawled_urls(saved).distinct()
    todo = to_crawl(urls.select("url"), before, recursive).distinct()
    found = todo.withColumn("seed_url", F.lit(None).cast("string"))
    if recursive:
        found = crawl_all(staged(todo, "crawl-seeds"), pages, **limits).select("url", "seed_url")
        found = found if before is None else found.join(before, "url", "left_anti")
    found = found.groupBy("url").agg(F.min("seed_url").alias("seed_url"))
    fetched = found.join(pages.groupBy("url").agg(F.min("html").alias("html")), "url")
    return saved_pages(fetched.select("url", "seed_url", html_to_markdown(F.col("html")).alias("markdown")))


SearchBackend = Callable[[str, int, list[str] | None], list[dict[str, str]]]
SEARCH_BACKENDS: dict[str, SearchBackend] = {}


def register_search_backend(name: str, backend: SearchBackend) -> None:
    """backend(query, max_results, categories) returns title, url and snippet of each result."""
    SEARCH_BACKENDS[name] = backend


def search_web(spark, query: str, max_results: int = 10, backend: str = "duckduckgo", categories: list[str] | None = None) -> DataFrame:
    """title, url, snippet of a web search; backends must have been registered, as this library opens no connections itself."""
    if backend not in SEARCH_BACKENDS:
        raise ValueError(f"no search backend named {backend}; there are {sorted(SEARCH_BACKENDS)}")
    most = max(1, min(max_results, 20)) if backend == "duckduckgo" else max_results
    found = SEARCH_BACKENDS[backend](query, most, categories)
    return spark.createDataFrame([(r.get("title") or "Untitled", r.get("url") or "", r.get("snippet") or "") for r in found], "title string, url string, snippet string")


def results_and_answers(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Search results and direct answers (url, content) in one table."""
    return results.select("title", "url", "snippet").unionByName(answers.select(F.lit("Answer").alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.col("content").alias("snippet")))


def scout(pages: DataFrame, urls: list[str], max_results: int = 3, mode: str = "full", wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """url, text of the first 1 to 10 of urls: pages in full (long ones shortened), their contents (toc), or the sections wanted of each."""
    from corpusloom.functions.render import sections_text, shorten_page, toc_text

    asked = list(dict.fromkeys(urls[: max(1, min(max_results, 10))]))
    found = pages.filter(F.col("url").isin(asked) & (F.col("markdown") != "")).select("url", "markdown")
    if mode == "full":
        return shorten_page(page_chunks(found), found).select("url", F.col("shown").alias("text"))
    chunks = page_chunks(found)
    if mode == "toc":
        return toc_text(chunks).withColumnRenamed("toc", "text")
    out = None
    for url in asked:
        part = sections_text(chunks.filter(F.col("url") == url), (wanted or {}).get(url, []))
        out = part if out is None else out.unionByName(part)
    return out


def research(results: DataFrame, pages: DataFrame, max_urls: int = 3) -> DataFrame:
    """rank, title, url, snippet, shown: the first results whose page is there, with long pages shortened. results are in order of `rank`."""
    from corpusloom.functions.render import shorten_page

    top = results.orderBy("rank").limit(max_urls).filter(F.col("url") != "")
    found = pages.join(F.broadcast(top.select("url")), "url", "left_semi")
    shown = shorten_page(page_chunks(found), found).select("url", "shown")
    return top.join(shown, "url").select("rank", "title", "url", "snippet", "shown")
