"""Path and URL expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import uuid5

# Languages by suffix or file name.
LANGUAGES = {
    ".py": "python", ".go": "go", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".md": "markdown",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".c": "c", ".h": "c", ".sh": "shell", ".tf": "hcl",
    ".css": "css", ".scss": "scss", ".conf": "config", "Dockerfile": "dockerfile",
}
# Suffixes of plain text files, of other documents, and file names without suffix.
TEXT_SUFFIXES = (".py", ".go", ".js", ".ts", ".md", ".txt", ".yaml", ".yml", ".toml", ".c", ".h", ".adoc", ".tsx", ".css", ".scss", ".tf", ".sh", ".conf")
DOCUMENT_SUFFIXES = (".pdf", ".docx")
NAMES = ("Dockerfile",)
# Directories that are never walked.
EXCLUDED_DIRS = (".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", ".idea", ".vscode", ".kilocode")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix_of(path: Column) -> Column:
    """The last suffix with its dot; none for names that only begin, or end, with a dot."""
    return F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())])
    key = F.coalesce(F.nullif(suffix_of(path), F.lit("")), name_of(path))
    return F.coalesce(F.try_element_at(known, key), F.lit("unknown"))


def is_test(path: Column) -> Column:
    """Names that hold test or spec, anywhere."""
    return F.lower(name_of(path)).rlike("test|spec")


def path_segments(path: Column, root: str | None = None) -> Column:
    """The first five parts, by number from "0"; relative to root where the path lies below it, else "/" leads."""
    inside = path if root is None else F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)
    parts = F.filter(F.split(inside, "/"), lambda p: (p != "") & (p != "."))
    parts = F.when(F.startswith(inside, F.lit("/")), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)
    return F.map_from_entries(F.transform(F.slice(parts, 1, 5), lambda p, i: F.struct(i.cast("string").alias("key"), p.alias("value"))))


def point_id(path: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat(path, F.lit("_chunk_"), chunk_index.cast("string")))


def metadata_id(root: Column) -> Column:
    return uuid5(F.concat(root, F.lit("_indexing_metadata")))


def supported(path: Column) -> Column:
    return suffix_of(path).isin(*TEXT_SUFFIXES, *DOCUMENT_SUFFIXES) | name_of(path).isin(*NAMES)


def in_excluded_dir(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*EXCLUDED_DIRS))


def is_hidden(path: Column) -> Column:
    """A part that begins with a dot, but for "." itself."""
    return F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")) & (p != "."))


def should_handle(path: Column) -> Column:
    """Whether a changed file is indexed, before version control is asked."""
    return supported(path) & ~in_excluded_dir(path) & ~is_hidden(path)


def unreadable(path: Column) -> Column:
    """Paths that ranged reads refuse: a part is excluded, or begins with a dot or two underscores."""
    return F.exists(F.split(path, "/"), lambda p: p.isin(*EXCLUDED_DIRS) | ((F.startswith(p, F.lit(".")) & ~p.isin(".", "..")) | F.startswith(p, F.lit("__"))))


def is_markdown(path: Column, content: Column) -> Column:
    """Which files are cut by headings: .md, or text of no known language that begins like markdown."""
    unknown = ~suffix_of(path).isin(*[k for k in LANGUAGES if k.startswith(".")])
    return (suffix_of(path) == ".md") | (unknown & content.rlike(r"^(---|# )"))


# ---------------------------------------------------------------- URLs

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?"


def url_to_path(url: Column) -> Column:
    """Where a page is kept: host with underscores, path (index for none or a final slash), a mark for its query, .md."""
    host = F.replace(F.regexp_extract(url, _URL, 3), F.lit("."), F.lit("_"))
    path, query = F.regexp_extract(url, _URL, 4), F.regexp_extract(url, _URL, 6)
    inner = F.regexp_replace(path, r"^/+|/+$", "")
    inner = F.when(inner == "", F.lit("index")).when(F.endswith(path, F.lit("/")), F.concat(inner, F.lit("/index"))).otherwise(inner)
    mark = F.when(query != "", F.concat(F.lit("_"), F.substring(F.md5(query), 1, 6))).otherwise("")
    return F.concat(F.when(host != "", F.concat(host, F.lit("/"))).otherwise(""), inner, mark, F.lit(".md"))


def url_cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def crawlable(url: Column) -> Column:
    return url.rlike("^(https?://|file://|raw:)")


def expand_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """A row for each number of the first {a..b} of a URL, up or down; equal placeholders change together, others stay."""
    url = F.col(column)
    a, b = (F.regexp_extract(url, r"\{(\d+)\.\.(\d+)\}", i) for i in (1, 2))
    numbers = F.when(a == "", F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.nullif(a, F.lit("")).cast("long"), F.nullif(b, F.lit("")).cast("long")))
    rows = urls.withColumn("_n", F.explode(numbers))
    placeholder = F.regexp_extract(url, r"\{\d+\.\.\d+\}", 0)
    return rows.withColumn(column, F.when(F.col("_n").isNull(), url).otherwise(F.replace(url, placeholder, F.col("_n").cast("string")))).drop("_n")
