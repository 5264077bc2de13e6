"""File bytes to text, by suffix or name; readers of one's own can be registered."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions.paths import DOCUMENT_SUFFIXES, NAMES, TEXT_SUFFIXES

Reader = Callable[[str, bytes], str]


def read_text(path: str, data: bytes) -> str:
    """UTF-8 with replacement characters, all line ends as newlines."""
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def pdf_markdown(title: str | None, author: str | None, subject: str | None, source: str, pages: list[str]) -> str:
    """A PDF's text as markdown: front matter, title, subject, a heading per page, and short lines that look like headings as such."""
    head = ["---", *(f"{k}: {v}" for k, v in (("title", title), ("author", author), ("subtitle", subject), ("source", source)) if v), "---", ""]
    out = [*head, *([f"# {title}", ""] if title else []), *([f"## {subject}", ""] if subject else [])]
    for i, page in enumerate(pages, 1):
        out += [f"### Page {i}", ""]
        for line in page.split("\n"):
            line = line.strip()
            heading = 3 < len(line) < 60 and not line.endswith(".") and not line[0].islower()
            out.append(f"#### {line}" if heading else line)
        out.append("")
    return "\n".join(out)


def read_pdf(path: str, data: bytes) -> str:
    """Needs a PDF library; whatever goes wrong becomes the text."""
    try:
        import io

        from pypdf import PdfReader

        pdf = PdfReader(io.BytesIO(data))
        meta = pdf.metadata or {}
        return pdf_markdown(meta.get("/Title"), meta.get("/Author"), meta.get("/Subject"), path, [p.extract_text() or "" for p in pdf.pages])
    except Exception as e:
        return f"# Error processing PDF: {e}"


def read_docx(path: str, data: bytes) -> str:
    return f"# Document: {path.rsplit('/', 1)[-1]}\n\n(DOCX text is not extracted.)"


READERS: dict[str, Reader] = {**dict.fromkeys([*TEXT_SUFFIXES, *NAMES], read_text), ".pdf": read_pdf, ".docx": read_docx}
assert set(DOCUMENT_SUFFIXES) <= set(READERS)


def register_reader(suffixes: list[str], reader: Reader) -> None:
    for s in suffixes:
        READERS[s] = reader


def extract(path: str, data: bytes | None) -> str | None:
    """None for a kind of file that nothing reads, or when reading fails."""
    name = path.rsplit("/", 1)[-1]
    m = re.fullmatch(r".+(\.[^.]+)", name)
    reader = READERS.get(m[1] if m else "") or READERS.get(name)
    if reader is None or data is None:
        return None
    try:
        return reader(path, data)
    except Exception:
        return None


def extracted(path: str = "path", content: str = "content"):
    """Column of a file's text from its path and bytes."""
    readers = dict(READERS)

    @F.pandas_udf("string")
    def run(paths: pd.Series, data: pd.Series) -> pd.Series:
        READERS.update(readers)  # those registered on the driver
        return pd.Series([extract(p, None if d is None else bytes(d)) for p, d in zip(paths, data, strict=True)])

    return run(F.col(path), F.col(content))
