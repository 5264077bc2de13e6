"""Text expressions: line splitting, windows, sanitising, hashing. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as in universal line splitting, not only newlines.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: White space at either end, in the Unicode sense; control separators count too.
OUTER_SPACE = r"^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$"


def split_lines(text: Column) -> Column:
    """Lines without their ends; a text's last line end opens no further line, and an empty or null text has no lines."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def window_starts(n: Column, step: int) -> Column:
    """0, step, 2 step ... below n; none for n = 0. A last window may hold overlap only."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def check_window(size: int, overlap: int) -> int:
    """The step of windows of this size; an overlap that leaves no step is an error."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"windows of {size} with an overlap of {overlap} never advance")
    return size - overlap


def sanitize(text: Column) -> Column:
    """Long base64 runs first, then long quoted strings, become placeholders."""
    # Patterns and placeholders.
    text = F.regexp_replace(text, r"[A-Za-z0-9+/]{100,}=*", "[BASE64_DATA_STRIPPED]")
    return F.regexp_replace(text, "\"[^\"]{500,}\"|'[^']{500,}'", "[LONG_STRING_STRIPPED]")


def stripped_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, OUTER_SPACE, ""))


def read_range(text: Column, start_line: int = 1, max_lines: int = 500) -> Column:
    """Array of numbered lines of a range; only newlines end lines here, so a final one opens an empty line."""
    first, most = max(1, start_line), max(1, min(max_lines, 1000))
    lines = F.slice(F.split(text, "\n", -1), first, most)
    return F.transform(lines, lambda line, i: F.format_string("%6d | %s", i + first, line))


def md5_bucket(text: Column, buckets: int) -> Column:
    """The md5 digest as one 128-bit number, modulo buckets (up to 2^31)."""
    return digest_bucket(F.md5(text), buckets)


def digest_bucket(digest: Column, buckets: int) -> Column:
    """A hexadecimal digest of 128 bits modulo buckets, folded 60 bits at a time."""
    out = None
    for start, size in ((1, 15), (16, 15), (31, 2)):
        part = F.conv(F.substring(digest, start, size), 16, 10).cast("long")
        out = part if out is None else (out * F.lit(16**size % buckets) + part)
        out = out % buckets
    return out.cast("int")


#: Fixed value: the URL namespace of version-5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Version-5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    parts = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
    return F.concat_ws("-", *parts)


def tokens(text: Column) -> Column:
    """Identifiers of a text in lower case: an ASCII letter or underscore, then any letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-zA-Z_][\p{L}\p{N}_]*)"), F.lit(1))
