"""Expressions against plain Python over odd strings."""

import hashlib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths, text
from corpusloom.operators import chunking, vectors

PARTS = ["a", "Bc_1", "é", "漢", " ", "  ", "\t", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", " ", " ", "\xa0", "　", "# H", "\n## Two \n", "\n####### no\n", "#no", "```\n# fenced\n```", "9z", "_x", "\U0001f600", "́"]


def strings(n=300, seed=0):
    rng = random.Random(seed)
    return ["", "\n", "\r\n", "x\n", "\n\n", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))) for _ in range(n))]


def column(spark, values, expression, name="s"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r.out for r in df.select("i", expression(F.col(name)).alias("out")).orderBy("i").collect()]


def test_split_lines(spark):
    assert column(spark, [*strings(), None], text.split_lines) == [s.splitlines() for s in strings()] + [[]]


def test_stripped_length(spark):
    assert column(spark, strings(), text.stripped_length) == [len(s.strip()) for s in strings()]


def test_tokens(spark):
    assert column(spark, strings(), text.tokens) == [re.findall(r"[a-zA-Z_]\w*", s.lower()) for s in strings()]


@pytest.mark.parametrize("buckets", [7, 50_000, 2**31])
def test_md5_bucket(spark, buckets):
    want = [int(hashlib.md5(s.encode()).hexdigest(), 16) % buckets for s in strings(50)]
    assert column(spark, strings(50), lambda c: text.md5_bucket(c, buckets)) == [w if w < 2**31 else w - 2**32 for w in want]


def test_uuid5(spark):
    assert column(spark, strings(50), text.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, s)) for s in strings(50)]


def test_read_range(spark):
    def model(s, start, most):
        start, most = max(1, start), max(1, min(most, 1000))
        return [f"{i:6d} | {x}" for i, x in enumerate(s.split("\n"), 1) if start <= i < start + most]

    for start, most in ((1, 500), (2, 3), (-5, 0), (100, 5)):
        assert column(spark, strings(40), lambda c, a=start, b=most: text.read_range(c, a, b)) == [model(s, start, most) for s in strings(40)]


def test_sanitize(spark):
    runs = ["A" * 99, "A" * 100 + "==", '"' + "x" * 499 + '"', '"' + "x" * 500 + '"', "'" + "y\n" * 300 + "'", '"' + "Z" * 600 + '" and \'short\'', "'" + '"' * 600 + "'"]

    def model(s):
        s = re.sub(r"[A-Za-z0-9+/]{100,}=*", "[BASE64_DATA_STRIPPED]", s)
        return re.sub("\"[^\"]{500,}\"|'[^']{500,}'", "[LONG_STRING_STRIPPED]", s)

    assert column(spark, runs, text.sanitize) == [model(r) for r in runs]


@pytest.mark.parametrize("size, overlap", [(1, 0), (3, 1), (50, 5)])
def test_line_windows(spark, size, overlap):
    texts = strings(80) + ["\n".join(f"line {i}" for i in range(n)) for n in (1, size - overlap, size, size + 1, 2 * size)]

    def model(s):
        lines, step = s.splitlines(), size - overlap
        return [("\n".join(lines[a : a + size]), k, a + 1, min(a + size, len(lines))) for k, a in enumerate(range(0, len(lines), step))]

    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(texts)], "filepath string, content string")
    found = sorted((int(r.filepath), r.chunk_index, r.content, r.line_start, r.line_end) for r in chunking.by_lines(df, size, overlap).collect())
    assert found == sorted((i, k, c, a, b) for i, s in enumerate(texts) for c, k, a, b in model(s))


@pytest.mark.parametrize("size, overlap", [(1, 0), (7, 2), (500, 50)])
def test_character_windows(spark, size, overlap):
    texts = strings(80) + ["é\n" * 600]

    def model(s):
        return [(s[a : a + size], k, 1 + s[:a].count("\n"), 1 + s[: a + size].count("\n")) for k, a in enumerate(range(0, len(s), size - overlap))]

    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(texts)], "filepath string, content string")
    found = sorted((int(r.filepath), r.chunk_index, r.content, r.line_start, r.line_end) for r in chunking.by_size(df, size, overlap).collect())
    assert found == sorted((i, k, c, a, b) for i, s in enumerate(texts) for c, k, a, b in model(s))


def markdown_model(s, size, step):
    lines = s.splitlines()
    heads = [(i, m) for i, x in enumerate(lines) if (m := re.match(r"^(#{1,6})\s+(.+)$", x))]
    begins = [(0, None)] if lines and (not heads or heads[0][0] > 0) else []
    begins += heads
    out = []
    for n, (b, m) in enumerate(begins):
        end = begins[n + 1][0] if n + 1 < len(begins) else len(lines)
        kind = f"markdown_h{len(m[1])}" if m else "markdown_intro" if heads else None
        for a in range(b, end, step):
            out.append(("\n".join(lines[a : min(a + size, end)]), len(out), a + 1, min(a + size, end), kind, [m[2]] if m else []))
    return out


@pytest.mark.parametrize("size, overlap", [(2, 0), (3, 1), (100, 10)])
def test_markdown_sections(spark, size, overlap):
    texts = strings(150) + ["# One\ntext\n# One\n" + "line\n" * 130, "preamble\n\n###### Six  \n"]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(texts)], "filepath string, content string")
    found = sorted((int(r.filepath), r.chunk_index, r.content, r.line_start, r.line_end, r.type or "", list(r.symbols)) for r in chunking.by_heading(df, size, overlap).collect())
    assert found == sorted((i, k, c, a, b, t or "", s) for i, x in enumerate(texts) for c, k, a, b, t, s in markdown_model(x, size, size - overlap))


def test_windows_that_never_advance(spark):
    df = spark.createDataFrame([("a", "b")], "filepath string, content string")
    for f in (chunking.by_lines, chunking.by_size, chunking.by_heading, chunking.by_definition):
        with pytest.raises(ValueError):
            f(df, 5, 5)


def test_sparse_vectors(spark):
    def model(s, vocabulary):
        counts = {}
        for t in re.findall(r"[a-zA-Z_]\w*", s.lower()):
            i = int(hashlib.md5(t.encode()).hexdigest(), 16) % vocabulary
            counts[i] = counts.get(i, 0) + 1
        norm = sum(c * c for c in counts.values()) ** 0.5
        return {i: c / norm for i, c in counts.items()}

    texts = strings(60)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id int, content string")
    for vocabulary in (7, 50_000):
        rows = vectors.with_sparse(df, vocabulary=vocabulary, column="v").collect()
        for r in rows:
            want = model(texts[r.id], vocabulary)
            assert r.v.indices == sorted(want) and r.v["values"] == pytest.approx([want[i] for i in sorted(want)])
        long = {(r.id, r.idx): r.val for r in vectors.postings(df, ["id"], vocabulary=vocabulary).collect()}
        assert long == pytest.approx({(i, k): v for i, s in enumerate(texts) for k, v in model(s, vocabulary).items()})


def test_paths(spark):
    files = ["src/a.py", "Dockerfile", "x/Dockerfile", "latest.py", "a/.hidden/b.go", "build/x.ts", "a.tar.gz", ".bashrc", "noext", "a/spec.md", "x/__init__.py", "v.yml", "a b/c.conf", "end."]
    import os

    suffix = lambda p: os.path.splitext(os.path.basename(p))[1] if os.path.splitext(p)[1] != "." else ""
    assert column(spark, files, paths.suffix_of) == [suffix(p) for p in files]
    assert column(spark, files, paths.language) == [paths.LANGUAGES.get(suffix(p) or os.path.basename(p), "unknown") for p in files]
    assert column(spark, files, paths.is_test) == ["test" in os.path.basename(p) or "spec" in os.path.basename(p) for p in files]
    assert column(spark, ["/w/p/src/a.py", "/other/x"], lambda c: paths.path_segments(c, "/w/p")) == [{"0": "src", "1": "a.py"}, {"0": "/", "1": "other", "2": "x"}]
    assert column(spark, files, paths.should_handle) == [p in ("src/a.py", "Dockerfile", "x/Dockerfile", "latest.py", "a/spec.md", "x/__init__.py", "v.yml", "a b/c.conf") for p in files]


def test_urls(spark):
    urls = ["https://docs.a.org/x/y", "https://a.org", "https://a.org/", "http://a.org/d/", "https://a.org/p?q=1&r=2", "https://a.org/p#frag", "nohost"]

    def model(u):
        from urllib.parse import urlparse

        p = urlparse(u)
        inner = p.path.strip("/")
        inner = "index" if not inner else f"{inner}/index" if p.path.endswith("/") else inner
        if p.query:
            inner += "_" + hashlib.md5(p.query.encode()).hexdigest()[:6]
        host = p.netloc.replace(".", "_")
        return f"{host}/{inner}.md" if host else f"{inner}.md"

    assert column(spark, urls, paths.url_to_path) == [model(u) for u in urls]
    df = spark.createDataFrame([("a/{1..3}/{1..3}/{5..6}",), ("b/{3..1}",), ("c",)], "url string")
    assert [r.url for r in paths.expand_urls(df).collect()] == ["a/1/1/{5..6}", "a/2/2/{5..6}", "a/3/3/{5..6}", "b/3", "b/2", "b/1", "c"]
