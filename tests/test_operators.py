"""Retrieval, collections, state, sources, web pages and answers."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions import render
from corpusloom.operators import chunking, rag, retrieval, state, syntax, vectors, web
from corpusloom.operators.collection import Collection, stale_points
from corpusloom.plans.indexing import index_changes, to_points
from corpusloom.sources import codefs, readers, versions
from corpusloom.streaming.incremental import StateTable, index_due, index_stream

PYTHON = "import os\nfrom sys import path\n\ndef first(a):\n    return a\n\n@deco\ndef second():\n    def inner():\n        pass\n\nclass Third:\n    def method(self):\n        pass\n"


def files(spark, rows):
    return spark.createDataFrame(rows, "filepath string, content string")


# ---------------------------------------------------------------- retrieval


def test_dense_ties_and_zero_vectors(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("c", [0.0, 1.0])], "point_id string, dense array<float>")
    found = retrieval.dense_topk(rows, [1.0, 0.0], 3).collect()
    assert [(r.point_id, r.score) for r in found] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "query_id int, dense array<float>")
    batch = retrieval.dense_batch_topk(rows, queries, 2, query_block=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.point_id) for r in batch] == [(1, "a"), (1, "b"), (2, "c"), (2, "a")]


def test_fusion_of_disjoint_and_equal_lists(spark):
    branch = lambda rows: spark.createDataFrame(rows, "point_id string, score double")
    a, b, none = branch([("x", 2.0), ("y", 1.0)]), branch([("p", 9.0), ("q", 8.0)]), branch([])
    assert [(r.point_id, r.score) for r in retrieval.fuse([a, b], 10).collect()] == [("p", 1 / 61), ("x", 1 / 61), ("q", 1 / 62), ("y", 1 / 62)]
    assert [r.score for r in retrieval.fuse([a, a], 10).collect()] == [2 / 61, 2 / 62]
    assert [r.point_id for r in retrieval.fuse([a, none], 1).collect()] == ["x"]


def test_post_filter_keeps_rank_order(spark):
    hits = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.1)], "point_id string, score double")
    payload = spark.createDataFrame([("a", " 　 "), ("b", "long enough"), ("c", "long enough too")], "point_id string, content string")
    assert [r.point_id for r in retrieval.post_filter(hits, payload, 5, 0.5, 3).collect()] == ["b"]
    assert [r.point_id for r in retrieval.post_filter(hits, payload, 2).collect()] == ["a", "b"]


def test_filters_come_before_the_limit(spark):
    rows = spark.createDataFrame([(f"p{i}", [1.0, i / 10], f"src/{i}.py", "python" if i % 2 else "go", i > 5) for i in range(10)], "point_id string, dense array<float>, filepath string, language string, is_test boolean")
    found = retrieval.dense_topk(rows.filter(retrieval.payload_filter("src/", "python", True)), [1.0, 0.0], 2)
    assert [r.point_id for r in found.collect()] == ["p7", "p9"]
    assert rows.filter(retrieval.payload_filter()).count() == 10 and rows.filter(retrieval.payload_filter(is_test=False)).count() == 6


# ---------------------------------------------------------------- syntax


def test_chunks_by_definition(spark):
    found = chunking.by_definition(files(spark, [("a.py", PYTHON), ("b.xyz", "x\ny"), ("c.py", "not python ("), ("d.py", "")])).orderBy("filepath", "chunk_index").collect()
    assert [(r.filepath, r.chunk_index, r.line_start, r.line_end, r.type, r.symbols) for r in found] == [
        ("a.py", 0, 1, 2, "general", []), ("a.py", 1, 4, 5, "function_definition", ["first"]), ("a.py", 2, 7, 10, "general", []), ("a.py", 3, 12, 14, "class_definition", ["Third"]),
        ("b.xyz", 0, 1, 2, None, []), ("c.py", 0, 1, 1, "general", []),
    ]


@pytest.mark.parametrize("strategy", ["by_lines", "by_size", "ast", "hybrid"])
def test_chunking_reads_files_once(spark, tmp_path, strategy):
    rows = [("a.md", "# T\ntext\n## U\nmore"), ("b.py", PYTHON), ("c.txt", "x\n" * 120), ("d.md", None), ("e.py", "")]
    files(spark, rows).write.parquet(str(tmp_path / "f"))
    chunks = chunking.chunk(spark.read.parquet(str(tmp_path / "f")), strategy)
    assert chunks._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    apart = chunking.CHUNKERS[strategy](files(spark, rows[1:3] + rows[4:])).unionByName(chunking.by_heading(files(spark, rows[:1])))
    assert sorted(map(str, chunks.select(apart.columns).collect())) == sorted(map(str, apart.collect()))


def test_a_long_text_is_cut_in_one_pass(spark):
    text = "words on a line\n" * 250_000  # 4 MB
    df = spark.range(1).select(F.lit("a.txt").alias("filepath"), F.expr("repeat('words on a line\n', 250000)").alias("content"))
    sized = chunking.by_size(df).agg(F.count("*").alias("n"), F.max("line_end").alias("last"), F.max("chunk_index").alias("place")).first()
    assert (sized.n, sized.last) == (-(-len(text) // 450), 250_001) and sized.place == sized.n - 1
    lined = chunking.by_lines(df).agg(F.count("*").alias("n"), F.max("line_end").alias("last")).first()
    assert (lined.n, lined.last) == (-(-250_000 // 45), 250_000)


def test_hybrid_chunks_name_their_symbols(spark):
    found = chunking.hybrid(files(spark, [("a.py", PYTHON)]), 8, 2).orderBy("chunk_index").collect()
    assert [r.symbols for r in found] == [["first", "second"], ["second", "inner", "Third", "method"], ["method"]]
    assert found[0].content.endswith("\n\n/* Symbols: function:first, function:second */") and {r.type for r in found} == {"code"}


def test_other_languages():
    go = "package a\n\nimport \"x\"\n\nfunc F(a int) int {\n\treturn a\n}\n\nfunc (s S) M() {\n}\n\ntype T struct {\n\tA int\n}\n"
    assert [d[:4] for d in syntax.definitions("a.go", go)] == [("function_declaration", "F", 5, 7), ("method_declaration", "M", 9, 10), ("type_declaration", None, 12, 14)]
    ts = "import x from 'y'\nclass A {\n  m() {}\n}\ninterface I { a: string }\nfunction f() {\n}\nenum E { X }\n"
    assert [d[1] for d in syntax.definitions("a.ts", ts)] == ["A", None, "I", "f", "E"]
    ts = "class A {\n  private async go(a: number): Promise<void> {\n    if (a) {\n      return;\n    }\n  }\n}\ninterface I { cb: (a: string) => void }\nconst g = (a, b) => {\n  return xs.map(x => x + 1);\n};\n"
    assert [d[:4] for d in syntax.definitions("b.ts", ts)] == [
        ("class_declaration", "A", 1, 7), ("method_definition", None, 2, 6), ("interface_declaration", "I", 8, 8), ("arrow_function", None, 9, 11), ("arrow_function", "x", 10, 10),
    ]
    y = "apiVersion: v1\nmetadata:\n  name: my-config\n  # c: d\nlist:\n- a: 1\n  b: 2\n- c\nurl: http://x.y\nend: |\n  text\n"
    assert [d[2:] for d in syntax.definitions("x.yaml", y)] == [(a, b, False) for a, b in [(1, 1), (2, 3), (3, 3), (5, 8), (6, 6), (7, 7), (9, 9), (10, 11)]]
    tf = 'resource "a" "b" {\n  nested {\n  }\n}\n'
    assert [(d[0], d[1], d[4]) for d in syntax.definitions("m.tf", tf)] == [("block", "resource", False), ("block", "nested", False)]
    assert syntax.definitions("x.txt", "a") is None


def test_complexity(spark):
    found = {r.filepath: r for r in syntax.complexity(files(spark, [("a.py", PYTHON), ("e.py", ""), ("x.txt", "a"), ("b.go", "import \"x\"\nfunc F() {\n}\n")])).collect()}
    a = found["a.py"]
    assert a.line_count == 14 and a.def_count == 5 and a.import_count == 2 and a.max_depth >= 3 and a.node_count >= 15 and a.language == "python"
    assert a.complexity_score == round(0.4 * a.max_depth + 0.01 * a.node_count + 0.5 * 5 + 0.2 * 2, 2)
    assert found["x.txt"].error == "Unsupported extension .txt" and found["x.txt"].complexity_score is None
    assert found["e.py"].def_count == 0 and found["b.go"].import_count == 1


# ---------------------------------------------------------------- collection and state


def test_collection_versions(spark, tmp_path):
    provider = vectors.HashingEmbedder(8)
    c = Collection(spark, str(tmp_path / "c"))
    assert not c.exists() and c.healthy() == "degraded" and c.count() == 0
    c.create(8, buckets=4)
    assert c.create(8).exists() and c.count() == 0
    with pytest.raises(ValueError):
        c.create(9)
    make = lambda rows: to_points(files(spark, rows), provider, strategy="by_lines", size=2, overlap=0, buckets=4)
    c.upsert(make([("a.py", "1\n2\n3\n4\n5"), ("b.py", "x")]))
    assert c.count() == 4
    new = make([("a.py", "1\n2")])
    assert stale_points(c.read(), new).count() == 2
    c.upsert(new, "compat")
    assert c.count() == 4
    c.upsert(new)
    assert c.count() == 2 and {r.filepath for r in c.read().collect()} == {"a.py", "b.py"}
    row = c.get([new.first().point_id]).first()
    assert row.type == "code" and row.content == "1\n2" and len(row.dense) == 8 and row.commit_hash is None and row.path_segments == {"0": "a.py"}
    c.delete_files(spark.createDataFrame([("a.py",)], "filepath string"))
    assert [r.filepath for r in c.read().collect()] == ["b.py"]
    c.delete_files(spark.createDataFrame([("b.py",)], "filepath string"))
    assert c.count() == 0
    assert c.index_status("/w") == "Not Indexed"
    c.mark_indexed("/w", False)
    assert c.index_status("/w") == "In Progress / Stale"
    c.mark_indexed("/w")
    assert c.index_status("/w") == "Complete" and c.healthy() == "healthy"
    c.drop()
    assert not c.exists()


def test_a_broken_write_stands_in_nobodys_way(spark, tmp_path, monkeypatch):
    c = Collection(spark, str(tmp_path / "c")).create(8, buckets=4)
    make = lambda rows: to_points(files(spark, rows), vectors.HashingEmbedder(8), strategy="by_lines", buckets=4)
    c.upsert(make([("a.py", "1"), ("b.py", "2"), ("c.py", "3")]))
    state = lambda: {(r.filepath, r.content) for r in c.read().collect()}
    with monkeypatch.context() as m:
        m.setattr(c.log, "commit", lambda s: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            c.upsert(make([("a.py", "9")]))
    assert c.version == 1 and ("a.py", "1") in state()
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("*.parquet")}
    assert c.apply(make([("a.py", "9")]), spark.createDataFrame([("b.py",)], "filepath string")) == 2
    assert state() == {("a.py", "9"), ("c.py", "3")} and all(os.stat(p).st_mtime_ns == t for p, t in before.items())
    with pytest.raises(RuntimeError):  # another writer has been here
        c.log.commit({"version": 2, "data": [], "dropped": []})
    c.upsert(make([("b.py", "again")]))
    assert state() == {("a.py", "9"), ("b.py", "again"), ("c.py", "3")}
    assert c.compact() == 4 and c._state()["dropped"] == [] and len(c._state()["data"]) == 1 and c.vacuum() > 0
    assert state() == {("a.py", "9"), ("b.py", "again"), ("c.py", "3")} and c.compact() == 4
    # Stored vectors can be searched as they are.
    long = vectors.postings_of(c.read(), ["point_id"])
    assert long.count() == 1 and [r.score for r in retrieval.sparse_topk(c.read(), vectors.sparse_of(spark, "Again"), 5).collect()] == [1.0]


def test_a_refused_file_leaves_the_others_indexed(spark, tmp_path):
    for name, text in (("a.py", "fine"), ("b.py", "poison"), ("c.py", "fine too")):
        (tmp_path / name).write_text(text)

    class Picky(vectors.HashingEmbedder):
        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise OSError("refused")
            return super().embed(texts)

    codefs.register(spark)
    c = Collection(spark, str(tmp_path / "x" / "c")).create(8, buckets=4)
    scan = spark.read.format("codefs").option("path", str(tmp_path)).load().filter("path NOT LIKE '%/x/c/%'")
    monkey = vectors.with_retries.__defaults__
    vectors.with_retries.__defaults__ = (1, 0, 0)
    try:
        found = index_changes(scan, c, state.empty(spark), Picky(8), root=str(tmp_path), strategy="by_lines").collect()
    finally:
        vectors.with_retries.__defaults__ = monkey
    rows = {os.path.basename(r.path): (r.embed_retries, r.failed, r.chunk_count) for r in found}
    assert rows == {"a.py": (None, None, 1), "b.py": (1, None, None), "c.py": (None, None, 1)}
    assert {os.path.basename(r.filepath) for r in c.read().collect()} == {"a.py", "c.py"}


def test_commits_and_tracked_files_in_the_index(spark, tmp_path):
    import subprocess

    root = tmp_path / "w"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-c", "user.name=N", "-c", "user.email=e@x", "-C", str(root), *a], check=True, capture_output=True)
    (root / "a.py").write_text("x")
    (root / "b.py").write_text("y")
    git("init", "-q")
    git("add", "a.py")
    git("commit", "-qm", "first")
    c, table, provider = Collection(spark, str(tmp_path / "c")).create(8, buckets=2), StateTable(spark, str(tmp_path / "s")), vectors.HashingEmbedder(8)
    index_stream(spark, str(root), c, table, provider, str(tmp_path / "cp"), strategy="by_lines", git=True, only_tracked=True).awaitTermination(120)
    assert [(os.path.basename(r.filepath), r.commit_author, r.commit_subject) for r in c.read().collect()] == [("a.py", "N", "first")]
    # A file that has waited long enough is tried again, though it has not changed.
    waiting = table.read().withColumn("checksum", F.lit(None).cast("string")).withColumn("last_modified", F.lit(None).cast("timestamp")).withColumn("embed_retries", F.lit(1)).withColumn("last_embed_attempt", F.lit(0.0))
    table.append(waiting.withColumn("gone", F.lit(False)))
    index_due(spark, str(root), c, table, provider, strategy="by_lines")
    row = table.read().first()
    assert (row.embed_retries, row.chunk_count) == (None, 1) and c.count() == 1 and c.version == 2


def test_reindex_truth_table(spark):
    t0, t1 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    known = [
        ("failed", t0, "old", 1, t0, 6, 0.0, True), ("cooling", t0, "old", 1, t0, 2, 1000.0, None), ("cooled", t0, "old", 1, t0, 2, 1000.0 - 241, None),
        ("long", t0, "old", 1, t0, 30, 1000.0 - 3599, None), ("same", t1, "old", 1, t0, None, None, None), ("touched", t0, "new", 1, t0, None, None, None), ("changed", t0, "old", 1, t0, 0, None, False),
    ]
    now = spark.createDataFrame([(p, t1, "new") for p in ("unknown", "failed", "cooling", "cooled", "long", "same", "touched", "changed")], "path string, mtime timestamp, sha256 string")
    known = spark.createDataFrame(known, state.SCHEMA)
    found = {r.path: r.reindex for r in state.should_reindex(now, known, F.lit(1000.0)).collect()}
    assert found == {"unknown": True, "failed": False, "cooling": False, "cooled": True, "long": False, "same": False, "touched": False, "changed": True}
    failed = known
    for _ in range(6):
        failed = state.after_failure(failed, spark.createDataFrame([("same",), ("fresh",)], "path string"), F.lit(5.0))
    rows = {r.path: (r.embed_retries, r.failed) for r in failed.collect()}
    assert rows["same"] == (6, True) and rows["fresh"] == (6, True) and rows["touched"] == (None, None)
    done = state.after_success(failed, now.filter("path = 'same'").withColumn("chunk_count", F.lit(0)), F.current_timestamp())
    assert [(r.embed_retries, r.failed, r.chunk_count, r.checksum) for r in done.filter("path = 'same'").collect()] == [(None, None, 0, "new")]


# ---------------------------------------------------------------- sources


def tree(root):
    for path, content in {
        "a.py": "print(1)\n", "pkg/__init__.py": "", "pkg/_private.py": "x = 1\n", "_dir/b.md": "# T\ntext\n", ".hidden/c.py": "no", "build/d.py": "no", "Dockerfile": "FROM x\n",
        "skip.log": "no", "x.conf": "ignored", "keep.conf": "kept", "sub/x.conf": "ignored too", "gen/out.py": "ignored", ".gitignore": "*.conf\n!keep.conf\n/gen/\n# comment\n", "crlf.txt": "a\r\nb\rc",
    }.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", newline="") as f:
            f.write(content)


WANTED = {"a.py", "pkg/__init__.py", "pkg/_private.py", "_dir/b.md", "Dockerfile", "keep.conf", "crlf.txt"}


def test_scan(spark, tmp_path):
    tree(tmp_path)
    codefs.register(spark)
    rows = spark.read.format("codefs").option("path", str(tmp_path)).load()
    found = {os.path.relpath(r.path, tmp_path): r for r in rows.collect()}
    assert sorted(map(tuple, codefs.files(spark, str(tmp_path)).collect())) == sorted(map(tuple, rows.collect()))
    assert {r.path for r in codefs.listing(spark, f"file://{tmp_path}", most=1).collect()} == {f"{tmp_path}/{x}" for x in WANTED}  # many rounds, and a URI
    assert set(found) == WANTED and found["pkg/__init__.py"].length == 0 and found["a.py"].change == "upsert"
    text = {os.path.relpath(r.path, tmp_path): r.text for r in rows.select("path", readers.extracted().alias("text")).collect()}
    assert text["crlf.txt"] == "a\nb\nc" and text["pkg/__init__.py"] == ""


def test_readers():
    assert readers.extract("a.py", b"\xff\r\n") == "�\n" and readers.extract("a.xyz", b"") is None and readers.extract("d/Dockerfile", b"x") == "x"
    assert readers.extract("a.pdf", b"not a pdf").startswith("# Error processing PDF: ") and "a.docx" in readers.extract("a.docx", b"")
    page = readers.pdf_markdown("T", "A", None, "p.pdf", ["Short Heading\nlower start\nA long line that ends with a full stop."])
    assert "# T" in page and "### Page 1" in page and "#### Short Heading" in page and "#### lower" not in page and "#### A long" not in page
    readers.register_reader([".bad"], lambda p, d: 1 / 0)
    assert readers.extract("x.bad", b"") is None
    del readers.READERS[".bad"]


def test_file_tree(tmp_path):
    tree(tmp_path)
    lines = codefs.file_tree(str(tmp_path), 1).split("\n")
    assert lines[0] == f"# File Tree for {tmp_path.name}" and "├── pkg/" in lines and "└── x.conf" in lines and not any("hidden" in x for x in lines)
    assert codefs.file_tree(str(tmp_path / "a.py")).endswith("is not a directory.") and codefs.file_tree("/none").endswith("does not exist.")


def test_versions(spark):
    log = "\x1eh2\x1fAnn\x1fa@x\x1f2024-01-02\x1fsecond: \x22q\x22\x1d\0\na.py\0b c.py\0\x1eh1\x1fBob\x1fb@x\x1f2024-01-01\x1ffirst\x1d\0\na.py\0\x1ebroken\x1d\0x"
    rows = spark.createDataFrame(versions.parse_log(log, "/r"), versions.COMMIT)
    found = {r.path: r.commit_hash for r in versions.latest_commits(rows).collect()}
    assert found == {"/r/a.py": "h2", "/r/b c.py": "h2"}
    files_ = files(spark, [("/r/a.py", "x"), ("/r/new.py", "y")])
    assert {r.filepath: r.commit_author for r in versions.with_commits(files_, versions.latest_commits(rows)).collect()} == {"/r/a.py": "Ann", "/r/new.py": None}
    assert versions.only_tracked(files_, None).count() == 2


def test_git_repository(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-c", "user.name=N", "-c", "user.email=e@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    assert not versions.is_repository(str(tmp_path)) and versions.tracked_files(spark, str(tmp_path)) is None
    git("init", "-q")
    (tmp_path / "a.py").write_text("1")
    (tmp_path / "b.py").write_text("1")
    git("add", "a.py")
    git("commit", "-qm", "one: two")
    assert [r.path for r in versions.tracked_files(spark, str(tmp_path)).collect()] == [f"{tmp_path}/a.py"]
    row = versions.latest_commits(versions.commit_log(spark, str(tmp_path))).first()
    assert (row.path, row.commit_author, row.commit_subject) == (f"{tmp_path}/a.py", "N", "one: two")


def test_incremental_stream(spark, tmp_path):
    """Index, index again unchanged, then change, add and delete files: the collection follows."""
    root = tmp_path / "w"
    tree(root)
    c = Collection(spark, str(tmp_path / "c")).create(8, buckets=4)
    table, provider = StateTable(spark, str(tmp_path / "s")), vectors.HashingEmbedder(8)
    run = lambda: index_stream(spark, str(root), c, table, provider, str(tmp_path / "cp"), strategy="by_lines").awaitTermination(120)
    assert run() is not False
    paths = lambda: {os.path.relpath(r.filepath, root) for r in c.read().collect()}
    assert paths() == WANTED - {"pkg/__init__.py"} and c.index_status(str(root)) == "Complete"
    states = {os.path.relpath(r.path, root): r.chunk_count for r in table.read().collect()}
    assert set(states) == WANTED and states["pkg/__init__.py"] == 0
    (root / "a.py").write_text("changed\n")
    os.utime(root / "a.py", (2_000_000_000, 2_000_000_000))
    (root / "new.go").write_text("package x\n")
    os.remove(root / "Dockerfile")
    run()
    assert paths() == (WANTED | {"new.go"}) - {"pkg/__init__.py", "Dockerfile"}
    assert [r.content for r in c.read().filter(F.endswith("filepath", F.lit("/a.py"))).collect()] == ["changed"]
    assert "Dockerfile" not in {os.path.relpath(r.path, root) for r in table.read().collect()}


def test_unchanged_files_are_left_alone(spark, tmp_path):
    tree(tmp_path)
    codefs.register(spark)
    c = Collection(spark, str(tmp_path / "c" / "d")).create(8, buckets=4)
    scan = spark.read.format("codefs").option("path", str(tmp_path)).load().filter("path NOT LIKE '%/c/d/%'")
    first = index_changes(scan, c, state.empty(spark), vectors.HashingEmbedder(8), root=str(tmp_path), strategy="by_size")
    version = c.version
    assert first.count() == len(WANTED)
    second = index_changes(scan, c, first.drop("gone"), vectors.HashingEmbedder(8), root=str(tmp_path), strategy="by_size")
    assert c.version == version and second.count() == 0


# ---------------------------------------------------------------- web


PAGE = "<html><head><title>x</title></head><body><script>no()</script><nav>menu</nav><h1>Top</h1><p>One &amp; <a href='https://a.org/b'>two</a></p><ul><li>i</li><li>j</li></ul><h2 class=x>Sub</h2><pre>code</pre></body></html>"


def test_html_to_markdown(spark):
    df = spark.createDataFrame([(PAGE,), ("plain",), ("",)], "html string")
    a, b, c = (r[0] for r in df.select(web.html_to_markdown(F.col("html"))).collect())
    assert a.startswith("# Top\n\nOne & [two](https://a.org/b)") and "\n- i\n- j" in a and "## Sub" in a and "```\ncode\n```" in a and "menu" not in a and "no()" not in a
    assert (b, c) == ("plain", "")


def test_contents_and_sections(spark):
    md = "intro line\n# Installation\nrun it\n## Configuration\nset it\n"
    chunks = web.page_chunks(spark.createDataFrame([("https://u", md)], "url string, markdown string"))
    toc = render.toc_text(chunks).first().toc
    assert toc.startswith("## Table of Contents: https://u\n\n| # | Section | Level | Lines | ~Tokens |") and "| 0 | (preamble) | intro | 1-1 | 2 |\n| 1 | Installation | H1 | 2-3 | 5 |" in toc
    text = lambda names: render.sections_text(chunks, names).first().text
    assert text([]) == "No sections requested." and "(2 of 3 chunks returned)" in text(["2", "INSTALL "]) and text([""]).count("---\n###") == 3
    assert text(["zzz"]).endswith("Available sections were:\n  [0] (preamble)\n  [1] Installation\n  [2] Configuration")
    assert text(["config"]).split("\n")[3:6] == ["---", "### Configuration  (H2, ~5 tokens)", ""]


def test_long_pages_are_shortened(spark):
    long = "# A\n" + "x" * 50 + "\n# B\nb\n# C\nc"
    pages = spark.createDataFrame([("many", long), ("one", "y" * 60), ("short", "z")], "url string, markdown string")
    shown = {r.url: r.shown for r in render.shorten_page(web.page_chunks(pages), pages, most=40).collect()}
    assert shown["short"] == "z" and shown["one"] == "y" * 40 + "\n\n... [TRUNCATED - page too large] ..." and "This page has 3 sections." in shown["many"] and shown["many"].endswith("# B\nb")


def test_cache(spark):
    pages = spark.createDataFrame([("u", "# A\nb")], "url string, markdown string")
    cache = web.page_chunks(pages, F.timestamp_seconds(F.lit(1000)))
    assert web.live(cache, F.timestamp_seconds(F.lit(1600))).count() == 1 and web.live(cache, F.timestamp_seconds(F.lit(1601))).count() == 0
    again = web.store(cache, web.page_chunks(pages, F.timestamp_seconds(F.lit(2000))))
    assert again.count() == 1 and web.live(again, F.timestamp_seconds(F.lit(2500))).count() == 1


def test_saved_pages(spark):
    pages = spark.createDataFrame([("https://a.org/x", "body", "https://a.org"), ("https://a.org/x#1", "other", None), ("https://a.org/e", "", None)], "url string, markdown string, seed_url string")
    saved = {r.url: r for r in web.saved_pages(pages).collect()}
    assert saved["https://a.org/x"].content == "---\nsource_url: https://a.org/x\nseed_url: https://a.org\n---\n\nbody" and set(saved) == {"https://a.org/x", "https://a.org/x#1"}
    assert len({r.path for r in saved.values()}) == 2
    assert {r.url for r in web.crawled_urls(web.saved_pages(pages)).collect()} == set(saved)
    todo = web.to_crawl(spark.createDataFrame([("https://a.org/x",), ("ftp://b",), ("https://c/{1..2}",)], "url string"), web.crawled_urls(web.saved_pages(pages)), recursive=True)
    assert sorted(r.url for r in todo.collect()) == ["https://c/1", "https://c/2"]


def test_crawl(spark):
    link = lambda *t: "".join(f'<a href="{x}">l</a>' for x in t)
    site = {"https://s.org/": link("https://s.org/a", "https://s.org/b", "https://other.org/"), "https://s.org/a": link("https://s.org/c", "https://s.org/"), "https://s.org/b": link("https://s.org/c"), "https://s.org/c": link("https://s.org/d"), "https://s.org/d": "", "https://other.org/": ""}
    pages = spark.createDataFrame(list(site.items()), "url string, html string")
    depths = lambda **o: {r.url[-1]: r.depth for r in web.crawl("https://s.org/", pages, **o).collect()}
    assert depths() == {"/": 0, "a": 1, "b": 1, "c": 2, "d": 3} and depths(max_depth=1) == {"/": 0, "a": 1, "b": 1}
    assert depths(max_pages=2) == {"/": 0, "a": 1} and depths(include=["*a", "*c"]) == {"/": 0, "a": 1, "c": 2} and depths(exclude=["*/c"]) == {"/": 0, "a": 1, "b": 1}


def test_many_seeds_take_as_many_jobs_as_one(spark):
    link = lambda *t: "".join(f'<a href="{x}">l</a>' for x in t)
    site = [(f"https://s{i}.org/{p}", link(*(f"https://s{i}.org/{q}" for q in "abcd"), f"https://s{i + 1}.org/a")) for i in range(200) for p in ["", *"abc"]]
    pages = spark.createDataFrame(site, "url string, html string")

    def run(n, **limits):
        spark.sparkContext.setJobGroup(f"crawl-{n}-{len(limits)}", "")
        found = web.crawl_all(spark.createDataFrame([(f"https://s{i}.org/",) for i in range(n)], "url string"), pages, **limits)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"crawl-{n}-{len(limits)}"))
        return jobs, sorted(map(tuple, found.collect()))

    try:
        one, many = run(1), run(200)
        assert abs(many[0] - one[0]) <= 4 and len(many[1]) == 800 and [r for r in many[1] if r[0] == "https://s0.org/"] == one[1]
        assert len(run(200, max_pages=3)[1]) == 600
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_crawl_runs(spark):
    link = lambda *t: "<p>text</p>" + "".join(f'<a href="{x}">l</a>' for x in t)
    site = [("https://s.org/", link("https://s.org/a", "https://s.org/b")), ("https://s.org/a", link("https://s.org/c")), ("https://s.org/b", ""), ("https://s.org/c", link()), ("https://s.org/1", link()), ("https://s.org/2", link())]
    pages = spark.createDataFrame(site, "url string, html string")
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    first = web.crawl_run(urls("https://s.org/{1..2}", "https://s.org/a", "https://s.org/a", "https://s.org/none"), pages)
    assert {r.url for r in first.collect()} == {"https://s.org/1", "https://s.org/2", "https://s.org/a"}
    more = web.crawl_run(urls("https://s.org/", "ftp://s.org/"), pages, first, recursive=True).collect()
    assert {r.url for r in more} == {"https://s.org/", "https://s.org/c"} and all("seed_url: https://s.org/\n" in r.content for r in more)
    assert web.crawl_run(urls("https://s.org/a"), pages, first, recursive=True).count() == 0


def test_web_search(spark):
    with pytest.raises(ValueError):
        web.search_web(spark, "q", backend="brave")
    asked = []
    web.register_search_backend("duckduckgo", lambda q, n, c: asked.append(n) or [{"url": "https://a"}, {"title": "T", "url": "https://b", "snippet": "s" * 130}])
    found = web.search_web(spark, "q", 50)
    assert asked == [20] and [tuple(r) for r in found.limit(1).collect()] == [("Untitled", "https://a", "")]
    assert found.select(render.web_results().alias("s")).collect()[1].s == "s" * 120 + "..."
    answers = spark.createDataFrame([(None, "42")], "url string, content string")
    assert web.results_and_answers(found, answers).count() == 3
    pages = spark.createDataFrame([("https://b", "# text")], "url string, markdown string")
    ranked = found.withColumn("rank", F.monotonically_increasing_id())
    assert [(r.url, r.shown) for r in web.research(ranked, pages).collect()] == [("https://b", "# text")]
    del web.SEARCH_BACKENDS["duckduckgo"]


def test_scout(spark):
    pages = spark.createDataFrame([("u", "# A\nb\n# C\nd"), ("v", "w"), ("e", "")], "url string, markdown string")
    text = lambda *a, **k: {r.url: r.text for r in web.scout(pages, *a, **k).collect()}
    assert text(["u", "v", "e"], 0) == {"u": "# A\nb\n# C\nd"} and text(["u", "v", "e"], 50)["v"] == "w"
    assert text(["u"], mode="toc")["u"].startswith("## Table of Contents: u")
    found = text(["u", "v"], mode="sections", wanted={"u": ["c"]})
    assert "### C  (H1" in found["u"] and found["v"] == "No sections requested."


def test_rendering(spark):
    hits = spark.createDataFrame([("p", None, "x", "go", 0, 0.123), ("q", "a.py", "y", "python", 1, 0.9)], "point_id string, filepath string, content string, language string, chunk_index int, score double")
    assert render.search_results(hits, "c") == "# Semantic Search Results (Collection: c)\n\n### a.py (Score: 0.90)\n```python\ny\n```\n\n### Unknown File (Score: 0.12)\n```go\nx\n```\n"
    assert render.search_results(hits.filter("false"), "c") == "No relevant code found in collection 'c'."
    assert hits.filter("point_id = 'q'").select(render.hit_json().alias("j")).first().j == '{"id":"q","score":0.9,"payload":{"filepath":"a.py","content":"y","language":"python","chunk_index":1}}'
    found = spark.createDataFrame([(5, "T", "u", "s"), (2, "S", "v", "t")], "rank int, title string, url string, snippet string")
    assert render.web_text(found, "q") == "# Web Search Results for: q\n\n## 1. S\n- **URL**: v\n- **Snippet**: t\n\n## 2. T\n- **URL**: u\n- **Snippet**: s\n"
    latest = spark.createDataFrame([("/r/a.py", "h", "A", "e", "d", "s")], "path string, commit_hash string, commit_author string, commit_email string, commit_date string, commit_subject string")
    assert "- **Author**: A <e>" in versions.history_text("/r/a.py", latest) and versions.history_text("/r/b", latest).startswith("No git history found for: /r/b")
    assert rag.answer_text("a", "s") == "## Answer\n\na\n\n## Sources\n\ns"


# ---------------------------------------------------------------- answers and settings


def test_ask(spark):
    provider = vectors.HashingEmbedder(16)
    points = to_points(files(spark, [("auth.py", "def login(user): check the password of the user"), ("x.md", "# nothing\nabout cooking of vegetables"), ("t.py", "x")]), provider, strategy="by_lines")
    seen = {}

    class Chat(rag.EchoProvider):
        def complete(self, messages, **options):
            seen.update(options, system=messages[0]["content"])
            return super().complete(messages)

    answer, sources = rag.ask(points, "login password", Chat(), provider, context="be kind")
    assert seen["temperature"] == 0.3 and seen["system"].endswith("What the user adds:\nbe kind")
    assert answer.startswith("# Question\n\nlogin password\n\n# Excerpts\n\n### [1] auth.py (lines 1-1)\n```python\n") and "x\n```" not in answer
    assert sources.startswith("- [`auth.py`](auth.py:1) (score: 0.0")
    with pytest.raises(ValueError):
        rag.ask(points.filter("false"), "q", Chat(), provider)


def test_blueprints():
    assert rag.parse_blueprint('{"blueprint": [{"file": "a"}]}') == [{"file": "a"}] and rag.parse_blueprint('{"file": "a"}') == [{"file": "a"}] and rag.parse_blueprint("[]") == []
    with pytest.raises(rag.BlueprintError):
        rag.parse_blueprint("no")
    with pytest.raises(rag.BlueprintError):
        rag.blueprint(object(), "t", "c")
    assert len(rag.shortened_output("x" * 5000)) < 2100 and rag.shortened_output("y") == "y"


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert vectors.with_retries(flaky, first_wait=0) == "done"
    with pytest.raises(RuntimeError):
        vectors.with_retries(lambda: 1 / 0, attempts=2, first_wait=0)

    def refused():
        calls.append("r")
        raise PermissionError

    with pytest.raises(PermissionError):
        vectors.with_retries(refused, first_wait=0)
    assert calls.count("r") == 1
    with pytest.raises(ValueError):
        vectors.embed_query(vectors.HashingEmbedder(), "")


def test_settings(tmp_path):
    (tmp_path / "g.yaml").write_text("chunking: {strategy: hybrid, size_lines: 9}\nsearch_backend: searxng\n")
    (tmp_path / "p.yaml").write_text("chunking: {size_lines: 7}\n")
    s = config.load(project_file=str(tmp_path / "p.yaml"), global_file=str(tmp_path / "g.yaml"), environment={"CORPUSLOOM_CHUNKING__OVERLAP_LINES": "2", "OTHER": "x"}, git={"enabled": False})
    assert s["chunking"] == {"strategy": "hybrid", "size_chars": 500, "overlap_chars": 50, "size_lines": 7, "overlap_lines": 2} and s["git"] == {"enabled": False, "only_tracked": False} and s["search_backend"] == "searxng"
    assert config.collection_name("/a/proj") == "proj" and config.collection_name(None) == "global"
