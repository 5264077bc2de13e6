"""The feed of changes, the stream over it, and the tables that it keeps: bounded batches, work in proportion to what changed."""

import os
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import state as states
from corpusloom.operators.collection import Collection
from corpusloom.operators.vectors import HashingEmbedder
from corpusloom.plans.staging import clean_up, shared_folder, staged
from corpusloom.sources import codefs, versions
from corpusloom.streaming.incremental import StateTable, index_stream


def folders(path, name):
    return sorted(os.listdir(path / name)) if (path / name).exists() else []


def test_a_large_tree_arrives_in_bounded_batches(spark, tmp_path, monkeypatch):
    """10,100 files at 1,000 a batch are 11 batches of one run; a run that breaks goes on at its place."""
    from corpusloom.streaming import incremental

    root = tmp_path / "tree"
    for d in range(101):
        os.makedirs(root / f"d{d}")
        for f in range(100):
            (root / f"d{d}" / f"{f}.txt").write_text("" if d < 100 else f"text {f}")
    sizes, plain = [], incremental.index_batch

    def counting(spark, changes, *a, **b):
        sizes.append(changes.count())
        if len(sizes) == 4:
            raise OSError("the machine went away")
        plain(spark, changes, *a, **b)

    monkeypatch.setattr(incremental, "index_batch", counting)
    c, table = Collection(spark, str(tmp_path / "c")).create(8, buckets=2), StateTable(spark, str(tmp_path / "state"))
    run = lambda: index_stream(spark, str(root), c, table, HashingEmbedder(8), str(tmp_path / "cp"), strategy="by_lines").awaitTermination(300)
    with pytest.raises(Exception, match="went away"):
        run()
    assert len(sizes) == 4 and table.read().count() == 3000
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    assert run() is not False
    assert len(sizes) == 12 and sum(sizes) == 11_100 and max(sizes) <= 1000  # the broken batch came again, the three before it did not
    assert table.read().count() == 10_100 and c.index_status(str(root)) == "Complete" and c.count() == 100
    assert set(os.listdir(shared_folder(spark).removeprefix("file:"))) == before  # what batches stage goes with them
    for f in range(100):
        os.remove(root / "d0" / f"{f}.txt")
    run()
    assert sizes[12:] == [100] and table.read().count() == 10_000
    run()
    assert len(sizes) == 13  # nothing has changed
    assert len(folders(tmp_path / "cp-feed", "snapshots")) == 1 and len(folders(tmp_path / "cp-feed", "log")) <= 2


def test_parts_keep_both_bounds(spark):
    rows = spark.createDataFrame([(f"p{i:04d}", 1, 10 if i % 7 else 500, "upsert") for i in range(500)] + [("zz", 1, None, "delete")], codefs.CHANGE)
    found = codefs.numbered(rows.repartition(7), 60, 1000).groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("path").alias("a"), F.max("path").alias("b")).orderBy("part").collect()
    assert sum(r.n for r in found) == 501 and all(r.n <= 60 and (r.bytes or 0) <= 1500 for r in found)
    assert all(x.b < y.a for x, y in zip(found, found[1:], strict=False))  # in order of the path


def test_a_look_writes_only_what_differs(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    for i in range(5):
        (root / f"{i}.txt").write_text(str(i))
    feed = codefs.ChangeFeed(spark, str(root), str(tmp_path / "feed"))
    assert feed.look() == 5 and feed.look() == 0
    (root / "1.txt").write_text("longer")
    os.remove(root / "2.txt")
    assert feed.look() == 2 and feed.snapshot().count() == 4
    rows = spark.read.parquet(str(tmp_path / "feed" / "changes")).collect()
    assert sorted((os.path.basename(r.path), r.change) for r in rows)[1:4] == [("1.txt", "upsert"), ("1.txt", "upsert"), ("2.txt", "delete")]
    read = codefs.contents(spark.createDataFrame([(str(root / "1.txt"), 5_000, "upsert"), (str(root / "2.txt"), 5_000, "upsert")], "path string, mtime_ns long, change string"), str(root)).collect()
    assert [(r.content, r.change) for r in read] == [(b"longer", "upsert"), (None, "delete")]


def test_watching_follows_changes(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (root / "a.txt").write_text("one")
    c, table = Collection(spark, str(tmp_path / "c")).create(8, buckets=2), StateTable(spark, str(tmp_path / "state"))
    running = index_stream(spark, str(root), c, table, HashingEmbedder(8), str(tmp_path / "cp"), strategy="by_lines", watch=True, seconds=1)
    try:
        def reached(n):
            end = time.time() + 90
            while time.time() < end and c.count() != n:
                time.sleep(0.5)
            return c.count() == n

        assert reached(1)
        (root / "b.txt").write_text("two")
        assert reached(2) and running.isActive
    finally:
        running.stop()
    assert not running.isActive and running.error is None and threading.active_count() < 50


def test_state_is_kept_as_changes(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), compact_every=3)
    rows = lambda *x: spark.createDataFrame([(p, None, c, 1, None, None, None, None, g) for p, c, g in x], states.CHANGES)
    table.append(rows(*[(f"p{i:03d}", "old", False) for i in range(100)]))
    first = {f: (tmp_path / "s" / "rows" / f).stat().st_mtime for f in folders(tmp_path / "s", "rows")}
    table.append(rows(("p001", "new", False), ("p002", None, True)))
    rows(("junk", "x", False)).write.parquet(str(tmp_path / "s" / "rows" / "broken"))  # a write that had no entry
    assert all((tmp_path / "s" / "rows" / f).stat().st_mtime == t for f, t in first.items())
    found = {r.path: r.checksum for r in table.read().collect()}
    assert len(found) == 99 and found["p001"] == "new" and "p002" not in found and "junk" not in found
    table.append(rows(("p002", "again", False)))
    asked = spark.createDataFrame([("p001",), ("p002",), ("none",)], "path string")
    assert {r.path: r.checksum for r in table.of(asked).collect()} == {"p001": "new", "p002": "again"}
    table.append(rows(("p003", None, True)))  # the fourth: folded
    assert len(folders(tmp_path / "s", "rows")) == 1 and table.read().count() == 99 and table.of(asked.filter("path = 'x'")).count() == 0
    stale = StateTable(spark, str(tmp_path / "s"))
    last = stale.log.last()
    table.append(rows(("q", "x", False)))
    with pytest.raises(RuntimeError):  # two that began from the same entry
        stale.log.commit({"version": last["version"] + 1, "rows": []})


def git(root, *a):
    subprocess.run(["git", "-c", "user.name=N", "-c", "user.email=e@x", "-C", str(root), *a], check=True, capture_output=True)


def test_commits_are_read_once(spark, tmp_path):
    top = tmp_path / "g"
    (top / "sub").mkdir(parents=True)
    (top / "a.py").write_text("1")
    (top / "sub" / "a.py").write_text("1")
    git(top, "init", "-q")
    git(top, "add", ".")
    git(top, "commit", "-qm", "first")
    table = versions.CommitTable(spark, str(tmp_path / "commits"))
    assert table.update(str(top / "sub")) == 1 and table.update(str(top / "sub")) == 0
    # A root below the top has the paths of its own files.
    assert [(r.path, r.commit_subject) for r in table.latest().collect()] == [(str(top / "sub" / "a.py"), "first")]
    (top / "sub" / "b.py").write_text("2")
    (top / "a.py").write_text("2")
    git(top, "add", ".")
    git(top, "commit", "-qm", "second")
    assert table.update(str(top / "sub")) == 1  # the new commit's one file here
    assert len(folders(tmp_path / "commits", "rows")) == 2
    (top / "sub" / "a.py").write_text("3")
    git(top, "commit", "-qam", "third")
    assert table.update(str(top / "sub"), most_folders=1) == 1 and len(folders(tmp_path / "commits", "rows")) == 1
    assert {os.path.basename(r.path): r.commit_subject for r in table.latest().collect()} == {"a.py": "third", "b.py": "second"}
    asked = spark.createDataFrame([(str(top / "sub" / "b.py"),)], "path string")
    assert [r.commit_subject for r in table.of(asked).collect()] == ["second"] and table.of(asked.limit(0)).count() == 0
    git(top, "commit", "--amend", "-qm", "rewritten")
    assert table.update(str(top / "sub")) == 3 and {r.commit_subject for r in table.latest().collect()} == {"rewritten", "second"}


def test_a_relative_root_and_only_tracked(spark, tmp_path, monkeypatch):
    root = tmp_path / "w"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.py").write_text("x")
    (root / "sub" / "b.py").write_text("y")
    git(root, "init", "-q")
    git(root, "add", "sub/a.py")
    git(root, "commit", "-qm", "first")
    monkeypatch.chdir(root)
    c, table = Collection(spark, str(tmp_path / "c")).create(8, buckets=2), StateTable(spark, str(tmp_path / "s"))
    index_stream(spark, "sub", c, table, HashingEmbedder(8), str(tmp_path / "cp"), strategy="by_lines", git=True, only_tracked=True).awaitTermination(120)
    assert [(os.path.basename(r.filepath), r.commit_subject) for r in c.read().collect()] == [("a.py", "first")]


def test_staged_tables_go_with_their_scope(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with clean_up(spark):
        outer = staged(spark.range(3), "outer")
        with clean_up(spark):
            staged(spark.range(2), "inner")
        assert outer.count() == 3 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before
    staged(spark.range(1), "kept")
    assert len(set(os.listdir(folder)) - before) == 1
