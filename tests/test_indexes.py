"""Indexes give what scans give, and open few files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import indexes, rag, retrieval, vectors
from corpusloom.operators.collection import Collection
from corpusloom.plans.indexing import to_points

SF = "/root/testdata/sf0.001"


def same(found, want):
    assert [(r[0], r.score) for r in found] == [(r[0], r.score) for r in want]


def test_sparse_lists_equal_the_scan_on_all_items(spark, tmp_path):
    docs = vectors.with_sparse(spark.read.parquet(f"{SF}/documents.parquet"), "text").select("doc_id", "source", "sparse").cache()
    index = indexes.SparseIndex(spark, str(tmp_path / "i"), "doc_id").build(docs, order=("source", "doc_id"), range_rows=8)
    files = spark.read.parquet(str(tmp_path / "i")).inputFiles()
    items = vectors.with_sparse(spark.read.parquet(f"{SF}/benchmark.parquet"), "text").orderBy("item_id").limit(6).collect()
    asked = [r.sparse for r in items] + [vectors.sparse_of(spark, "nothingofthekind"), vectors.sparse_of(spark, "")]
    for query in asked:
        same(index.search(query, 5).collect(), retrieval.sparse_topk(docs, query, 5, "doc_id").collect())
        opened = index.lists(list(query["indices"]))
        assert not opened.inputFiles() or len(opened.inputFiles()) <= len({i % 64 for i in query["indices"]}) / 64 * len(files) * 2
    one = asked[0]
    few = docs.filter("doc_id % 3 = 0").select("doc_id")
    same(index.search(one, 5, only=few).collect(), retrieval.sparse_topk(docs.filter("doc_id % 3 = 0"), one, 5, "doc_id").collect())
    same(index.search(one, 5, without=few).collect(), retrieval.sparse_topk(docs.filter("doc_id % 3 <> 0"), one, 5, "doc_id").collect())
    same(index.search(one, 1000, first=1).collect(), retrieval.sparse_topk(docs, one, 1000, "doc_id").collect())  # more than there are
    docs.unpersist()


def test_ranges_that_cannot_reach_the_top_stay_packed(spark, tmp_path):
    """Points about one thing stand together: a query about it unpacks their range alone."""
    rows = [(f"p{i:03d}", f"d{i // 50}/f", i, f"topic{i // 50} " * (1 + i % 5) + f"word{i}") for i in range(400)]
    points = vectors.with_sparse(spark.createDataFrame(rows, "point_id string, filepath string, chunk_index int, content string"))
    index = indexes.SparseIndex(spark, str(tmp_path / "i")).build(points, range_rows=50)
    query = vectors.sparse_of(spark, "topic3 topic5 word160")
    bounds = index.lists(list(query["indices"])).select("range").distinct().count()
    assert bounds <= 3
    same(index.search(query, 5, first=1).collect(), retrieval.sparse_topk(points, query, 5).collect())


@pytest.fixture(scope="module")
def dense_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    x[7], x[8:40] = 0, x[100]  # no direction, and ties
    return spark.createDataFrame([(f"p{i:04d}", v, i % 10) for i, v in enumerate(x.tolist())], "point_id string, dense array<float>, kind int").cache()


def test_dense_cells(spark, tmp_path, dense_rows):
    index = indexes.DenseIndex(spark, str(tmp_path / "i")).build(dense_rows, payload=("kind",), cells=64)
    assert spark.read.parquet(str(tmp_path / "i" / "points")).count() == 3999
    queries, hits, read = [r.dense for r in dense_rows.filter("point_id IN ('p0100', 'p1000', 'p1001', 'p2000', 'p2222', 'p3456')").collect()], 0, []
    for q in queries:
        want = retrieval.dense_topk(dense_rows.filter("point_id <> 'p0007'"), q, 10).collect()
        got = index.search(q, 10).collect()
        hits += len({r.point_id for r in got} & {r.point_id for r in want})
        same(index.search(q, 10, exact=True, share=0.02).collect(), want)
    recall = hits / (10 * len(queries))
    print("recall at a tenth of the points:", recall)
    assert recall >= 0.95
    cells = index.cells()
    read = index.rows(cells["cell"].tolist()[:6]).inputFiles()
    assert len(read) < 0.2 * len(spark.read.parquet(str(tmp_path / "i" / "points")).inputFiles())
    # A filter that few pass: the top ten of those, from all cells.
    q = queries[0]
    rare = (F.col("kind") == 3) & F.col("point_id").between("p0500", "p0600")
    same(index.search(q, 10, where=rare).collect(), retrieval.dense_topk(dense_rows.filter(rare), q, 10).collect())
    some = dense_rows.filter("kind = 0").select("point_id")
    same(index.search(q, 10, exact=True, without=some).collect(), retrieval.dense_topk(dense_rows.filter("kind <> 0 AND point_id <> 'p0007'"), q, 10).collect())
    assert index.search([0.0] * 16, 5).count() == 0
    nothing = indexes.DenseIndex(spark, str(tmp_path / "none")).build(dense_rows.limit(0), cells=4)
    assert nothing.search(q, 5).count() == 0


def test_a_collections_index_follows_it(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "filepath string, content string")
    make = lambda *x: to_points(rows(*x), vectors.HashingEmbedder(8), strategy="by_lines", buckets=2)
    c = Collection(spark, str(tmp_path / "c")).create(8, buckets=2)
    c.upsert(make(*[(f"d{i % 3}/f{i}.py", f"alpha word{i} common{i % 4} in the text") for i in range(30)]))
    index = indexes.CollectionIndex(c)
    query, q = vectors.sparse_of(spark, "alpha common1 word5"), [1.0, 0.5, 0, 0, 0.2, 0, 0, 0.1]
    where = retrieval.payload_filter("d1/")

    def check():
        same(index.sparse(query, 7).collect(), retrieval.sparse_topk(c.read(), query, 7).collect())
        same(index.dense(q, 7, exact=True).collect(), retrieval.dense_topk(c.read(), q, 7).collect())
        same(index.hybrid(q, query, 4, exact=True).collect(), retrieval.hybrid_topk(c.read(), c.read(), q, query, 4).collect())
        same(index.dense(q, 7, where=where).collect(), retrieval.dense_topk(c.read().filter(where), q, 7).collect())

    check()  # no index yet: a scan
    index.build(cells=4)
    check()
    c.apply(make(("d1/f1.py", "alpha common1 word5 word5"), ("new.py", "alpha common1")), rows(("d2/f5.py", "")).select("filepath"))
    assert index._since()[1] is not None and index._since()[2].count() == 2
    check()
    c.compact()
    assert index._since() is None
    check()
    assert index.build(cells=4) == 1 and index._since()[1] is None
    check()
    asked = [rag.ask(c.read(), "alpha common1 word5", rag.EchoProvider(), vectors.HashingEmbedder(8), max_chunks=3, index=i) for i in (None, index)]
    assert asked[0] == asked[1]


def test_filters_open_only_files_that_can_match(spark, tmp_path):
    chunks = spark.createDataFrame([(f"pkg{i // 40}/mod{i % 40:02d}{'_test' if i % 8 == 0 else ''}.{'py' if i % 2 else 'go'}", f"text {i}") for i in range(400)], "filepath string, content string")
    c = Collection(spark, str(tmp_path / "c")).create(4, buckets=2)
    for half in (chunks.filter("filepath < 'pkg5'"), chunks.filter("filepath >= 'pkg5'")):
        c.upsert(to_points(half, vectors.HashingEmbedder(4), strategy="by_lines", buckets=2))
    c.compact()
    everything = c.matching_files()
    for f, language, is_test in [("pkg3/", None, None), ("mod07", None, None), ("pkg9/mod01", "python", False), ("7/mod", "go", True), ("nowhere", None, None), ("p", None, None), (None, "python", True), (None, None, True)]:
        got = {r.filepath for r in c.read_where(f, language, is_test).collect()}
        assert got == {r.filepath for r in c.read().filter(retrieval.payload_filter(f, language, is_test)).collect()}
        holding = {x.file for x in c.read().filter(retrieval.payload_filter(f, language, is_test)).select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
        assert holding <= set(c.matching_files(f, language, is_test))
    assert len(c.matching_files("pkg3/")) <= len(everything) / 2 and c.matching_files("nowhere") == [] and c.matching_files(None, "rust") == []
    c.upsert(to_points(spark.createDataFrame([("pkg3/new.py", "x")], "filepath string, content string"), vectors.HashingEmbedder(4), strategy="by_lines", buckets=2))
    assert c.read_where("pkg3/new").count() == 1 and c.vacuum() >= 1 and c.read_where("pkg3/").count() == 41
