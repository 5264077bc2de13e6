"""What reviews of larger tables found: queries on small tables that show it, against their SQL or by hand."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as e
from corpusloom.operators import chunking, indexes, retrieval, vectors
from corpusloom.plans import queries


def against_sql(spark, folder, name, **tables):
    """Rows of a query on tables(schema, rows), and those of its SQL."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for table, (schema, rows) in tables.items():
        path = f"{folder}/{table}.parquet"
        if not os.path.exists(path):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return Counter(map(tuple, e.queries()[name](spark, str(folder)).collect())), Counter(con.execute(e.oracle_sql()[name]).fetchall())


HTML = "<h1>Top {0}</h1>" + "".join(f"<p>line {i} of {{0}} the {'x' * 80}</p>" for i in range(25))
PAGES = "page_id long, url string, html string", [(1, "u", None), (2, "u", HTML.format("b")), (3, "u", HTML.format("c")), (4, "v", HTML.format("d")), (5, "w", None)]


@pytest.mark.parametrize("name", ["toc", "toc_text", "section_texts", "shorten_pages"])
def test_pages_of_one_url(spark, tmp_path, name):
    found, wanted = against_sql(spark, tmp_path, name, pages=PAGES)
    assert found == wanted


def test_page_of_a_url_is_the_first_in_any_order(spark):
    pages = [*PAGES[1], (6, None, HTML.format("e")), (7, None, HTML.format("f"))]
    for order in (pages, pages[::-1]):
        rows = queries.one_page(spark.createDataFrame(order, PAGES[0]).repartition(3)).collect()
        assert {(r.url, r.page_id) for r in rows} == {("u", 2), ("v", 4), ("w", None), (None, 6)}


def test_sections_by_number(spark, tmp_path):
    pages = PAGES[0], [(1, "u", HTML.format("1 a")), (2, "v", "<h1>x</h1><p>1</p><h1>Then 1</h1><h1>1</h1><h1>THE</h1>")]
    found, wanted = against_sql(spark, tmp_path, "sections", pages=pages)
    assert found == wanted


def test_embedding_shares_that_end_in_a_half(spark, tmp_path):
    words = {}
    for i in range(1000):
        h = int.from_bytes(hashlib.md5(f"w{i}".encode()).digest()[:4], "big")
        words.setdefault(h % 32, f"w{i}")
    texts = [" ".join([words[1]] * 8 + [words[2]] * 9 + [words[3]] * k) for k in range(8, 60)] + [" ".join([words[1]] * 40 + [words[2]] * k) for k in range(41, 100, 2)]
    documents = "doc_id long, text string, lang string, source string", [(i, t, "en", "src0") for i, t in enumerate([*texts, "", None, " "])]
    found, wanted = against_sql(spark, tmp_path, "embed_chunks", documents=documents)
    assert found == wanted


def test_a_task_packs_the_lists_of_its_ranges(spark, tmp_path):
    points = [(f"p{i:02d}", f"f{i:02d}", 0, {"indices": [0, 3 + i % 2], "values": [1.0 / (i + 1), 0.5]}) for i in range(23)] + [("none", "f99", 0, {"indices": [], "values": []}), ("null", "g", 0, None)]
    rows = spark.createDataFrame(points, "point_id string, filepath string, chunk_index int, sparse struct<indices:array<int>,values:array<double>>")
    number = lambda range_rows: indexes._packer(range_rows)
    packed = rows.coalesce(1).select(F.col("point_id").alias("id"), F.col("sparse").alias("_vector")).mapInArrow(number(10), "idx int, range long, top double, posts array<struct<id:string,val:double>>").collect()
    assert sorted((r.idx, r.range, r.top, len(r.posts)) for r in packed) == [(0, 0, 1.0, 10), (0, 1, 1 / 11, 10), (0, 2, 1 / 21, 3), *[(i, r, 0.5, n) for i in (3, 4) for r, n in zip(range(3), (5, 5, 2 if i == 3 else 1))]]
    index = indexes.SparseIndex(spark, str(tmp_path / "index")).build(rows.repartition(3), range_rows=4)
    lists = index.lists([0, 3, 4])
    assert lists.count() == lists.select("idx", "range").distinct().count() and lists.filter("size(posts) > 4").isEmpty() and lists.selectExpr("sum(size(posts))").first()[0] == 46
    query = Row(indices=[0, 4], values=[1.0, 0.1])
    assert index.search(query, 7).collect() == retrieval.sparse_topk(rows, query, 7).collect()


def test_windows_of_characters_leave_python_as_places(spark):
    texts = ["", None, "é\n" * 7, "plain\ntext", "a\U0001f600b\n\n ü" * 5, "x" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "filepath int, content string").selectExpr("cast(filepath AS string) AS filepath", "content")
    invalid = spark.sql("SELECT 'bad' AS filepath, cast(X'61ff6262620a62e282620a' AS string) AS content")
    for rows, texts in ((rows, texts), (invalid, {"bad": "a�bbb\nb�b\n"})):
        chunks = chunking.by_size(rows, 4, 1)
        whole = dict(texts) if isinstance(texts, dict) else {str(i): t or "" for i, t in enumerate(texts)}
        wanted = [(p, i, t[a : a + 4], 1 + t[:a].count("\n"), 1 + t[:a].count("\n") + t[a : a + 4].count("\n")) for p, t in whole.items() for i, a in enumerate(range(0, len(t), 3))]
        assert sorted(map(tuple, chunks.select("filepath", "chunk_index", "content", "line_start", "line_end").collect())) == sorted(wanted)
    # What comes back from Python holds no texts.
    assert "begin" in chunks._jdf.queryExecution().optimizedPlan().toString()


TEXTS = ["", None, "9 9", "alpha beta alpha", "beta gamma", "alpha", *(" ".join(f"w{j % 7}" for j in range(i)) for i in range(30))]


def test_batch_search_makes_vectors_where_it_scores(spark, tmp_path):
    documents = "doc_id long, text string", list(enumerate(TEXTS))
    items = "item_id long, text string", [(0, "alpha beta"), (1, ""), (2, None), (3, "w1 w2 w2 w6"), (4, "nothing of it"), (5, "alpha alpha")]
    found, wanted = against_sql(spark, tmp_path, "sparse_batch_search", documents=documents, benchmark=items)
    assert found == wanted and {r[0] for r in found} == {0, 3, 5}
    plan = e.queries()["sparse_batch_search"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    rows, asked = spark.createDataFrame(documents[1], documents[0]), vectors.with_sparse(spark.createDataFrame(items[1], "query_id long, text string"), "text")
    both = retrieval.sparse_batch_topk(rows, asked, 4, "doc_id", text="text"), retrieval.sparse_batch_topk(vectors.with_sparse(rows, "text"), asked, 4, "doc_id")
    one, other = (sorted(map(tuple, x.collect())) for x in both)
    assert one == other and len(one) == 9


def test_a_batch_is_scored_by_slices_of_bounded_size(monkeypatch):
    monkeypatch.setattr(retrieval, "TERMS", 40)
    held, unit = [], retrieval.unit_terms
    monkeypatch.setattr(retrieval, "unit_terms", lambda part: held.append(len(part.flatten())) or unit(part))
    lists = pa.array([t and t.split() for t in TEXTS], pa.list_(pa.string()))
    row, idx, val = unit(lists)
    offsets = pa.array(np.searchsorted(row, np.arange(len(TEXTS) + 1)), pa.int32())
    sparse = pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (idx, val)], names=["indices", "values"])
    asked = [Row(indices=idx[row == i].tolist(), values=val[row == i].tolist()) for i in (3, 20, 35)]
    dense = np.zeros((len(TEXTS), vectors.VOCABULARY))
    dense[row, idx] = val
    for column in (lists, sparse, sparse.slice(2), lists.slice(5), lists.slice(0, 0)):
        found = np.full((len(column), 3), np.nan)
        for a, part in retrieval._sparse_scores(retrieval._Terms(asked), column):
            found[a : a + len(part)] = part
        assert np.allclose(np.nan_to_num(found), dense[len(dense) - len(column) :] @ dense[[3, 20, 35]].T)
    assert max(held) < 80 and sum(held) > 400
