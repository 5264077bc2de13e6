"""Every registered query of this library against its SQL twin, at the smallest scale."""

import math

import duckdb
import pytest

from corpusloom.plans.oracles import ORACLES
from corpusloom.plans.queries import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(values):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = rows(df.select(*columns).collect())
    assert found
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        order = [[c[0] for c in cursor.description].index(c) for c in columns]
        assert found == rows([tuple(r[i] for i in order) for r in cursor.fetchall()])


def test_entry_works_without_the_training_data_operators():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['corpusloom.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert e.llm is None and 'sparse_search' in e.queries() and not [q for q in e.queries() if q.startswith('op')]\n"
        "assert set(e.oracle_sql()) <= set(e.queries())"
    )
    import os

    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0, done.stderr[-2000:]
