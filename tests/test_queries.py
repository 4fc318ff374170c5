"""Every registered query of the engine against its SQL, and cursors."""

from pathlib import Path

import duckdb
import pytest

from meshset import queries
from meshset.model import Snapshot
from meshset.sources.cursor import Cursor

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not Path(DATA).is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in sorted(Path(DATA).glob("*.parquet")):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, db, name):
    got = queries.QUERIES[name](spark, DATA)
    want = db.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda xs: sorted(repr(tuple(x)) for x in xs)
    assert rows(got.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_cursor(spark):
    names = [f"n{k:02}" for k in range(12)]
    nodes = spark.createDataFrame([(n, "HOST") for n in reversed(names)], "name string, type string")
    c = Cursor(Snapshot(nodes, nodes, nodes))
    assert c.prev() is None and c.next() == "n00" and c.next(3) == "n03" and c.prev(2) == "n01"
    assert c.prev(2) is None and c.at == "n01" and c.last() == "n11" and c.next() is None and c.first() == "n00"
    assert c.fetch("n07") == "n07" and c.fetch("nosuch") is None and c.next() == "n08"
    empty = Cursor(Snapshot(nodes.limit(0), nodes, nodes))
    assert empty.first() is None and empty.last() is None and empty.next() is None
