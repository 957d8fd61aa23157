import os

import duckdb
import pytest

import __spark_entry__ as entry
from inkwell.llm.entry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(repr, wanted.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
